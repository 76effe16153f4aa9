"""Cost of analyses from trace tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENS = ("input_tokens", "output_tokens", "total_tokens")


def cost_report(calls: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per trace: attempts add up, the latency of the trace is taken once.

    A trace with several root spans keeps the last. Calls are folded before the
    join, so the join meets one row per trace on either side.
    """
    zero = lambda c, v: F.sum(F.coalesce(F.col(c), F.lit(v))).alias(c)
    folded = calls.groupBy("trace_id").agg(
        *[zero(c, 0) for c in TOKENS], zero("cost_eur", 0.0), F.count("*").alias("attempts")
    )
    latency = spans.groupBy("trace_id").agg(F.max_by("latency_s", "span_seq").alias("latency_s"))
    return folded.join(latency, "trace_id", "left").withColumn(
        "latency_s", F.coalesce("latency_s", F.lit(0.0))
    )


def cost_summary(report: DataFrame) -> DataFrame:
    """Means over the traces that used tokens; the others are counted apart.

    Without any such trace there is no row.
    """
    used = F.col("total_tokens") > 0
    measure = lambda f, c: F.round(f(F.when(used, F.col(c))), 6)
    columns = (*TOKENS, "cost_eur", "latency_s")
    return report.agg(
        F.count_if(used).alias("measured"),
        F.count_if(~used).alias("excluded"),
        *[measure(F.avg, c).alias(f"mean_{c}") for c in columns],
        *[measure(F.min, c).cast("double").alias(f"min_{c}") for c in ("total_tokens", "latency_s")],
        *[measure(F.max, c).cast("double").alias(f"max_{c}") for c in ("total_tokens", "latency_s")],
    ).filter(F.col("measured") > 0)
