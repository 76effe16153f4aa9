"""Contiguous shards of nearly equal size from global prefix sums of byte sizes.

Documents are dealt out by ranges of doc_id and stored once with the number of their
range. The totals of the ranges (one row each) give the bytes and rows before each range;
a running sum inside a range gives the rest. A document belongs to the shard in whose
equal share of all bytes its middle lies, so every shard is contiguous in doc_id and cut
within half a document of its target.

Defined cases: a null text has no bytes (its size is `OVERHEAD`); null doc_ids come
first; rows with equal doc_id are ordered by size and checksum, and fully equal rows
get neighbouring places; an empty table gives an empty result. Other columns are ignored.
A document larger than a shard's share leaves shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.llm.common import stored

#: Bytes that a document takes besides its text.
OVERHEAD = 16


def sizes(documents: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and the overhead) and the text's checksum; the text itself goes no further."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        "doc_id",
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )


def shards(documents: DataFrame, count: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard (0 to count - 1), slot (gapless from 0) and grown_shard (null)."""
    ranged = sizes(documents).repartitionByRange("doc_id").withColumn("part", F.spark_partition_id())
    rows = stored(ranged, "shard-sizes")
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy("doc_id", "size", "text_crc32")
    running = rows.withColumn("through", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "row", F.row_number().over(inside)
    )
    placed = running.join(F.broadcast(bases), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        F.expr(f"int((2 * (bytes_before + through) - size) * {int(count)} div (2 * all_bytes))").alias("shard"),
        (F.col("rows_before") + F.col("row") - 1).alias("place"),
    )
    placed = stored(placed, "shard-places")
    starts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
