"""Free-text descriptions with the pages that should support them, and claim scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: pages on either side of a cited one.
RADIUS = 1

# The descriptions of an extraction with the question each answers.
QUESTIONS = {
    "economic_solvency": "¿Qué solvencia económica y financiera exige el pliego para poder licitar?",
    "technical_solvency": "¿Qué solvencia técnica o profesional exige el pliego para poder licitar?",
    "guarantees": "¿Qué garantías exige el pliego, provisional y definitiva?",
    "execution_deadline": "¿Cuál es el plazo de ejecución del contrato y qué prórrogas admite?",
    "submission_deadline": "¿Cuál es la fecha límite para presentar ofertas?",
    "subcontracting": "¿En qué condiciones admite el pliego la subcontratación?",
    "lots": "¿Está el contrato dividido en lotes y en qué términos se puede licitar a ellos?",
}
# Why a description is skipped.
NO_CITATION = "sin cita"
NO_PAGE = "la página citada no existe en el documento"


def context_window(
    cited: DataFrame, pages: DataFrame, keys: list[str], radius: int = RADIUS
) -> DataFrame:
    """Adds the texts of the cited page and its neighbours, in page order.

    `keys` identify a row of `cited`. The window is clipped at the ends of the
    document; a cited page outside of it leaves an empty array. A group gathers
    at most 2 * radius + 1 pages.
    """
    wanted = cited.select(
        *keys,
        "doc_id",
        F.col("page").alias("cited_page"),
        F.explode(F.sequence(F.col("page") - radius, F.col("page") + radius)).alias("page"),
    )
    found = F.sort_array(F.collect_list(F.struct("page", "text")))
    windows = (
        wanted.join(pages.select("doc_id", "page", "text"), ["doc_id", "page"])
        .groupBy(*keys)
        .agg(
            found.alias("found"),
            F.max(F.col("page") == F.col("cited_page")).alias("exists"),
        )
        .filter("exists")
        .select(*keys, F.transform("found", lambda f: f["text"]).alias("contexts"))
    )
    none = F.array().cast("array<string>")
    return cited.join(windows, keys, "left").withColumn("contexts", F.coalesce("contexts", none))


def freetext_samples(extractions: DataFrame, pages: DataFrame) -> DataFrame:
    """Seven rows per extraction: a description with its context, or why it is skipped."""
    rows = F.array(
        *[
            F.struct(
                F.lit(f"{name}.description").alias("field"),
                F.lit(question).alias("question"),
                F.col(f"extraction.{name}.description").alias("description"),
                F.col(f"extraction.{name}.citation.page").alias("page"),
            )
            for name, question in QUESTIONS.items()
        ]
    )
    listed = extractions.select("analysis_id", "doc_id", F.inline(rows))
    with_context = context_window(listed, pages, ["analysis_id", "field"])
    reason = F.when(F.col("page").isNull(), NO_CITATION).when(F.size("contexts") == 0, NO_PAGE)
    return with_context.withColumn("skip_reason", reason).withColumnRenamed("page", "cited_page")


def claim_scores(samples: DataFrame, claims: DataFrame) -> DataFrame:
    """Supported share of the claims of every description; null when it makes none."""
    counted = claims.groupBy("doc_id", "field").agg(
        F.count("*").alias("claims"), F.count_if("supported").alias("supported")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return samples.join(counted, ["doc_id", "field"], "left").select(
        "doc_id",
        "field",
        zero("claims"),
        zero("supported"),
        F.round(F.col("supported") / F.col("claims"), 9).alias("score"),
    )


def claim_summary(scores: DataFrame) -> DataFrame:
    """Mean score over the descriptions that make claims, claim totals, and the others."""
    return scores.agg(
        F.count("*").alias("descriptions"),
        F.count_if(F.col("claims") == 0).alias("without_claims"),
        F.sum("claims").alias("claims"),
        F.sum("supported").alias("supported"),
        F.round(F.avg("score"), 8).alias("mean_score"),
    )
