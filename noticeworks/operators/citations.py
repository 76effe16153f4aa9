"""Checking quotes against the pages they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks import schemas
from noticeworks.functions.text import comparable, units

VERIFIED = "verified"
REORDERED = "verified_reordered"
UNVERIFIED = "unverified"


def check_citations(citations: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds the outcome of every citation.

    verified: the quote stands on the page in one piece, white space and case
    aside. verified_reordered: all its words and symbols are there. Pages and
    quotes are normalized before the join, each once. A page cited by very many
    citations is a skewed join key, which adaptive execution splits.
    """
    prepared = (
        pages.select("doc_id", "page", comparable(F.col("text")).alias("page_text"))
        .withColumn("page_units", F.array_distinct(units(F.col("page_text"))))
    )
    quoted = citations.withColumn("quote_text", comparable(F.col("quote")))
    absent = F.array_except(units(F.col("quote_text")), F.col("page_units"))
    outcome = (
        F.when(F.col("page_text").isNull(), UNVERIFIED)
        .when(F.contains("page_text", "quote_text"), VERIFIED)
        .when(F.size(absent) == 0, REORDERED)
        .otherwise(UNVERIFIED)
    )
    return (
        quoted.join(prepared, ["doc_id", "page"], "left")
        .withColumn("outcome", outcome)
        .drop("page_text", "page_units", "quote_text")
    )


def long_citations(extractions: DataFrame) -> DataFrame:
    """One row per present citation of an extraction: the blocks, then each certification.

    Two certifications of one name share a report key; the later one counts.
    """
    blocks = F.array(
        *[
            F.struct(F.lit(name).alias("field"), F.col(f"extraction.{name}.citation").alias("citation"))
            for name in schemas.CITATION_BLOCKS
        ]
    )
    certifications = F.col("extraction.certifications")
    cited = F.filter(certifications, lambda c: c["citation"].isNotNull())

    def is_last(c: Column, i: Column) -> Column:
        later = F.slice(F.col("cited"), i + 2, F.size("cited"))
        return ~F.exists(later, lambda x: x["name"] == c["name"])

    named = F.transform(
        F.filter("cited", is_last),
        lambda c: F.struct(
            F.concat(F.lit("certifications["), c["name"], F.lit("]")).alias("field"),
            c["citation"].alias("citation"),
        ),
    )
    return (
        extractions.withColumn("cited", cited)
        .select("analysis_id", "doc_id", F.inline(F.concat(blocks, named)))
        .filter(F.col("citation").isNotNull())
        .select("analysis_id", "doc_id", "field", "citation.*")
    )


def citation_report(extractions: DataFrame, pages: DataFrame) -> DataFrame:
    """Field by field outcome of every present citation."""
    return check_citations(long_citations(extractions), pages)


def faithfulness(extractions: DataFrame, pages: DataFrame) -> DataFrame:
    """Share of the present citations a document supports; 1 when there are none."""
    supported = F.when(F.col("outcome") != UNVERIFIED, 1.0).otherwise(0.0)
    shares = (
        citation_report(extractions, pages)
        .groupBy("analysis_id")
        .agg(F.avg(supported).alias("share"), F.count("*").alias("present"))
    )
    return extractions.select("analysis_id").join(shares, "analysis_id", "left").select(
        "analysis_id",
        F.coalesce("present", F.lit(0)).alias("citations"),
        F.round(F.coalesce("share", F.lit(1.0)), 9).alias("faithfulness"),
    )
