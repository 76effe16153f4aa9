"""Connected components of a graph whose edges are spread over a cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.llm.common import stored


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node hangs under one smaller node that hangs under none itself."""
    ends = edges.select("u", F.lit(1).alias("under"), F.lit(0).alias("over")).unionByName(
        edges.select(F.col("v").alias("u"), F.lit(0).alias("under"), F.lit(1).alias("over"))
    )
    nodes = ends.groupBy("u").agg(F.sum("under").alias("under"), F.max("over").alias("over"))
    return nodes.where("under > 1 or (under = 1 and over = 1)").isEmpty()


def components(edges: DataFrame, label: str) -> DataFrame:
    """node and component (its smallest node) of every node that isn't the smallest of its component.

    Alternating large and small stars over the edges (a, b): each pass hangs neighbours under
    the smallest node they know of, until every edge leads to the smallest node of a
    component. Passes are aggregations and joins, each stored; a node with very many
    neighbours is one row of a minimum, never a list.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, number = stored(now, f"{label}-edges"), 0
    while not _is_settled(now):
        # Large star: whatever hangs under a node moves to the smallest node that this one hangs under.
        least = now.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = now.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        # Small star: all that a node hangs under, and the node, move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        now, number = stored(small, f"{label}-stars-{number}"), number + 1
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
