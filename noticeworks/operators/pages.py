"""Order of feed pages by their links, and the pages that are missing among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.session import shared_dir


def _stored(frame: DataFrame, path: str) -> DataFrame:
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def page_order(pages: DataFrame, page: str = "page", following: str = "next_page") -> DataFrame:
    """page, first, position, missing: the chain that a page stands in and its place there.

    `pages` holds each page with the address of the following one. A chain begins with a page
    that no other leads to (`first`) and is walked by pointer doubling: every step doubles the
    distance that each page knows, so a chain of n pages takes log2 n joins, each stored.
    `missing` is the address that the last page of a chain leads to and that was not found,
    null where the chain ends. Where pages lead in a circle, `first` and `position` are null.
    A page that stands several times is one, and leads to the least of its addresses; of
    several pages that lead to one, the least is its predecessor.
    """
    base = shared_dir(pages.sparkSession, "pages")
    links = pages.where(F.col(page).isNotNull()).groupBy(F.col(page).alias("page")).agg(F.min(following).alias("next"))
    before = links.where("next is not null").groupBy(F.col("next").alias("page")).agg(F.min("page").alias("back"))
    # A first page leads back to itself in no step, so that a walk ends there.
    known = links.join(before, "page", "left").select(
        "page",
        "next",
        F.coalesce("back", "page").alias("back"),
        F.when(F.col("back").isNull(), 0).otherwise(1).cast("bigint").alias("steps"),
    )
    now = _stored(known, f"{base}/0")
    # Distances double: after this many steps every chain is walked, and what still moves is a circle.
    for number in range(1, now.count().bit_length() + 1):
        far = now.select(F.col("page").alias("back"), F.col("back").alias("farther"), F.col("steps").alias("more"))
        walked = now.join(far, "back").select("page", "next", F.col("farther").alias("back"), (F.col("steps") + F.col("more")).alias("steps"))
        now = _stored(walked, f"{base}/{number}")
        ends = now.where("back = page").select(F.col("page").alias("back"))
        if now.where("back <> page").join(ends, "back", "left_anti").isEmpty():
            break
    firsts = now.where("back = page and steps = 0").select(F.col("page").alias("back"), F.lit(True).alias("ended"))
    landed = links.select(F.col("page").alias("next"), F.lit(True).alias("landed"))
    return (
        now.join(firsts, "back", "left")
        .join(landed, "next", "left")
        .select(
            "page",
            F.when(F.col("ended"), F.col("back")).alias("first"),
            F.when(F.col("ended"), F.col("steps")).alias("position"),
            F.when(F.col("landed").isNull(), F.col("next")).alias("missing"),
        )
    )
