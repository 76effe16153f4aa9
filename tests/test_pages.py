"""Chains of feed pages: order, gaps, circles, repeated pages; the model encoder."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeworks.operators import encode, pages

SCHEMA = "page string, next_page string, steps int, back string"


def walk(rows):
    """page -> (first, position, missing) by following links one at a time."""
    following, before = {}, {}
    for page, link in rows:
        if page is not None:
            following[page] = min(x for x in (following.get(page), link, "~") if x is not None)
    following = {page: None if link == "~" else link for page, link in following.items()}
    for page, link in following.items():
        if link is not None:
            before[link] = min(page, before.get(link, page))
    found = {}
    for page in following:
        at, steps, seen = page, 0, set()
        while at in before and before[at] in following and at not in seen:
            seen.add(at)
            at, steps = before[at], steps + 1
        ended = at not in seen
        missing = following[page] if following[page] not in following else None
        found[page] = (at if ended else None, steps if ended else None, missing)
    return found


def check(spark, rows):
    frame = spark.createDataFrame([(*row, 1, "x") for row in rows], SCHEMA)
    got = {r["page"]: (r["first"], r["position"], r["missing"]) for r in pages.page_order(frame).collect()}
    assert got == walk(rows)


def test_a_chain_in_any_order_with_a_gap(spark):
    rows = [(f"p{i:03}", f"p{i + 1:03}" if i < 99 else None) for i in range(100) if i != 41]
    random.Random(1).shuffle(rows)
    check(spark, rows)


def test_circles_repeats_nulls_and_forks(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("x", "y"), ("y", None), (None, "z"), ("s", "s"), ("m", "o"), ("n", "o"), ("o", "lost")]
    check(spark, rows)


def test_no_pages(spark):
    assert pages.page_order(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("batch", [7, 1000])
def test_a_model_is_loaded_once_per_worker_and_sees_bounded_batches(spark, tmp_path, batch):
    loads, sizes = str(tmp_path / "loads"), str(tmp_path / "sizes")
    name = f"counting-{batch}-{tmp_path}"

    def load():
        import os

        with open(loads, "a") as file:
            file.write(f"{os.getpid()}\n")

        def model(texts):
            with open(sizes, "a") as file:
                file.write(f"{len(texts)}\n")
            return np.array([[len(text), 1.0] for text in texts])

        return model

    rows = spark.createDataFrame([(i, "x" * (i % 90) if i % 50 else None) for i in range(400)], "id int, text string")
    frame = rows.repartition(16).withColumn("v", encode.model_encoder(name, load, batch)(F.col("text")))
    for _ in range(2):
        assert all(r["v"] == [float(len(r["text"] or "")), 1.0] for r in frame.collect())
    workers = open(loads).read().split()
    assert len(workers) == len(set(workers))
    assert max(map(int, open(sizes).read().split())) <= batch
