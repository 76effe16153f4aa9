"""Encoders look at a word once and hold one part of a batch at a time."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from noticeworks.operators import encode
from test_scale import plan


def test_parts_leave_one_at_a_time():
    seen = []

    def model(texts):
        seen.append(len(texts))
        return [[float(len(text))] for text in texts]

    parts = encode.in_parts(model, pd.Series(["a", None, "ccc", "dd", "e"]), 2)
    first = next(parts)
    assert seen == [2] and [v.tolist() for v in first] == [[1.0], [0.0]] and first[0].dtype == np.float32
    assert [v.tolist() for part in parts for v in part] == [[3.0], [2.0], [1.0]] and seen == [2, 2, 1]


def test_a_word_is_hashed_once(spark):
    rows = spark.range(3).select(F.col("id").cast("string").alias("text"))
    text = plan(rows.select(encode.hashing_encoder()(F.col("text")).alias("vector")))
    assert text.count("md5(") == 1
