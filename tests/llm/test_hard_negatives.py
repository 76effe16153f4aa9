"""Packed products and hard negatives against plain integers and loops."""

import math

import numpy as np
import pytest

from noticeworks.llm import hard_negatives as hard

SCHEMA = "vec_id bigint, embedding array<double>, label int, place int, score string, rank int, anchor_id int"


def whole(vector):
    return [int(x) * 256 if abs(x) >= 2**52 else math.floor(256 * x) for x in vector]


def clipped(x):
    return max(-(2**63), min(2**63 - 1, x))


def brute(rows, every=100, positives=5, negatives=5, least=80):
    chosen = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        chosen[vec_id] = max(chosen.get(vec_id, (label, vector)), (label, vector))
    ready = {vec_id: (label, whole(vector)) for vec_id, (label, vector) in chosen.items()}
    found = []
    for anchor, (label, vector) in ready.items():
        if anchor % every:
            continue
        ranked = sorted(
            (-clipped(sum(a * b for a, b in zip(vector, other))), vec_id, kind)
            for vec_id, (kind, other) in ready.items()
            if vec_id != anchor
        )
        for score, positive, _ in [row for row in ranked if row[2] == label][:positives]:
            band = [r for r in ranked if r[2] != label and least * -score <= 100 * -r[0] <= 100 * -score]
            found += [(anchor, positive, i, r[1], -score, -r[0]) for i, r in enumerate(band[:negatives], 1)]
    return sorted(found)


def frame(spark, rows):
    return spark.createDataFrame([(*row, 1, "x", 2, 3) for row in rows], SCHEMA)


def sample(count, width, seed=1):
    dice = np.random.default_rng(seed)
    vectors = np.round(dice.normal(size=(count, width)) + 0.5, 1)
    return [(i, vectors[i].tolist(), int(dice.integers(3))) for i in range(count)]


@pytest.mark.parametrize("largest", [3, 200, 1 << 17, 1 << 24, 1 << 40])
def test_packed_products_are_exact(largest):
    dice = np.random.default_rng(largest)
    one, other = dice.integers(-largest, largest + 1, (7, 19)), dice.integers(-largest, largest + 1, (23, 19))
    other[3] = 0
    wanted = one.astype(object) @ other.T.astype(object)
    got = hard.products(one, other)
    assert got.tolist() == [[clipped(x) for x in row] for row in wanted.tolist()]


def test_several_fields_share_a_double():
    dice = np.random.default_rng(5)
    one, other = dice.integers(-3, 4, (5, 8)), dice.integers(-3, 4, (50, 8))
    assert hard.DOUBLE_BITS // (4 * 8 * 3 * 3).bit_length() >= 5
    assert (hard.products(one, other) == one @ other.T).all()


def test_all_blocks_give_what_loops_give(spark):
    rows = sample(400, 6)
    rows += [(1000 + i, rows[40][1], i % 3) for i in range(60)]  # one vector very often, so many ties
    rows += [(None, [1.0] * 6, 1), (500, None, 1), (501, [1.0] * 6, None), (502, [1.0, None] * 3, 2)]
    rows += [(503, [float("nan")] * 6, 1), (504, [float("-inf")] * 6, 0), (600, [0.0] * 6, 1), (700, [1.0, 2.0], 1)]
    rows += [rows[20], rows[20], (20, rows[21][1], 2), (505, [], 1)]
    data = frame(spark, rows).repartition(5)
    for block in (hard.ANCHORS, 3):
        got = hard.mine(data, every=20, block=block)
        assert sorted(map(tuple, got.collect())) == brute(rows, every=20)
    assert len(brute(rows, every=20)) > 100


def test_components_beyond_64_bits(spark):
    rows = sample(60, 4)
    rows += [(100, [1e30, 1.0, -1e30, 2.0], 1), (101, [1e28, 3.0, 1.0, 1.0], 1), (102, [1e27, 0.0, 0.0, 1.0], 2)]
    got = hard.mine(frame(spark, rows), every=10)
    assert sorted(map(tuple, got.collect())) == brute(rows, every=10)


def test_empty_tables_and_lonely_anchors(spark):
    assert hard.mine(frame(spark, [(1, [1.0], 1)]).limit(0)).count() == 0
    assert hard.mine(frame(spark, [(100, [1.0], 1), (101, [1.0], 2)])).count() == 0
    assert hard.mine(frame(spark, [(100, [1.0], 1), (101, [1.0], 1), (102, [0.9], 2)])).count() == 1
