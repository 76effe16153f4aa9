"""Hard negatives for anchors of an embedding table, by exact Kronecker-packed products.

Every component x becomes the integer floor(256 * x). Components of several candidates are
made non-negative by a bias and put into separated fields of one wide integer; an anchor's
component, biased as well, multiplies that integer once and so meets all of these
candidates. The sum over components holds one sum per field; what the biases added is
known from the sums of both vectors and taken off, which leaves the exact inner products.
A field is as wide as the largest sum it may hold. The wide integer lives in a double,
which holds integers of 53 bits exactly, so that a block of anchors meets a block of
candidates in one matrix product; components too large for that go through integers of any
width, field by field in the same way.

Anchors are taken in blocks of about `ANCHORS`. A block is the stated query set of one
pass over all rows: its vectors are handed to the tasks, each task keeps the best few rows
of each anchor while it reads, and only these are shuffled and merged. A second pass does
the same with the bands of scores that the positives set. No candidate moves, and each
finished block is written to the shared folder.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite
component, take no part; of several rows with one vec_id the one with the greatest label,
then the greatest vector, counts; where vectors differ in length the missing components are
zero; scores beyond 64 bits count as the largest or smallest 64-bit integer; an anchor
without positives, and a positive without negatives in its band, give no row; ties go to
the smaller vec_id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.llm.common import list_values, stored
from noticeworks.session import shared_dir

SCALE = 256
#: Anchors of one pass, about.
ANCHORS = 8_192
#: Scores that a task holds at once.
HELD = 1 << 20
#: Bits of an integer that a double holds exactly.
DOUBLE_BITS = 53
#: Candidates in one integer of any width.
WIDE_FIELDS = 8
#: Vectors whose components stay below this go through doubles, if few enough bits are left per field.
ORDINARY = 1 << 18
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
_RESULT = ", ".join(f"{name} {'int' if name == 'rank' else 'bigint'}" for name in _COLUMNS)


@dataclass
class Rows:
    """Integer vectors (a matrix of 64-bit integers, or of Python integers where these are too narrow)."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    def take(self, chosen) -> Rows:
        return Rows(self.ids[chosen], self.labels[chosen], self.vectors[chosen])


def scaled(column: pa.Array) -> np.ndarray:
    """floor(256 * component) of every vector of a column; short vectors are filled with zeros."""
    values, offsets = list_values(column)
    lengths = np.diff(offsets)
    values = values.astype(np.float64)
    if np.abs(values).max(initial=0) < float(1 << 52) / SCALE:
        whole = np.floor(SCALE * values).astype(np.int64)
    else:
        whole = np.array([int(x) * SCALE if abs(x) >= 1 << 52 else floor(SCALE * x) for x in values.tolist()], object)
    width = int(lengths.max(initial=0))
    found = np.zeros((len(lengths), width), whole.dtype)
    found[np.arange(width) < lengths[:, None]] = whole
    return found


def read_rows(table) -> Rows:
    """Rows of an Arrow table or batch with vec_id, label and vector, in ascending order of vec_id."""
    columns = [part.combine_chunks() if isinstance(part, pa.ChunkedArray) else part for part in table.columns]
    rows = Rows(columns[0].to_numpy(zero_copy_only=False), columns[1].to_numpy(zero_copy_only=False), scaled(columns[2]))
    return rows.take(np.argsort(rows.ids, kind="stable"))


def products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products of all anchors with all candidates, as a matrix of 64-bit integers."""
    width = max(anchors.shape[1], candidates.shape[1])
    out = np.zeros((len(anchors), len(candidates)), np.int64)
    # Few large components must not cost the others their fields.
    for one in _by_size(anchors):
        for other in _by_size(candidates):
            out[np.ix_(one, other)] = _packed_products(anchors[one], candidates[other], width)
    return out


def _by_size(vectors: np.ndarray) -> list[np.ndarray]:
    large = np.array([any(abs(x) >= ORDINARY for x in row) for row in vectors], bool) if vectors.dtype == object else (
        np.abs(vectors).max(axis=1, initial=0) >= ORDINARY
    )
    return [part for part in (np.flatnonzero(~large), np.flatnonzero(large)) if len(part)]


def _packed_products(anchors: np.ndarray, candidates: np.ndarray, width: int) -> np.ndarray:
    one = max(1, int(np.abs(anchors).max(initial=0)))
    other = max(1, int(np.abs(candidates).max(initial=0)))
    bits = (4 * max(width, 1) * one * other).bit_length()
    fields = DOUBLE_BITS // bits
    kind = np.float64 if fields else object
    fields = fields or WIDE_FIELDS
    left = np.zeros((len(anchors), width), kind)
    left[:, : anchors.shape[1]] = anchors
    left += one
    # Candidate f of a group lies in field f; a group that isn't full is filled with zeros.
    groups = -(-len(candidates) // fields)
    right = np.zeros((groups * fields, width), kind)
    right[: len(candidates), : candidates.shape[1]] = candidates
    right += other
    right = right.reshape(groups, fields, width)
    wide = right[:, 0].copy()
    for field in range(1, fields):
        wide += right[:, field] * (1 << bits * field)
    sums = left @ wide.T
    of_left, of_right = left.sum(axis=1), right.sum(axis=2)
    if kind is np.float64:
        sums, of_left, of_right = sums.astype(np.int64), of_left.astype(np.int64), of_right.astype(np.int64)
    out = np.empty((len(anchors), groups, fields), sums.dtype)
    for field in range(fields):
        out[:, :, field] = (sums >> bits * field) & ((1 << bits) - 1)
    # (a + A)(c + C) summed, less C(a + A) and A(c + C) summed, is ac less one AC for each component.
    out -= other * of_left[:, None, None] + one * of_right - width * one * other
    if kind is object:
        out = np.clip(out, _LEAST, _MOST).astype(np.int64)
    return out.reshape(len(anchors), -1)[:, : len(candidates)]


class Best:
    """The `count` highest scores of each of some slots, equal scores by ascending id, kept over blocks of candidates."""

    def __init__(self, slots: int, count: int):
        self.count = count
        self.held = np.zeros(slots, np.int64)
        self.ids = np.zeros((slots, count), np.int64)
        self.scores = np.full((slots, count), _LEAST)

    def add(self, ids: np.ndarray, scores: np.ndarray, allowed: np.ndarray) -> None:
        """Candidates by ascending id; `scores` and `allowed` have a row per slot."""
        if not allowed.any():
            return
        scores = np.where(allowed, scores, _LEAST)
        least = self.scores[:, -1]
        if scores.shape[1] > self.count:
            least = np.maximum(least, np.partition(scores, -self.count, axis=1)[:, -self.count])
        slot, place = np.nonzero(allowed & (scores == least[:, None]))
        # Of equal scores the first `count` of a slot are enough, as ids ascend.
        first = np.arange(len(slot)) - np.searchsorted(slot, slot) < self.count
        above = np.nonzero(scores > least[:, None])
        slot, place = np.append(slot[first], above[0]), np.append(place[first], above[1])
        old_slot, old_place = self._filled()
        slots = np.append(slot, old_slot)
        found_ids = np.append(ids[place], self.ids[old_slot, old_place])
        found = np.append(scores[slot, place], self.scores[old_slot, old_place])
        order = np.lexsort((found_ids, ~found, slots))
        slots, found_ids, found = slots[order], found_ids[order], found[order]
        rank = np.arange(len(slots)) - np.searchsorted(slots, slots)
        kept = rank < self.count
        self.ids[slots[kept], rank[kept]] = found_ids[kept]
        self.scores[slots[kept], rank[kept]] = found[kept]
        self.held = np.bincount(slots[kept], minlength=len(self.held))

    def _filled(self) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(np.arange(self.count) < self.held[:, None])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slot, id and score of everything that is held."""
        slot, place = self._filled()
        return slot, self.ids[slot, place], self.scores[slot, place]


def scored_parts(anchors: Rows, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Rows, np.ndarray]]:
    """Candidates in parts small enough that their scores with all anchors may be held, and these scores."""
    size = max(1, HELD // max(1, len(anchors.ids)))
    for batch in batches:
        candidates = read_rows(batch)
        for start in range(0, len(candidates.ids), size):
            part = candidates.take(slice(start, start + size))
            yield part, products(anchors.vectors, part.vectors)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and vector of the rows that take part, one for each vec_id."""
    vector = F.col("embedding").cast("array<double>")
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~broken)
        .groupBy("vec_id")
        .agg(F.max(F.struct("label", "embedding")).alias("row"))
        .select("vec_id", "row.label", F.col("row.embedding").alias("vector"))
    )


def best_positives(rows: DataFrame, anchors: Rows, count: int) -> DataFrame:
    """anchor_id, positive_id, score: the `count` best other rows of each anchor's label."""

    def run(batches):
        best = Best(len(anchors.ids), count)
        for part, scores in scored_parts(anchors, batches):
            same = (anchors.labels[:, None] == part.labels) & (anchors.ids[:, None] != part.ids)
            best.add(part.ids, scores, same)
        slot, ids, scores = best.found()
        yield pa.record_batch([pa.array(anchors.ids[slot]), pa.array(ids), pa.array(scores)], names=["anchor_id", "positive_id", "score"])

    parts = rows.mapInArrow(run, "anchor_id bigint, positive_id bigint, score bigint")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    return parts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)


def best_negatives(rows: DataFrame, anchors: Rows, pairs: pa.Table, count: int, least: int) -> DataFrame:
    """The `count` best rows of another label for each pair of anchor and positive whose score is
    at most the positive's and at least `least` percent of it."""
    anchor_id, positive_id, top = (pairs.column(name).to_numpy() for name in ("anchor_id", "positive_id", "score"))
    anchor = np.searchsorted(anchors.ids, anchor_id)
    low = np.array([max(_LEAST, -(-least * x // 100)) for x in top.tolist()], np.int64)
    # Pair number `turn` of every anchor that has one, so that one matrix of scores serves all of them.
    order = np.lexsort((positive_id, anchor))
    turn = np.empty(len(order), np.int64)
    turn[order] = np.arange(len(order)) - np.searchsorted(anchor[order], anchor[order])
    turns = [np.flatnonzero(turn == number) for number in range(int(turn.max(initial=-1)) + 1)]

    def run(batches):
        best = [Best(len(chosen), count) for chosen in turns]
        for part, scores in scored_parts(anchors, batches):
            other = anchors.labels[:, None] != part.labels
            for chosen, held in zip(turns, best):
                mine = scores[anchor[chosen]]
                held.add(part.ids, mine, other[anchor[chosen]] & (mine <= top[chosen][:, None]) & (mine >= low[chosen][:, None]))
        for chosen, held in zip(turns, best):
            slot, ids, scores = held.found()
            pair = chosen[slot]
            columns = [anchor_id[pair], positive_id[pair], ids, top[pair], scores]
            yield pa.record_batch(list(map(pa.array, columns)), names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    parts = rows.mapInArrow(run, "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mine(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, least: int = 80, block: int = ANCHORS
) -> DataFrame:
    """Hard negatives of the anchors, the rows whose vec_id is divisible by `every`.

    For each anchor and each of its `positives` best rows of the same label: the `negatives`
    best rows of other labels that score at most as the positive and at least `least` percent
    of it. Returns anchor_id, positive_id, rank (from 1), negative_id and both scores.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors), "vectors")
    anchors = rows.where(F.col("vec_id") % every == 0)
    path, blocks = shared_dir(spark, "hard-negatives"), max(1, -(-anchors.count() // block))
    for number in range(blocks):
        part = read_rows(anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).toArrow())
        pairs = best_positives(rows, part, positives).select("anchor_id", "positive_id", "score").toArrow()
        found = best_negatives(rows, part, pairs, negatives, least)
        found.selectExpr(*_COLUMNS).write.parquet(f"{path}/block={number}")
    return spark.read.schema(_RESULT).parquet(*(f"{path}/block={number}" for number in range(blocks)))
