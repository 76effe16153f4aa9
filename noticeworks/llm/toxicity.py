"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a character n-gram (of the lower-cased text, hashed into
`BUCKETS`). Its naive Bayes log-count ratio is the logarithm of how much more often toxic
texts hold it than others. Presence times ratio goes into a logistic regression. The
model is fitted on at most `SAMPLE_ROWS` labelled texts, the rarer class first: their
n-grams are counted by a Spark aggregation, the `FEATURES` most telling ones are kept, and
the regression runs on those; its bias is then set back to the shares that the classes have
among all labels. Every whole text is scored where it lies, without a shuffle, in windows
of bounded size.

Defined cases: a null or empty text holds no n-gram and gets the score of the bias alone;
repeated rows are scored each by itself; without labels of both classes every score is the
number of toxic labels over the number of labels plus one; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.llm.common import blocks, list_values, lists, texts
from noticeworks.llm.labelled import at_most_by_class, fold, label_rows

#: Labelled texts at most that the model is fitted on.
SAMPLE_ROWS = 16_000
#: N-grams at most that the regression sees.
FEATURES = 4_096
ORDERS = (3, 4, 5)
BITS = 20
BUCKETS = 1 << BITS
FOLDS, HELD_OUT = 5, 0
#: An n-gram that occurs in one or two texts of the sample tells of these texts only.
LEAST_TEXTS = 3
#: Weight of the quadratic penalty.
PENALTY = 1e-4
#: Bytes of text that are worked on at once, and characters that are hashed at once.
BLOCK = 1 << 19
WINDOW = 1 << 17


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def windows(rows: list[bytes]):
    """Rows and texts of pieces, about `WINDOW` characters at once.

    A mark ends each text, so the last n-grams of a text differ from the same inside it. A
    long text is cut into pieces that share the n-grams across the cut.
    """
    owner, pieces, held = [], [], 0
    for row, text in enumerate(rows):
        lowered = text.decode("utf-8").lower() + "\0"
        for start in range(0, len(lowered), WINDOW):
            piece = lowered[start : start + WINDOW + max(ORDERS) - 1]
            owner.append(row)
            pieces.append(piece)
            held += len(piece)
            if held >= WINDOW:
                yield owner, pieces
                owner, pieces, held = [], [], 0
    if pieces:
        yield owner, pieces


def grams(owner: list[int], pieces: list[str]):
    """For each order: the row and the bucket of every character n-gram of some pieces."""
    codes = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4").astype(np.uint64)
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), list(map(len, pieces)))
    row = np.array(owner, np.int32)[piece]
    mixed = codes * np.uint64(0x9E3779B97F4A7C15)
    for order in range(2, max(ORDERS) + 1):
        if len(codes) < order:
            return
        mixed = (mixed[: len(codes) - order + 1] ^ (mixed[: len(codes) - order + 1] >> np.uint64(29)) ^ codes[order - 1 :]) * np.uint64(
            0xBF58476D1CE4E5B9
        )
        if order in ORDERS:
            whole = piece[: len(mixed)] == piece[order - 1 :]
            yield row[: len(mixed)][whole], (mixed >> np.uint64(64 - BITS)).astype(np.int32)[whole]


def present(rows: list[bytes], feature: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row and feature, each once; `feature` gives a bucket's feature or -1, else buckets are features."""
    pairs = [np.zeros(0, np.int64)]
    for owner, pieces in windows(rows):
        for row, number in grams(owner, pieces):
            if feature is not None:
                number = feature[number]
                row, number = row[number >= 0], number[number >= 0]
            pairs.append(np.unique(row.astype(np.int64) << 32 | number))
    found = np.unique(np.concatenate(pairs))
    return found >> 32, found & 0xFFFFFFFF


def feature_table(buckets: np.ndarray) -> np.ndarray:
    table = np.full(BUCKETS, -1, np.int32)
    table[buckets] = np.arange(len(buckets))
    return table


def count_grams(sample: DataFrame) -> DataFrame:
    """bucket, toxic, clean: in how many texts of each class a bucket occurs."""

    def run(batches):
        counts = np.zeros((2, BUCKETS), np.int32)
        for block in blocks(batches, "text", BLOCK):
            labels = block.column(1).to_numpy(zero_copy_only=False)
            for label, text in zip(labels.tolist(), texts(block.column(0))):
                counts[label, present([text])[1]] += 1
        seen = np.flatnonzero(counts.any(axis=0))
        columns = [seen, counts[1, seen].astype(np.int64), counts[0, seen].astype(np.int64)]
        yield pa.record_batch(list(map(pa.array, columns)), names=["bucket", "toxic", "clean"])

    parts = sample.select("text", "label").mapInArrow(run, "bucket bigint, toxic bigint, clean bigint")
    return parts.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def regression(row: np.ndarray, feature: np.ndarray, scale: np.ndarray, labels: np.ndarray, steps: int = 300):
    """Weights and bias of a logistic regression on presence times scale, with a quadratic penalty."""
    count, weights, bias = len(labels), np.zeros(len(scale)), 0.0
    values = scale[feature]
    first, second = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for step in range(1, steps + 1):
        margin = np.bincount(row, weights=values * weights[feature], minlength=count) + bias
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) / count
        slope = np.append(np.bincount(feature, weights=values * error[row], minlength=len(scale)) + PENALTY * weights, error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        change = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        weights, bias = weights - change[:-1], bias - change[-1]
    return weights, bias


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learns from at most `rows` labelled texts; only counts of `FEATURES` n-grams and the
    presence of these in the sample reach the driver."""
    chosen, drawn = at_most_by_class(label_rows(labels, "toxic", FOLDS, HELD_OUT), rows, seed=2)
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")
    sizes = {row.label: row.n for row in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        share = max(toxic / (toxic + clean + 1), 1e-9)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    p, q = (F.col("toxic") + 1) / (toxic + 2), (F.col("clean") + 1) / (clean + 2)
    mean = (F.col("toxic") + F.col("clean") + 1) / (toxic + clean + 2)
    gain = F.col("toxic") * F.log(p / mean) + F.col("clean") * F.log(q / mean)
    best = (
        count_grams(sample)
        .where(F.col("toxic") + F.col("clean") >= LEAST_TEXTS)
        .select("bucket", F.log(p / q).alias("ratio"), gain.alias("gain"))
        .orderBy(F.desc("gain"), "bucket")
        .limit(FEATURES)
        .collect()
    )
    buckets = np.array([row.bucket for row in best], np.int64)
    ratio = np.array([row.ratio for row in best])

    def run(batches):
        table = feature_table(buckets)
        for block in blocks(batches, "text", BLOCK):
            row, feature = present(texts(block.column(0)), table)
            yield pa.record_batch(
                [block.column(1), lists(feature.astype(np.int32), np.bincount(row, minlength=block.num_rows))],
                names=["label", "features"],
            )

    matrix = sample.select("text", "label").mapInArrow(run, "label int, features array<int>").toArrow()
    feature, offsets = list_values(matrix.column("features").combine_chunks())
    row = np.repeat(np.arange(matrix.num_rows), np.diff(offsets))
    known = matrix.column("label").to_numpy()
    # Rows come in any order; sums in the order of their content make the weights repeatable.
    order = np.lexsort((np.bincount(row, weights=feature, minlength=len(known)), np.diff(offsets), known))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    weights, bias = regression(place[row], feature, ratio, known[order])
    return Model(buckets, weights * ratio, bias + float(np.log(drawn[0] / drawn[1])))


def scorer(model: Model):
    """A function from texts to scores between 0 and 1."""
    table = feature_table(model.buckets)

    def score(rows: list[bytes]) -> np.ndarray:
        row, feature = present(rows, table)
        margin = np.bincount(row, weights=model.weights[feature], minlength=len(rows)) + model.bias
        return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))

    return score


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""

    def run(batches):
        score = scorer(model)
        for block in blocks(batches, "text", BLOCK):
            yield pa.record_batch([block.column(0), pa.array(score(texts(block.column(1))))], names=["doc_id", "score"])

    rows = documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return rows.select(
        "doc_id",
        F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def clean_rows(documents: DataFrame, model: Model) -> DataFrame:
    """The documents that the model doesn't call toxic, with all their columns; nothing is shuffled."""

    def run(batches):
        score = scorer(model)
        for block in blocks(batches, "text", BLOCK):
            column = block.column(block.schema.get_field_index("text"))
            yield block.filter(pa.array(score(texts(column)) < 0.5))

    return documents.mapInArrow(run, documents.schema)
