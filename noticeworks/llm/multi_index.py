"""Nearest neighbours by inner product through an inverted multi-index.

A vector is cut into two halves, each quantised by its own centroids; a pair of centroids
is a cell, and the index lists the rows of every cell. A query walks through the cells in
ascending order of summed distance, with a heap over pairs of its two sorted centroid
lists, until the cells it has seen hold enough rows. Those rows are reranked by the inner
product of the original vectors in double precision.

Largest inner product becomes smallest distance by one more component in the second half,
which brings every stored vector to the same length. Centroids are fitted on at most
`SAMPLE_ROWS` vectors; every row is indexed. How many rows a query has to see follows from
the data: for `CALIBRATION` queries the true neighbours are found by brute force, and the
number is chosen so that the share `RECALL` of them lies in cells seen by then.

The index is dealt out in blocks of cells of about `BLOCK_ROWS` rows; a cell with more rows
is split. A query meets only blocks that hold cells it has seen, and each block keeps the
best `k` for each query before anything is merged.

Defined cases: vectors that are null, zero, of another length than most, or hold a null or
non-finite component take no part, nor do null vec_ids; of rows with equal vec_id the
greatest vector counts; with fewer candidates than `k` all are returned; ties go to the
smaller vec_id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.llm.common import list_values, lists, stored

SAMPLE_ROWS = 20_000
CENTROIDS = 64
ROUNDS = 12
CALIBRATION = 100
RECALL = 0.96
BLOCK_ROWS = 8_192
QUERY_ROWS = 4_096
_PAIR = "query_id bigint, vec_id bigint, score double"


def usable(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    rows = (
        embeddings.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
        .where(
            F.col("vec_id").isNotNull()
            & F.expr("forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
            & F.expr("exists(vector, x -> x <> 0)")
        )
        .groupBy("vec_id")
        .agg(F.max("vector").alias("vector"))
    )
    return rows


def matrix(column: pa.Array) -> np.ndarray:
    values, offsets = list_values(column)
    return values.reshape(len(offsets) - 1, -1) if len(offsets) > 1 else values.reshape(0, 0)


def kmeans(points: np.ndarray, count: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Centroids by Lloyd's algorithm from distinct starting points; an emptied centroid keeps its place."""
    distinct = np.unique(points, axis=0)
    dice = np.random.default_rng(seed)
    centroids = distinct[dice.permutation(len(distinct))[:count]]
    for _ in range(rounds):
        nearest = closest(points, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        sizes = np.bincount(nearest, minlength=len(centroids))
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return centroids


def closest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of every point, ties to the smaller number."""
    lengths = (centroids * centroids).sum(1)
    return np.concatenate(
        [np.argmin(lengths - 2 * points[a : a + 4096] @ centroids.T, axis=1) for a in range(0, len(points), 4096)]
        or [np.zeros(0, np.int64)]
    )


@dataclass
class Index:
    """Centroids of both halves, where the cut lies, and the longest vector's squared length."""

    first: np.ndarray
    second: np.ndarray
    width: int
    longest: float

    def halves(self, vectors: np.ndarray, query: bool = False) -> tuple[np.ndarray, np.ndarray]:
        cut = self.width // 2
        missing = np.zeros(len(vectors)) if query else np.maximum(self.longest - (vectors * vectors).sum(1), 0)
        return vectors[:, :cut], np.column_stack([vectors[:, cut:], np.sqrt(missing)])

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        one, two = self.halves(vectors)
        return closest(one, self.first) * len(self.second) + closest(two, self.second)

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for half, centroids in zip(self.halves(vectors, query=True), (self.first, self.second)):
            found.append((half * half).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * half @ centroids.T)
        return found[0], found[1]


def walk(one: np.ndarray, two: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Cells with rows in ascending order of summed distance until they hold `enough` rows."""
    order_one, order_two = np.argsort(one, kind="stable").tolist(), np.argsort(two, kind="stable").tolist()
    one, two, sizes = one[order_one].tolist(), two[order_two].tolist(), sizes.tolist()
    width, seen, held = len(two), [], 0
    heap = [(one[0] + two[0], 0, 0)]
    reached = [-1] * len(one)  # per place in the first list, the last place in the second that was taken
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        reached[i] = j
        cell = order_one[i] * width + order_two[j]
        if sizes[cell]:
            seen.append(cell)
            held += sizes[cell]
        if i + 1 < len(one) and (reached[i + 1] == j - 1):
            heapq.heappush(heap, (one[i + 1] + two[j], i + 1, j))
        if j + 1 < width and (i == 0 or reached[i - 1] >= j + 1):
            heapq.heappush(heap, (one[i] + two[j + 1], i, j + 1))
    return seen


def best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, vec_ids: np.ndarray, allowed, k: int):
    """The k best allowed candidates of each query: arrays of query_id, vec_id and score.

    A product of matrices finds who may be among them, with room for rounding; the scores
    are then summed pair by pair, in the same order for equal vectors, and decide.
    """
    order = np.argsort(vec_ids, kind="stable")
    vectors, vec_ids = vectors[order], vec_ids[order]
    lengths = np.sqrt((vectors * vectors).sum(1).max(initial=0))
    out = []
    for start in range(0, len(queries), 128):
        part, part_ids = queries[start : start + 128], query_ids[start : start + 128]
        rough = part @ vectors.T
        rough[~allowed(start, start + len(part))[:, order] | (part_ids[:, None] == vec_ids)] = -np.inf
        bound = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(part), -np.inf)
        slack = 1e-9 * (1 + np.sqrt((part * part).sum(1)) * lengths)
        query, candidate = np.nonzero((rough >= (bound - slack)[:, None]) & np.isfinite(rough))
        score = (part[query] * vectors[candidate]).sum(1)
        ranked = np.lexsort((vec_ids[candidate], -score, query))
        query, candidate, score = query[ranked], candidate[ranked], score[ranked]
        first = np.searchsorted(query, query, side="left")
        kept = np.arange(len(query)) - first < k
        out.append((part_ids[query[kept]], vec_ids[candidate[kept]], score[kept]))
    return [np.concatenate(column) for column in zip(*out)] if out else [np.zeros(0, t) for t in (np.int64, np.int64, float)]


def build(vectors: DataFrame, sample_rows: int = SAMPLE_ROWS, centroids: int = CENTROIDS) -> Index | None:
    """Fits the centroids on a bounded sample; None where there is no vector."""
    total, longest = vectors.agg(F.count(F.lit(1)), F.max(F.expr("aggregate(vector, 0D, (a, x) -> a + x * x)"))).first()
    if not total:
        return None
    chosen = F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(1 << 30)) < F.lit(int(min(1.0, sample_rows / total) * (1 << 30)))
    sample = vectors.where(chosen).limit(sample_rows).toArrow().combine_chunks().sort_by("vec_id")
    if not sample.num_rows:
        sample = vectors.limit(sample_rows).toArrow().combine_chunks().sort_by("vec_id")
    points = matrix(sample.column("vector").combine_chunks())
    index = Index(np.zeros((0, 0)), np.zeros((0, 0)), points.shape[1], float(longest))
    one, two = index.halves(points)
    index.first, index.second = kmeans(one, centroids), kmeans(two, centroids, seed=4)
    return index


def indexed(vectors: DataFrame, index: Index) -> DataFrame:
    """vec_id, vector and cell of every row, stored."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cells = index.cells(matrix(batch.column(1)))
                yield pa.record_batch([*batch.columns, pa.array(cells, pa.int32())], names=["vec_id", "vector", "cell"])

    return stored(vectors.mapInArrow(run, "vec_id bigint, vector array<double>, cell int"), "multi-index")


def top(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all blocks, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def brute_force(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The true neighbours of a bounded set of queries (query_id, vector): each task keeps its k best."""
    table = queries.toArrow().combine_chunks()
    ids, points = table.column("query_id").to_numpy(), matrix(table.column("vector").combine_chunks())

    def run(batches):
        for batch in batches:
            if batch.num_rows and len(ids):
                vectors, vec_ids = matrix(batch.column(1)), batch.column(0).to_numpy()
                every = lambda a, b: np.ones((b - a, len(vec_ids)), bool)
                yield pa.record_batch(
                    list(map(pa.array, best(points, ids, vectors, vec_ids, every, k))), names=["query_id", "vec_id", "score"]
                )

    return top(rows.select("vec_id", "vector").mapInArrow(run, _PAIR), k)


def calibrate(rows: DataFrame, index: Index, sizes: np.ndarray, k: int, every: int, recall: float, count: int = CALIBRATION) -> int:
    """How many rows a query has to see for the given share of its true neighbours."""
    total = int(sizes.sum())
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector")
    asked = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(count)
    asked = stored(asked, "calibration")
    true = brute_force(asked, rows, k).join(rows.select("vec_id", "cell"), "vec_id").select("query_id", "cell").collect()
    if not true:
        return total
    table = asked.toArrow().combine_chunks()
    points = matrix(table.column("vector").combine_chunks())
    wanted: dict[int, list[int]] = {}
    for row in true:
        wanted.setdefault(row.query_id, []).append(row.cell)
    needed = []
    for query_id, one, two in zip(table.column("query_id").to_pylist(), *index.distances(points)):
        cells = walk(one, two, sizes, total)
        before = dict(zip(cells, np.cumsum(sizes[cells]) - sizes[cells]))
        needed += [int(before[cell]) + 1 for cell in wanted.get(query_id, [])]
    return int(np.quantile(needed, recall, method="higher"))


def blocks_of(sizes: np.ndarray, rows: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: small cells share a block, large ones get several."""
    first, count, block, held = np.zeros(len(sizes), np.int32), np.ones(len(sizes), np.int32), 0, 0
    for cell, size in enumerate(sizes.tolist()):
        if held and held + size > rows:
            block, held = block + 1, 0
        first[cell] = block
        if size > rows:
            count[cell] = -(-size // rows)
            block += int(count[cell])
        else:
            held += size
    return first, count


def search(embeddings: DataFrame, k: int = 20, every: int = 20, recall: float = RECALL) -> DataFrame:
    """The k nearest of each query (rows whose vec_id is divisible by `every`), among all other rows.

    Returns query_id, rank (from 1), vec_id and score.
    """
    spark = embeddings.sparkSession
    vectors = usable(embeddings)
    width = vectors.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    index = build(vectors.where(F.size("vector") == width.width)) if width else None
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = indexed(vectors.where(F.size("vector") == width.width), index)
    # One number for each cell: CENTROIDS squared at most.
    sizes = np.zeros(len(index.first) * len(index.second), np.int64)
    for row in rows.groupBy("cell").count().collect():
        sizes[row.cell] = row["count"]
    enough = calibrate(rows, index, sizes, k, every, recall) + k + 1
    first, count = blocks_of(sizes)

    def visits(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vectors = batch.column(0).to_pylist(), matrix(batch.column(1))
            out = []
            for query_id, vector, one, two in zip(ids, vectors, *index.distances(vectors)):
                met: dict[int, list[int]] = {}
                for cell in walk(one, two, sizes, enough):
                    for part in range(count[cell]):
                        met.setdefault(int(first[cell]) + part, []).append(cell)
                out += [(query_id, vector, block, cells) for block, cells in met.items()]
            yield pa.record_batch(
                [
                    pa.array([row[0] for row in out], pa.int64()),
                    lists(np.concatenate([row[1] for row in out]), [len(row[1]) for row in out]),
                    pa.array([row[2] for row in out], pa.int32()),
                    pa.array([row[3] for row in out], pa.list_(pa.int32())),
                ],
                names=["query_id", "vector", "block", "cells"],
            )

    asked = rows.where(F.col("vec_id") % every == 0)
    parts = max(1, -(-asked.count() // QUERY_ROWS))
    part = F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(parts)).cast("int")
    queries = (
        asked.select("vec_id", "vector")
        .mapInArrow(visits, "query_id bigint, vector array<double>, block int, cells array<int>")
        .withColumn("part", part)
    )
    first_of, count_of = F.lit(first.tolist()), F.lit(count.tolist())
    block = F.element_at(first_of, F.col("cell") + 1) + F.pmod(
        F.xxhash64("vec_id", F.lit(2)), F.element_at(count_of, F.col("cell") + 1)
    ).cast("int")
    candidates = rows.withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        if not left.num_rows or not right.num_rows:
            found = best(np.zeros((0, 1)), np.zeros(0), np.zeros((0, 1)), np.zeros(0), None, k)
        else:
            cells = left.column("cell").to_numpy()
            kinds, place = np.unique(cells, return_inverse=True)
            seen, offsets = list_values(right.column("cells").combine_chunks())

            def allowed(a, b):
                visited = np.zeros((b - a, len(kinds)), bool)
                rows = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
                at = np.searchsorted(kinds, seen[offsets[a] : offsets[b]])
                inside = at < len(kinds)
                rows, at, wanted = rows[inside], at[inside], seen[offsets[a] : offsets[b]][inside]
                visited[rows[kinds[at] == wanted], at[kinds[at] == wanted]] = True
                return visited[:, place]

            found = best(
                matrix(right.column("vector").combine_chunks()),
                right.column("query_id").to_numpy(),
                matrix(left.column("vector").combine_chunks()),
                left.column("vec_id").to_numpy(),
                allowed,
                k,
            )
        return pa.table(
            [pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())],
            names=["query_id", "vec_id", "score"],
        )

    met = (
        candidates.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInArrow(rerank, _PAIR)
    )
    return top(met, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
