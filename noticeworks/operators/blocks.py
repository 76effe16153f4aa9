"""Tenders and providers that share a code, met in blocks of bounded size.

Pairs grow with tenders times suppliers, so they never become rows. Both sides are dealt by
code, a common code in a grid of blocks, and a task looks at one block of each: which pairs
pass is a matrix of booleans, and only a count or the best of each provider leaves the task.
A pair that shares several codes counts on the smallest, so it stands in one block only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions import codes
from noticeworks.session import shared_dir, ship_package

# Rows of a block, and pairs of a block that are looked at together.
TENDERS, PROVIDERS, CELLS = 65536, 16384, 1 << 22
# Codes of fewer rows than this are dealt together into so many groups.
RARE, TOGETHER = 1024, 128
_UNBOUNDED = np.iinfo(np.int64)


def _cents(amount: Column) -> Column:
    return amount.cast("decimal(24,6)") * 100


def tender_side(tenders: DataFrame, *columns: str | Column) -> DataFrame:
    """What the hard filters look at, and the columns given."""
    return tenders.select(
        "expediente",
        codes.normalize_codes(F.col("cpv_codes")).alias("codes"),
        _cents(F.col("budget_with_vat")).cast("bigint").alias("cents"),
        "location",
        *columns,
    )


def provider_side(providers: DataFrame, *columns: str | Column) -> DataFrame:
    return providers.select(
        "provider_id",
        codes.normalize_codes(F.col("cpv_codes")).alias("p_codes"),
        F.ceil(_cents(F.col("min_budget"))).cast("bigint").alias("low"),
        F.floor(_cents(F.col("max_budget"))).cast("bigint").alias("high"),
        "locations",
        *columns,
    )


def _stored(frame: DataFrame, label: str) -> DataFrame:
    path = shared_dir(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def meet(tenders: DataFrame, providers: DataFrame, work: Callable[[Block], pa.Table], schema: str) -> DataFrame:
    """The rows that `work` makes of every block.

    Both sides are stored first: they are read for the sizes of codes and again for the blocks.
    The sizes are stored as well: then Spark knows them to be small, where they are, before it
    plans their joins, and the rows move only once, to their blocks.
    """
    ship_package(tenders.sparkSession)
    left = _stored(tenders, "tenders").withColumn("code", F.explode("codes"))
    right = _stored(providers, "providers").withColumn("code", F.explode("p_codes"))
    count = F.count("*")
    sizes = left.groupBy("code").agg(count.alias("n")).join(right.groupBy("code").agg(count.alias("p_n")), "code")
    sizes = _stored(sizes, "sizes")
    rare = F.concat(F.lit("#"), F.pmod(F.xxhash64("code"), F.lit(TOGETHER)).cast("string"))
    blocks = lambda rows, size: F.ceil(F.col(rows) / size).cast("int")
    every = lambda rows, size: F.explode(F.sequence(F.lit(0), blocks(rows, size) - 1))
    dealt = lambda key, rows, size: F.pmod(F.xxhash64(key), blocks(rows, size)).cast("int")
    group = F.when(F.col("n") + F.col("p_n") < RARE, rare).otherwise(F.concat(F.lit("="), "code"))
    left = (
        left.join(sizes, "code")
        .withColumn("group", group)
        .withColumn("t_block", dealt("expediente", "n", TENDERS))
        .withColumn("p_block", every("p_n", PROVIDERS))
    )
    right = (
        right.join(sizes, "code")
        .withColumn("group", group)
        .withColumn("t_block", every("n", TENDERS))
        .withColumn("p_block", dealt("provider_id", "p_n", PROVIDERS))
    )
    grid = ["group", "t_block", "p_block"]

    def run(some: pa.Table, others: pa.Table) -> pa.Table:
        theirs = _by_code(others)
        found = [work(Block(part, theirs[code])) for code, part in _by_code(some).items() if code in theirs]
        return pa.concat_tables(found or [work(Block(some.slice(0, 0), others.slice(0, 0)))])

    left, right = (side.drop("n", "p_n").groupBy(*grid) for side in (left, right))
    return left.cogroup(right).applyInArrow(run, schema)


def _by_code(rows: pa.Table) -> dict[str, pa.Table]:
    """The rows of each code."""
    if not rows.num_rows:
        return {}
    ordered = rows.take(pc.sort_indices(rows["code"])).combine_chunks()
    codes_, starts = np.unique(ordered["code"].to_numpy(), return_index=True)
    ends = np.append(starts[1:], ordered.num_rows)
    return {code: ordered.slice(a, b - a) for code, a, b in zip(codes_, starts.tolist(), ends.tolist())}


def flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of all lists of a column, and the row of each."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.repeat(np.arange(len(column)), lengths)


def numbered(*columns: pa.Array) -> list[np.ndarray]:
    """Whole numbers that are equal where the values are; null is -1."""
    alike = pa.concat_arrays([column.cast(pa.large_string()) for column in columns]).dictionary_encode()
    found = pc.fill_null(alike.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(found, np.cumsum([len(column) for column in columns])[:-1])


def grouped(numbers: np.ndarray, rows: np.ndarray) -> dict[int, np.ndarray]:
    """The rows of each number."""
    order = np.argsort(numbers, kind="stable")
    values, starts = np.unique(numbers[order], return_index=True)
    return dict(zip(values.tolist(), np.split(rows[order], starts[1:])))


def _whole(column: pa.Array, missing: int) -> np.ndarray:
    return pc.fill_null(column, missing).to_numpy(zero_copy_only=False)


class Block:
    """Tenders, by key, and providers of one code."""

    def __init__(self, tenders: pa.Table, providers: pa.Table):
        if tenders.num_rows:
            tenders = tenders.take(pc.sort_indices(tenders["expediente"]))
        self._tenders, self._providers = tenders, providers
        self.n_tenders, self.n_providers = tenders.num_rows, providers.num_rows
        self.empty = not (self.n_tenders and self.n_providers)
        if not self.empty:
            self._prepare()

    def tender(self, name: str) -> pa.Array:
        return _joined(self._tenders[name])

    def provider(self, name: str) -> pa.Array:
        return _joined(self._providers[name])

    def _prepare(self) -> None:
        cents = self.tender("cents")
        self._cents, self._no_budget = _whole(cents, 0), np.flatnonzero(cents.is_null().to_numpy(zero_copy_only=False))
        low, high = self.provider("low"), self.provider("high")
        self._low, self._high = _whole(low, _UNBOUNDED.min), _whole(high, _UNBOUNDED.max)
        self._unbounded = (low.is_null().to_numpy(zero_copy_only=False)) & (high.is_null().to_numpy(zero_copy_only=False))
        accepted, owner = flat(self.provider("locations"))
        place, wanted = numbered(self.tender("location"), accepted)
        # One column per place, the last for tenders without one; null places in a list match nothing.
        self._place = place
        self._near = np.zeros((self.n_providers, max(place.max(), wanted.max(initial=-1)) + 2), bool)
        self._near[owner[wanted >= 0], wanted[wanted >= 0]] = True
        restricted = np.zeros(self.n_providers, bool)
        restricted[owner] = True
        self._near[~restricted] = True
        # Where the two meet on an earlier code.
        code = self._tenders["code"][0]
        earlier = []
        for column in (self.tender("codes"), self.provider("p_codes")):
            values, rows = flat(column)
            kept = pc.fill_null(pc.less(values, code), False).to_numpy(zero_copy_only=False)
            earlier.append((values.filter(pa.array(kept)), rows[kept]))
        some, others = numbered(earlier[0][0], earlier[1][0])
        tender_rows, provider_rows = grouped(some, earlier[0][1]), grouped(others, earlier[1][1])
        self._met = [(provider_rows[c], tender_rows[c]) for c in tender_rows if c in provider_rows]

    def slices(self) -> Iterator[tuple[int, int]]:
        step = max(1, CELLS // max(1, self.n_tenders))
        for first in range(0, 0 if self.empty else self.n_providers, step):
            yield first, min(first + step, self.n_providers)

    def first_met(self, a: int, b: int) -> np.ndarray:
        """Which pairs of providers a to b share no smaller code."""
        first = np.ones((b - a, self.n_tenders), bool)
        for providers, tenders in self._met:
            at, end = np.searchsorted(providers, (a, b))
            if end > at:
                first[np.ix_(providers[at:end] - a, tenders)] = False
        return first

    def in_budget(self, a: int, b: int) -> np.ndarray:
        fits = (self._cents >= self._low[a:b, None]) & (self._cents <= self._high[a:b, None])
        fits[:, self._no_budget] = self._unbounded[a:b, None]
        return fits

    def in_place(self, a: int, b: int) -> np.ndarray:
        return np.take(self._near[a:b], self._place, axis=1)

    def passing(self, a: int, b: int) -> np.ndarray:
        return self.first_met(a, b) & self.in_budget(a, b) & self.in_place(a, b)


def _joined(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)


def near_best(scores: np.ndarray, passing: np.ndarray, k: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of all passing pairs not more than `margin` below a row's k-th highest score."""
    held = np.where(passing, scores, -np.inf)
    if held.shape[1] > k:
        least = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
        passing = passing & (held >= (least - margin)[:, None])
    return np.nonzero(passing)


def first_of_row(rows: np.ndarray, k: int) -> np.ndarray:
    """Which of rows that are in order are among the first k of their number."""
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    lengths = np.diff(np.r_[starts, len(rows)])
    return np.arange(len(rows)) - np.repeat(starts, lengths) < k


class TermScores:
    """Summed weights of shared terms over the number of query terms, in the order of the terms."""

    def __init__(self, block: Block):
        title_terms = block.tender("title_terms")
        terms, rows = flat(title_terms)
        queried, owner = flat(block.provider("query_terms"))
        weights = block.tender("title_weights").flatten().to_numpy(zero_copy_only=False)
        alike_titles, self._title = _folded(numbered(terms)[0], rows, block.n_tenders, weights)
        alike_queries, self._query = _folded(numbered(queried)[0], owner, block.n_providers)
        self._n_titles, self._n_queries = alike_titles.sum(), alike_queries.sum()
        number = lambda alike: np.where(alike, np.cumsum(alike) - 1, -1)
        title_number, query_number = number(alike_titles), number(alike_queries)
        here, there = alike_titles[rows], alike_queries[owner]
        terms, queried = terms.filter(pa.array(here)), queried.filter(pa.array(there))
        titles, queries, weights = title_number[rows[here]], query_number[owner[there]], weights[here]
        self._size = np.bincount(queries, minlength=self._n_queries)
        some, others = numbered(terms, queried)
        posted, asked = grouped(some, np.arange(len(some))), grouped(others, queries)
        names = {}
        for number_of, place in zip(some.tolist(), range(len(some))):
            names.setdefault(number_of, place)
        shared = sorted((c for c in posted if c in asked), key=lambda c: terms[names[c]].as_py().encode())
        self._shared = [(asked[c], titles[posted[c]], weights[posted[c]]) for c in shared]

    def of(self, a: int, b: int) -> np.ndarray:
        queries, which = np.unique(self._query[a:b], return_inverse=True)
        place = np.full(self._n_queries, -1)
        place[queries] = np.arange(len(queries))
        sums = np.zeros((len(queries), self._n_titles))
        for asked, titles, weights in self._shared:
            rows = place[asked]
            rows = rows[rows >= 0]
            if len(rows):
                sums[np.ix_(rows, titles)] += weights
        sums /= np.maximum(self._size[queries], 1)[:, None]
        return np.take(sums[which], self._title, axis=1)


def _folded(numbers: np.ndarray, rows: np.ndarray, count: int, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the first with their list, and for each row the place of that among those."""
    ends = np.cumsum(np.bincount(rows, minlength=count)).tolist()
    seen: dict[bytes, int] = {}
    first, place = np.zeros(count, bool), np.zeros(count, np.int64)
    start = 0
    for row, end in enumerate(ends):
        key = b"".join(part[start:end].tobytes() for part in (numbers, *more))
        if key not in seen:
            seen[key], first[row] = len(seen), True
        place[row], start = seen[key], end
    return first, place


class VectorScores:
    """Inner products: first near ones for all pairs, then those of chosen pairs summed place by place."""

    def __init__(self, block: Block):
        self._tenders, self.tender_has = _vectors(block.tender("embedding"), block.tender("vector_norm"))
        self._providers, self.provider_has = _vectors(block.provider("p_embedding"), block.provider("p_norm"))
        if not (self.tender_has.any() and self.provider_has.any()):
            self._tenders, self._providers = np.zeros((block.n_tenders, 0)), np.zeros((block.n_providers, 0))

    def of(self, a: int, b: int) -> np.ndarray:
        return self._providers[a:b] @ self._tenders.T

    def present(self, a: int, b: int) -> np.ndarray:
        return self.provider_has[a:b, None] & self.tender_has

    def exactly(self, providers: np.ndarray, tenders: np.ndarray, at_once: int = 65536) -> np.ndarray:
        total = np.zeros(len(providers))
        for start in range(0, len(providers), at_once):
            some = slice(start, start + at_once)
            products = (self._providers[providers[some]] * self._tenders[tenders[some]]).T.copy()
            for part in products:
                total[some] += part
        return total


def _vectors(column: pa.Array, norms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one dimension, scaled to length one, as a matrix, and which rows have one."""
    has = column.is_valid().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    matrix = np.zeros((len(column), len(values) // max(1, int(has.sum()))))
    if has.any():
        lengths = norms.to_numpy(zero_copy_only=False)[has]
        matrix[has] = values.reshape(len(lengths), -1).astype(np.float64) / lengths[:, None]
    return matrix, has
