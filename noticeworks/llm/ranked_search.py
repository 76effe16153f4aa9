"""Ranked lexical search of a whole corpus for each of many items, by presence-mask grouping.

An item is the set of the distinct terms of its text. Every document is turned into the
counts of the items' terms in it (one pass, stored); the number of documents, their length
and each term's document count come from that by aggregation. The search is a second pass:
a task takes a block of documents, turns the postings of an item's terms into bitmaps over
the block, and reads them the other way, which gives each document the mask of the terms it
holds. Documents of one mask form a group. No document of a group scores above the sum of
its terms' greatest impacts in the block; groups are taken by that sum, highest first, and
a block is finished with an item once the next sum lies below the item's score at rank k so
far. Only the best k of each task are shuffled and merged. The result is exact.

Items are taken in blocks of about `PAIRS` (item, term) pairs, whose terms and weights are
handed to the tasks; each block of items is one pass over the documents.

Defined cases: a null text, or one without terms, holds nothing and isn't counted as a
document; rows with equal doc_id are documents of their own; a null doc_id is returned as
null, after others of the same score; rows with one item_id are one item with the terms of
all; a null item_id takes no part; an item without matches gives no row; ties go to the
smaller doc_id; texts of any length are read in pieces; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.llm.common import blocks, list_values, lists, stored, texts
from noticeworks.session import shared_dir

#: Pairs of item and term in one block of items, about.
PAIRS = 200_000
#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: Documents of a block, and its documents times an item's terms, at most.
BLOCK_DOCUMENTS = 4_096
CELLS = 1 << 22
#: Documents that are scored before the first look at the next group's bound.
FIRST_LOOK = 64

_KEPT = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Bytes of terms as they are, A-Z lower-cased, all others a space.
_TERM_BYTES = bytes((byte + 32 if 0x41 <= byte <= 0x5A else byte) if byte in _KEPT else 0x20 for byte in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, in lists of bounded size."""
    start = 0
    while start < len(text):
        piece = text[start : start + PIECE].translate(_TERM_BYTES)
        if start + PIECE < len(text):
            cut = piece.rfind(b" ")
            while cut < 0:  # one term longer than a piece
                more = text[start + len(piece) : start + len(piece) + PIECE].translate(_TERM_BYTES)
                space = more.find(b" ")
                cut = len(piece) + space if space >= 0 else (-1 if more else len(piece))
                piece += more
            piece = piece[: cut + 1] if cut < len(piece) else piece
        start += len(piece)
        yield piece.split()


def item_terms(items: DataFrame, text: str = "text") -> DataFrame:
    """item_id and term (bytes): each term of each item once."""

    def run(batches):
        for block in blocks(batches, "text"):
            found = [
                (item, term)
                for item, body in zip(block.column(0).to_pylist(), texts(block.column(1)))
                for term in {term for part in terms(body) for term in part}
            ]
            yield pa.record_batch(
                [pa.array([row[0] for row in found], pa.int64()), pa.array([row[1] for row in found], pa.binary())],
                names=["item_id", "term"],
            )

    rows = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "item_id bigint, term binary").distinct()


def counted(documents: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers in `vocabulary`, ascending) and counts of every document."""

    def run(batches):
        number = {term: place for place, term in enumerate(vocabulary)}
        for block in blocks(batches, "text"):
            sizes, found, occurrences = [], [], []
            for body in texts(block.column(1)):
                size, here = 0, []
                for part in terms(body):
                    size += len(part)
                    here.append(np.array([place for place in map(number.get, part) if place is not None], np.int32))
                place, count = np.unique(np.concatenate(here or [np.zeros(0, np.int32)]), return_counts=True)
                sizes.append(size)
                found.append(place)
                occurrences.append(count)
            lengths = list(map(len, found))
            yield pa.record_batch(
                [
                    block.column(0),
                    pa.array(sizes, pa.int64()),
                    lists(np.concatenate(found).astype(np.int32), lengths),
                    lists(np.concatenate(occurrences).astype(np.int64), lengths),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, counts array<bigint>")


def document_counts(postings: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of the `size` terms stands."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(list_values(batch.column(0))[0], minlength=size)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["term", "n"])

    found = postings.select("terms").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return counts


@dataclass
class Query:
    """A block of items: their ids, the term numbers of each, the weight of each term, and the corpus' size."""

    ids: list[int]
    members: list[np.ndarray]
    weights: np.ndarray
    documents: int
    length: int


class Block:
    """Documents of a block with their postings in order of term."""

    def __init__(self, query: Query, doc_ids: pa.Array, n: np.ndarray, found: np.ndarray, counts: np.ndarray, starts: np.ndarray):
        missing = doc_ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.missing = missing
        owner = np.repeat(np.arange(len(n)), np.diff(starts))
        # m is at least 10; the length of a corpus with a posting is above zero.
        m = 100 - 90 + 90 * n * query.documents // max(query.length, 1)
        impact = 1_000_000_000 * counts // (1000 * counts + 8 * m[owner])
        order = np.argsort(found, kind="stable")
        self.owner, self.impact = owner[order], impact[order]
        self.first = np.searchsorted(found[order], np.arange(len(query.weights) + 1))
        self.greatest = np.zeros(len(query.weights), np.int64)
        held = np.flatnonzero(np.diff(self.first))
        if len(held):
            self.greatest[held] = np.maximum.reduceat(self.impact, self.first[held])


def masks(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of documents by mask and where each mask begins in it, from bitmaps: a row per term, a column per document."""
    words = -(-present.shape[0] // 64)
    packed = np.zeros((present.shape[1], words * 8), np.uint8)
    packed[:, : -(-present.shape[0] // 8)] = np.packbits(present, axis=0).T
    mask = packed.view(np.uint64).T
    order = np.lexsort(mask)
    changed = (np.diff(mask[:, order], axis=1) != 0).any(axis=0)
    return order, np.concatenate([[0], np.flatnonzero(changed) + 1])


class Best:
    """The best `count` documents of one item: higher scores first, then smaller ids, null ids last."""

    def __init__(self, count: int):
        self.count = count
        self.scores, self.ids, self.missing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """A document has to score this much to be looked at."""
        return max(1, int(self.scores[-1])) if len(self.scores) >= self.count else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        near = scores >= self.least()
        scores, ids = np.append(self.scores, scores[near]), np.append(self.ids, ids[near])
        missing = np.append(self.missing, missing[near])
        order = np.lexsort((ids, missing, -scores))[: self.count]
        self.scores, self.ids, self.missing = scores[order], ids[order], missing[order]


def search_block(block: Block, members: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Adds a block's documents to an item's best ones; returns how many documents were scored."""
    bounds = weights[members] * block.greatest[members]
    if bounds.sum() < best.least():
        return 0
    members, bounds = members[bounds > 0], bounds[bounds > 0]
    spans = [slice(block.first[term], block.first[term + 1]) for term in members]
    touched = np.unique(np.concatenate([block.owner[span] for span in spans]))
    present = np.zeros((len(members), len(touched)), bool)
    impact = np.zeros(present.shape, np.int64)
    for row, span in enumerate(spans):
        column = np.searchsorted(touched, block.owner[span])
        present[row, column] = True
        impact[row, column] = block.impact[span]
    order, starts = masks(present)
    above = bounds @ present[:, order[starts]]
    ends = np.append(starts[1:], len(order))
    ranked = np.argsort(-above, kind="stable")
    covered = np.cumsum((ends - starts)[ranked])
    done, scored, look = 0, 0, FIRST_LOOK
    while done < len(ranked) and above[ranked[done]] >= best.least():
        until = max(done + 1, int(np.searchsorted(covered, scored + look, side="right")))
        until = min(until, int(np.searchsorted(-above[ranked], -best.least(), side="right")))
        group = np.concatenate([order[starts[g] : ends[g]] for g in ranked[done:until]])
        at = touched[group]
        best.add(weights[members] @ impact[:, group], block.ids[at], block.missing[at])
        done, scored, look = until, int(covered[until - 1]), look * 2
    return scored


def search_items(postings: DataFrame, query: Query, k: int) -> DataFrame:
    """item_id, rank, doc_id and score of the best `k` documents of each item of a block."""
    longest = max(map(len, query.members), default=1)
    size = max(1, min(BLOCK_DOCUMENTS, CELLS // max(longest, 1)))

    def run(batches):
        best = [Best(k) for _ in query.ids]
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False)
            found, starts = list_values(batch.column(2))
            counts, _ = list_values(batch.column(3))
            for a in range(0, batch.num_rows, size):
                b = min(a + size, batch.num_rows)
                part = slice(starts[a], starts[b])
                block = Block(query, batch.column(0).slice(a, b - a), n[a:b], found[part], counts[part], starts[a : b + 1])
                for members, held in zip(query.members, best):
                    search_block(block, members, query.weights, held)
        sizes = [len(held.scores) for held in best]
        if sum(sizes):
            ids = np.concatenate([held.ids for held in best])
            missing = np.concatenate([held.missing for held in best])
            scores = np.concatenate([held.scores for held in best])
            yield pa.record_batch(
                [pa.array(np.repeat(np.array(query.ids), sizes)), pa.array(ids, mask=missing), pa.array(scores)],
                names=["item_id", "doc_id", "score"],
            )

    found = postings.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(documents: DataFrame, items: DataFrame, k: int = 10, pairs: int = PAIRS) -> DataFrame:
    """The `k` best documents with a score above zero for each item: item_id, rank (from 1), doc_id, score.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document's score sums weight *
    (10^9 tf div (1000 tf + 8 m)) over the item's terms, where m = 10 + 90 n N div L.
    """
    spark = documents.sparkSession
    wanted = stored(item_terms(items), "item-terms")
    path, count = shared_dir(spark, "ranked"), max(1, -(-wanted.count() // pairs))
    for number in range(count):
        table = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == number).toArrow()
        ids, owner = np.unique(table.column("item_id").to_numpy(), return_inverse=True)
        vocabulary = sorted(set(table.column("term").to_pylist()))
        place = {term: at for at, term in enumerate(vocabulary)}
        places = np.array([place[term] for term in table.column("term").to_pylist()], np.int64)
        postings = stored(counted(documents, vocabulary), "postings")
        total = postings.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        held = document_counts(postings, len(vocabulary))
        weights = np.array([floor(1000 * log((2 * total.documents + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
        members = [np.sort(places[owner == item]) for item in range(len(ids))]
        query = Query(ids.tolist(), members, weights, total.documents, total.length)
        search_items(postings, query, k).write.parquet(f"{path}/block={number}")
    return spark.read.schema("item_id bigint, rank int, doc_id bigint, score bigint").parquet(
        *(f"{path}/block={number}" for number in range(count))
    )
