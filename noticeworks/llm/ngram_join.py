"""Near-duplicate documents: an exact join on the Jaccard similarity of word n-grams.

Universe-partition pigeonhole. A document is the set of its five-word shingles. Sizes are
cut into bands, so that a partner of a document lies in its own band or the next lower
one. Within a band the differing shingles of a linked pair number at most H; all possible
shingles are hashed into m = H + 1 + slack segments, so a linked pair agrees on at least
1 + slack whole segments. The index holds a signature of each segment of each document
(only as many segments as its size asks for).

The cost of a segment is how many documents share its signature. Empty segments and
signatures of more than `FREQUENT` documents are dear and left out. The slack covers as
many of them as it is large; then a pair still meets at another signature. A document with
more dear segments gets signatures of the one-deletion neighbourhoods of as many of its
other segments as may be missing, the last ones first; these count double in the
pigeonhole. Where that can't suffice either, the document goes by the prefix of its rarest
shingles (as many as a linked pair may lack and one more), which is exact whatever the
sizes of the lists.

Lists of documents with one signature are resolved without forming all their pairs: every
document is compared with one leader, links make components, and only documents that lie
in different components are compared further. All comparisons are exact, on the sets of
64-bit shingle hashes; parities of these sets, a few dozen bytes, tell most pairs apart
before the sets are moved, and equal sets are one from the start. Copies within a task are recognised before anything is shuffled.

Words are runs of anything but space, tab, newline, vertical tab, form feed and carriage
return, A-Z lower-cased. Defined cases: a null, empty or blank text has no shingles and is
linked with nothing; a text of fewer than five words is one shingle; rows with a null
doc_id get a null component; rows with equal doc_id are one node, linked by any of their
texts, and keep their own sizes; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.llm.common import blocks, free_names, list_values, lists, stored, texts
from noticeworks.llm.components import components

WIDTH = 5
#: Similarity in percent from which two documents are linked.
PERCENT = 80
#: Documents with one signature beyond which it is left to other segments.
FREQUENT = 64
#: Lists up to this size are compared through a join, longer ones in blocks of `BLOCK_DOCUMENTS`.
SHORT_LIST = 16
BLOCK_DOCUMENTS = 512
#: Leaders that every document of a list is compared with before what is left is compared in full.
ROUNDS = 1
#: Entries of the table that orders shingles for prefixes.
COUNTED_BUCKETS = 1 << 20

_EDGES = [1]
while _EDGES[-1] < 1 << 30:
    _EDGES.append(max(_EDGES[-1] + 1, -(-_EDGES[-1] * 100 // PERCENT)))

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_LINK, _MARK = -(1 << 62), 1 << 61


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the distinct shingles of a text, ascending."""
    words = text.lower().split()
    count = len(words)
    if not count:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, count)
    width = min(WIDTH, count)
    rolled = np.zeros(count - width + 1, np.uint64)
    for place in range(width):
        rolled = rolled * _ODD[0] + hashed[place : count - width + 1 + place]
    return np.unique(_mix(rolled + np.uint64(width)))


def band(size: int) -> int:
    return bisect_right(_EDGES, size) - 1


def differing(one: int, other: int) -> int:
    """Shingles that a linked pair of these sizes has in one document only, at most."""
    return (one + other) * (100 - PERCENT) // (100 + PERCENT)


@cache
def scheme(number: int) -> tuple[int, int, int]:
    """Segments, slack and the most dear segments that one-deletion neighbourhoods make up for, of a band."""
    largest = _EDGES[number + 1] - 1
    most = differing(largest, largest)
    slack = 1 + most // 8 if most else 0
    smallest = _EDGES[max(number - 1, 0)]
    least = differing(smallest, smallest * 100 // PERCENT)
    return most + 1 + slack, slack, ((least + 1) // 2 + slack) // 2


def asked(size: int, number: int) -> int:
    """How many segments of a band's scheme a document of this size needs; 0 if it has no partner there."""
    partner = min(size * 100 // PERCENT, _EDGES[number + 1] - 1)
    if partner < _EDGES[number]:
        return 0
    total, slack, _ = scheme(number)
    return min(total, differing(size, max(partner, size)) + 1 + slack)


def segments(tokens: np.ndarray, number: int):
    """Of the segments that are asked for: numbers of those with shingles, where each begins
    among the shingles in order of segment, those shingles, and how many segments are empty."""
    total = scheme(number)[0]
    wanted = asked(len(tokens), number)
    spread = (tokens * _ODD[2]) >> np.uint64(32)
    place = ((spread * np.uint64(total)) >> np.uint64(32)).astype(np.int64)
    used = np.flatnonzero(place >= total - wanted)
    order = used[np.argsort(place[used], kind="stable")]
    place = place[order]
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    return place[starts], starts, tokens[order], wanted - len(starts)


def signatures(tokens: np.ndarray, number: int) -> tuple[np.ndarray, int]:
    """A signature for each segment with shingles, and the number of empty ones."""
    place, starts, ordered, empty = segments(tokens, number)
    sums = np.add.reduceat(_mix(ordered), starts) if len(starts) else np.zeros(0, np.uint64)
    return _signed(sums, place, number), empty


def _signed(sums: np.ndarray, place: np.ndarray, number: int) -> np.ndarray:
    salt = np.array([number], np.uint64) * _ODD[1]
    return _mix(sums + place.astype(np.uint64) * _ODD[0] + salt).view(np.int64)


def neighbourhoods(tokens: np.ndarray, number: int, dear: set[int]) -> np.ndarray:
    """Signatures of the last segments that aren't dear and of each with one shingle left out.

    With L the most segments that may be left out, L - slack segments are enough. Say that a
    linked pair leaves out the same A segments in both documents, and up to L - A more in the
    one that reaches less far back. Of the L - slack last segments of the other, A - slack are
    left out in neither. If the pair met in none of them, they would hold two differing shingles
    each, and every other segment but the A one: more than a linked pair has.
    """
    place, starts, ordered, _ = segments(tokens, number)
    if not len(starts):
        return np.zeros(0, np.int64)
    mixed = _mix(ordered)
    sums = np.add.reduceat(mixed, starts)
    whole = _signed(sums, place, number)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ordered))))
    _, slack, most = scheme(number)
    cheap = np.flatnonzero([signature not in dear for signature in whole.tolist()])[-max(most - slack, 1) :]
    chosen = np.isin(owner, cheap)
    without = _signed(sums[owner[chosen]] - mixed[chosen], place[owner[chosen]], number)
    return np.unique(np.concatenate([whole[cheap], without]))


def pack_info(size: int, number: int, empty: int) -> int:
    return number << 53 | min(empty, (1 << 23) - 1) << 30 | min(size, (1 << 30) - 1)


def index_rows(documents: DataFrame) -> DataFrame:
    """(sig, doc_id, info): the index before it is grouped.

    Besides the signatures, every document has one row with its size (info below zero).
    Of equal documents in one task only the first is indexed; the others get a row that
    links them to it (sig is the first one's id).
    """

    def run(batches):
        first: dict[bytes, int] = {}
        for block in blocks(batches, "text"):
            sig, owner, info = [], [], []
            for doc_id, text in zip(block.column(0).to_pylist(), texts(block.column(1))):
                tokens = shingles(text)
                size = len(tokens)
                sig.append(np.array([0 if doc_id is None else doc_id]))
                owner.append([doc_id])
                info.append(np.array([-1 - size]))
                if doc_id is None or not size:
                    continue
                seen = first.setdefault(xxhash.xxh3_128_digest(tokens.tobytes()), doc_id)
                if seen != doc_id:
                    sig.append(np.array([seen]))
                    owner.append([doc_id])
                    info.append(np.array([_LINK]))
                    continue
                own = band(size)
                for number in (own, own + 1):
                    if not asked(size, number):
                        continue
                    found, empty = signatures(tokens, number)
                    packed = pack_info(size, number, empty)
                    sig.append(found)
                    owner.append([doc_id] * len(found))
                    info.append(np.full(len(found), packed))
                    if empty > scheme(number)[1]:
                        sig.append(np.array([doc_id]))
                        owner.append([doc_id])
                        info.append(np.array([_MARK | packed]))
            yield pa.record_batch(
                [
                    pa.array(np.concatenate(sig).astype(np.int64)),
                    pa.array([i for part in owner for i in part], pa.int64()),
                    pa.array(np.concatenate(info).astype(np.int64)),
                ],
                names=["sig", "doc_id", "info"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, "sig bigint, doc_id bigint, info bigint")


def grouped_rows(index: DataFrame, frequent_from: int = FREQUENT + 1) -> DataFrame:
    """(kind, sig, doc_id, info, docs, sizes): what the index holds in common.

    Rows come sorted by signature. A signature of two or more documents (one of its own
    band at least) gives one row with all of them ('list'), or, from `frequent_from` on, a
    row for each ('dear'). Rows about single documents pass through. A signature's rows
    are held up to that number and the rest of a batch.
    """
    most = frequent_from - 1
    schema = "kind string, sig bigint, doc_id bigint, info bigint, docs array<bigint>, sizes array<bigint>"

    def run(batches):
        held = np.zeros((3, 0), np.int64)  # rows of the last signature so far
        frequent = False
        for batch in batches:
            info = batch.column(2).to_numpy(zero_copy_only=False)
            single = (info < 0) | (info >= _MARK)
            if single.any():
                part = batch.filter(pa.array(single))
                kinds = np.where(info[single] >= _MARK, "mark", np.where(info[single] == _LINK, "copy", "size"))
                yield _plain(kinds, part)
            part = batch.filter(pa.array(~single))
            rows = np.stack([column.to_numpy(zero_copy_only=False) for column in part.columns]).astype(np.int64)
            if frequent and rows.shape[1]:
                # The signature that was found frequent goes on.
                more = int(np.searchsorted(rows[0] != held[0, 0], True)) if rows[0, 0] == held[0, 0] else 0
                if more:
                    yield _dear(rows[:, :more])
                if more == rows.shape[1]:
                    continue
                rows, held, frequent = rows[:, more:], np.zeros((3, 0), np.int64), False
            rows = np.concatenate([held, rows], axis=1)
            if not rows.shape[1]:
                continue
            starts = np.flatnonzero(np.diff(rows[0], prepend=rows[0, 0] - 1))
            yield from _runs(rows[:, : starts[-1]], starts[:-1])
            held = rows[:, starts[-1] :]
            if held.shape[1] > most:
                yield _dear(held)
                held, frequent = held[:, :1], True
        if not frequent and held.shape[1]:
            yield from _runs(held, np.zeros(1, np.int64))

    def _plain(kinds, part):
        nothing = pa.nulls(part.num_rows, pa.list_(pa.int64()))
        return pa.record_batch(
            [pa.array(kinds.tolist(), pa.string()), *part.columns, nothing, nothing], names=[*("kind", "sig", "doc_id", "info", "docs", "sizes")]
        )

    def _dear(rows):
        return _plain(np.full(rows.shape[1], "dear"), pa.record_batch(list(map(pa.array, rows)), names=["sig", "doc_id", "info"]))

    def _runs(rows, starts):
        lengths = np.diff(np.append(starts, rows.shape[1]))
        size = rows[2] & ((1 << 30) - 1)
        own = size >= np.array(_EDGES)[(rows[2] >> 53) & 0xFF]
        shared = (lengths > 1) & (np.add.reduceat(own, starts) > 0) if len(starts) else np.zeros(0, bool)
        many = np.repeat(shared & (lengths > most), lengths)
        if many.any():
            yield _dear(rows[:, many])
        few = shared & (lengths <= most)
        if few.any():
            chosen = np.repeat(few, lengths)
            nothing = pa.nulls(int(few.sum()), pa.int64())
            yield pa.record_batch(
                [
                    pa.array(["list"] * int(few.sum())),
                    pa.array(rows[0, starts[few]]),
                    nothing,
                    nothing,
                    lists(rows[1, chosen], lengths[few]),
                    lists(size[chosen], lengths[few]),
                ],
                names=["kind", "sig", "doc_id", "info", "docs", "sizes"],
            )

    return index.repartition("sig").sortWithinPartitions("sig", "doc_id").mapInArrow(run, schema)


def short_of_segments(found: DataFrame) -> DataFrame:
    """doc_id, scheme, hard, dear: documents with more dear segments than the slack covers.

    `hard` tells that one-deletion neighbourhoods don't make up for them either.
    """
    parts = found.where("kind in ('dear', 'mark')").select(
        "doc_id",
        F.expr("int((info >> 53) & 255)").alias("scheme"),
        F.expr("int((info >> 30) & ((1L << 23) - 1))").alias("empty"),
        F.when(F.col("kind") == "dear", F.col("sig")).alias("sig"),
    )
    most = len(_EDGES) - 2
    slack = F.element_at(F.lit([scheme(k)[1] for k in range(most)]), F.col("scheme") + 1)
    enough = F.element_at(F.lit([scheme(k)[2] for k in range(most)]), F.col("scheme") + 1)
    sums = parts.groupBy("doc_id", "scheme").agg(
        (F.max("empty") + F.count_distinct("sig")).alias("left_out"), F.collect_set("sig").alias("dear")
    )
    return sums.where(F.col("left_out") > slack).select("doc_id", "scheme", (F.col("left_out") > enough).alias("hard"), "dear")


def parities(tokens: np.ndarray) -> bytes:
    """Whether an even or odd number of shingles falls into each of a power of two of places, as bits.

    A shingle that one of two sets lacks turns one bit over, so two sets differ in at least
    as many shingles as their bits differ.
    """
    places = 1 << max(6, int(len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing_bits(one: bytes, other: bytes) -> int:
    """Bits that differ, after the longer one is folded to the length of the shorter."""
    if len(one) < len(other):
        one, other = other, one
    while len(one) > len(other):
        half = len(one) // 2
        one = (int.from_bytes(one[:half], "big") ^ int.from_bytes(one[half:], "big")).to_bytes(half, "big")
    return (int.from_bytes(one, "big") ^ int.from_bytes(other, "big")).bit_count()


def sets_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, tokens (hashes of the shingles), size, mark (a 128-bit hash of the set) and bits (its
    parities) of the documents named in `ids`."""

    def run(batches):
        for block in blocks(batches, "text"):
            rows = [shingles(text) for text in texts(block.column(1))]
            yield pa.record_batch(
                [
                    block.column(0),
                    lists(np.concatenate([np.zeros(0, np.int64), *[row.view(np.int64) for row in rows]]), list(map(len, rows))),
                    pa.array(list(map(len, rows)), pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(row.tobytes()) for row in rows], pa.binary()),
                    pa.array([parities(row) for row in rows], pa.binary()),
                ],
                names=["doc_id", "tokens", "size", "mark", "bits"],
            )

    chosen = documents.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    return chosen.mapInArrow(run, "doc_id bigint, tokens array<bigint>, size bigint, mark binary, bits binary")


def distinct_sets(sets: DataFrame) -> DataFrame:
    """The sets with a number each (uid), once for each doc_id and set: a row may stand repeatedly.

    Without repeated rows, this costs an aggregation of narrow rows.
    """
    sets = stored(sets.withColumn("uid", F.monotonically_increasing_id()), "ngram-sets")
    copies = sets.groupBy("doc_id", "mark").agg(F.min("uid").alias("kept"), F.count(F.lit(1)).alias("n"))
    again = stored(copies.where("n > 1").select("doc_id", "mark", "kept"), "ngram-sets-again")
    if again.isEmpty():
        return sets
    once = sets.join(again, ["doc_id", "mark"], "left").where("kept is null or kept = uid").select(*sets.columns)
    return stored(once, "ngram-sets-once")


def deletion_rows(sets: DataFrame, short: DataFrame) -> DataFrame:
    """(sig, doc_id, size) of the one-deletion neighbourhoods of documents short of segments."""
    rows = sets.join(short.where("not hard").select("doc_id", "scheme", "dear"), "doc_id")

    def run(batches):
        for batch in batches:
            for doc_id, tokens, number, dear in zip(*(column.to_pylist() for column in batch.columns)):
                found = neighbourhoods(np.array(tokens, np.int64).view(np.uint64), number, set(dear))
                yield pa.record_batch(
                    [pa.array(found), pa.array([doc_id] * len(found), pa.int64()), pa.array([len(tokens)] * len(found), pa.int64())],
                    names=["sig", "doc_id", "size"],
                )

    return rows.select("doc_id", "tokens", "scheme", "dear").mapInArrow(run, "sig bigint, doc_id bigint, size bigint")


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """In how many sets the shingles of each of a fixed number of buckets stand: a table of fixed size."""
    bucket = F.pmod("token", F.lit(COUNTED_BUCKETS)).cast("int")
    rows = sets.select(F.explode("tokens").alias("token")).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    found = rows.toArrow()
    counts = np.zeros(COUNTED_BUCKETS, np.int32)
    counts[found.column("bucket").to_numpy()] = np.minimum(found.column("n").to_numpy(), np.iinfo(np.int32).max)
    return counts


def prefix_rows(sets: DataFrame) -> DataFrame:
    """(sig, doc_id, size, hard): the rarest shingles of each set, one more than a linked pair may lack.

    Two sets that lack no more than that of each other share a shingle of both prefixes under
    any order that is the same for all sets. Here it is the count of the shingle's bucket, then
    the shingle's hash, so the order needs no count for each shingle.
    """
    counts = shingle_counts(sets)

    def run(batches):
        for batch in batches:
            tokens, offsets = list_values(batch.column(1))
            sig, lengths = [], []
            for a, b in zip(offsets, offsets[1:]):
                own, size = tokens[a:b], int(b - a)
                reach = size - (size * PERCENT + 99) // 100 + 1
                count = counts[own % COUNTED_BUCKETS]
                prefix = np.lexsort((own, count))[:reach]
                # A shingle whose bucket holds nothing else joins nothing, but it takes a place in the prefix.
                prefix = prefix[count[prefix] > 1]
                sig.append(own[prefix])
                lengths.append(len(prefix))
            owner = np.repeat(np.arange(len(lengths)), lengths)
            columns = [
                pa.array(np.concatenate([np.zeros(0, np.int64), *sig])),
                batch.column(0).take(pa.array(owner)),
                pa.array(np.diff(offsets)[owner]),
                batch.column(2).take(pa.array(owner)),
            ]
            yield pa.record_batch(columns, names=["sig", "doc_id", "size", "useful"])

    return sets.select("doc_id", "tokens", "hard").mapInArrow(run, "sig bigint, doc_id bigint, size bigint, useful boolean")


def distinct_lists(rows: DataFrame) -> DataFrame:
    """(list, doc_id, size) from (sig, doc_id, size, useful): of signatures with the same rows one is kept; single
    ones go, and those without a useful row."""
    rows = rows.groupBy("sig", "doc_id", "size").agg(F.bool_or("useful").alias("useful"))
    number = F.xxhash64("doc_id", "size", F.lit(21)).cast("decimal(38,0)")
    marks = rows.groupBy("sig").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(number).alias("sum"),
        F.bit_xor(F.xxhash64("doc_id", "size", F.lit(22))).alias("xor"),
        F.bool_or("useful").alias("useful"),
    )
    kept = marks.where("n > 1 and useful").groupBy("n", "sum", "xor").agg(F.min("sig").alias("sig")).select("sig")
    return rows.join(kept, "sig").select(F.col("sig").alias("list"), "doc_id", "size")


def near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose parities allow for a link: narrow rows, and no linked pair goes."""

    def run(batches):
        for batch in batches:
            sizes = zip(batch.column(2).to_pylist(), batch.column(4).to_pylist())
            bits = zip(batch.column(3).to_pylist(), batch.column(5).to_pylist())
            kept = [differing_bits(*two) <= differing(*both) for two, both in zip(bits, sizes)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    one = sets.select(F.col("doc_id").alias("a"), F.col("size").alias("size_a"), F.col("bits").alias("bits_a"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("size").alias("size_b"), F.col("bits").alias("bits_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "size_a", "bits_a", "size_b", "bits_b")
    return both.mapInArrow(run, "a bigint, b bigint")


def _words(bits: list[bytes], length: int) -> np.ndarray:
    """Parities of equal length as rows of 64-bit words, folded to `length` bytes."""
    rows = np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)
    while rows.shape[1] * 8 > length:
        rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
    return rows


def near_in_block(table: pa.Table) -> pa.Table:
    """Near pairs of different components among the documents of one block or between two.

    Parities are compared block against block; only near pairs become rows, each in the
    first list that its documents have in common.
    """
    table = table.combine_chunks()
    ids, sizes, component, side, first, second = (
        table.column(name).to_numpy() for name in ("doc_id", "size", "component", "block", "first", "second")
    )
    bits, member_of, here = table.column("bits").to_pylist(), table.column("lists").to_pylist(), table.column("list")[0].as_py()
    lengths = np.array([len(one) for one in bits])
    out = []
    for one in np.unique(lengths):
        for other in np.unique(lengths):
            rows, columns = np.flatnonzero(lengths == one), np.flatnonzero(lengths == other)
            length = int(min(one, other))
            a, b = _words([bits[i] for i in rows], length), _words([bits[i] for i in columns], length)
            step = max(1, (1 << 22) // (b.size + 1))
            for start in range(0, len(rows), step):
                part = rows[start : start + step]
                apart = np.bitwise_count(a[start : start + step, None, :] ^ b[None, :, :]).sum(2, dtype=np.int64)
                total = sizes[part][:, None] + sizes[columns][None, :]
                lower = ids[part][:, None] < ids[columns][None, :]
                across = component[part][:, None] != component[columns][None, :]
                if first[0] != second[0]:
                    across &= side[part][:, None] != side[columns][None, :]
                met = (apart <= total * (100 - PERCENT) // (100 + PERCENT)) & lower & across
                met &= 100 * np.minimum(sizes[part][:, None], sizes[columns][None, :]) >= PERCENT * np.maximum(
                    sizes[part][:, None], sizes[columns][None, :]
                )
                for i, j in np.argwhere(met):
                    i, j = part[i], columns[j]
                    if min(set(member_of[i]).intersection(member_of[j])) == here:
                        out.append((int(ids[i]), int(ids[j])))
    return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def near_in_lists(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Near pairs of different components within long lists, by blocks of the lists."""
    blocks_of = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCUMENTS).cast("int").alias("blocks"))
    lists_of = placed.groupBy("doc_id").agg(F.collect_set("list").alias("lists"))
    block = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.col("blocks")).cast("int")
    facts = lists_of.join(sets.select("doc_id", "size", "bits"), "doc_id")
    rows = placed.drop("size").join(blocks_of, "list").withColumn("block", block).join(facts, "doc_id")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.withColumn("other", other).select(
        "list",
        "doc_id",
        "size",
        "component",
        "bits",
        "lists",
        "block",
        F.least("block", "other").alias("first"),
        F.greatest("block", "other").alias("second"),
    )
    return dealt.groupBy("list", "first", "second").applyInArrow(near_in_block, "a bigint, b bigint")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough, with exact counts."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("one"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("two"))
    common = F.size(F.array_intersect("one", "two"))
    both = pairs.join(one, "a").join(two, "b").withColumn("common", common)
    union = F.size("one") + F.size("two") - F.col("common")
    return both.where(100 * F.col("common") >= PERCENT * union).select("a", "b")


def near_in_size(one: str, other: str):
    return 100 * F.least(one, other) >= PERCENT * F.greatest(one, other)


def resolve(members: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) from lists of documents that may be linked and links known before.

    `members` is (list, doc_id, size). Each round compares every document with one leader
    of its list from another component; what is then still apart is compared in full.
    """
    tested, found = None, components(links, "components")
    for turn in range(ROUNDS + 1):
        placed = (
            members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .withColumn("component", F.coalesce("component", "doc_id"))
            .select("list", "doc_id", "size", "component")
        )
        apart = placed.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        apart = apart.where("low < high").select("list")
        placed = stored(placed.join(apart, "list"), f"apart-{turn}")
        if placed.isEmpty():
            break
        short = placed
        if turn < ROUNDS:
            first = F.xxhash64("doc_id", F.lit(turn)) if turn else F.col("doc_id")
            order = F.struct(first.alias("order"), "doc_id", "size", "component")
            leaders = placed.groupBy("list").agg(F.min(order).alias("leader"))
        else:
            # Every pair of different components has a member outside the largest of them.
            counts = placed.groupBy("list", "component").agg(F.count(F.lit(1)).alias("n"))
            largest = counts.groupBy("list").agg(F.max(F.struct("n", "component")).alias("largest"), F.sum("n").alias("all"))
            short = placed.join(largest.where(F.col("all") <= SHORT_LIST).select("list"), "list", "left_semi")
            outside = short.join(largest, "list").where(F.col("component") != F.col("largest.component"))
            leaders = outside.select("list", F.struct("doc_id", "size", "component").alias("leader"))
        other = F.col("leader.doc_id")
        pairs = (
            short.join(leaders, "list")
            .where((F.col("component") != F.col("leader.component")) & near_in_size("size", "leader.size"))
            .select(F.least("doc_id", other).alias("a"), F.greatest("doc_id", other).alias("b"))
            .distinct()
        )
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, f"pairs-{turn}")
        tested = pairs if tested is None else tested.unionByName(pairs)
        likely = near(pairs, sets)
        if turn == ROUNDS:
            long = placed.join(largest.where(F.col("all") > SHORT_LIST).select("list"), "list", "left_semi")
            likely = likely.unionByName(near_in_lists(long, sets))
        likely = stored(likely.distinct(), f"near-{turn}")
        named = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        new = stored(linked(likely, sets.join(named, "doc_id", "left_semi")), f"links-{turn}")
        if not new.isEmpty():
            # What is known already hangs under its component; only new links change that.
            known = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
            found = components(known.unionByName(new), f"components-{turn}")
    return found


def near_duplicates(documents: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document.

    `frequent` is a matter of cost alone: the result is the same for any value.
    """
    found = stored(grouped_rows(index_rows(documents), frequent + 1), "ngram-index")
    short = stored(short_of_segments(found), "ngram-short")
    # The sizes belong to the key: a document with several texts has several.
    runs = found.where("kind = 'list'").groupBy(F.xxhash64("docs").alias("a"), F.hash("docs").alias("b"), "docs", "sizes").agg(
        F.min("sig").alias("list")
    )
    cheap = runs.select("list", F.explode(F.arrays_zip("docs", "sizes")).alias("one")).select(
        "list", F.col("one.docs").alias("doc_id"), F.col("one.sizes").alias("size")
    )
    cheap = stored(cheap, "ngram-lists")
    hard = short.groupBy("doc_id").agg(F.max("hard").alias("hard"))
    wanted = cheap.select("doc_id").unionByName(hard.select("doc_id")).distinct()
    sets = distinct_sets(sets_of(documents, wanted))
    # Equal sets are one from here on: their first document stands for all that have no other set.
    first = sets.groupBy("size", "mark").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    equal = stored(
        sets.select("doc_id", "size", "mark").join(first.where("n > 1").select("size", "mark", "first"), ["size", "mark"]).select(
            "doc_id", "first"
        ),
        "ngram-equal",
    )
    several = sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    stands_for = equal.where("doc_id <> first").join(several, "doc_id", "left_anti")
    shortened = sets.join(hard, "doc_id").join(stands_for, "doc_id", "left_anti")
    listed = cheap.join(stands_for, "doc_id", "left").select("list", F.coalesce("first", "doc_id").alias("doc_id"), "size")
    yes = F.lit(True).alias("useful")
    members = (
        listed.select(F.xxhash64(F.lit(0), "list").alias("sig"), "doc_id", "size", yes)
        .unionByName(deletion_rows(shortened, short).select(F.xxhash64(F.lit(1), "sig").alias("sig"), "doc_id", "size", yes))
        .unionByName(prefix_rows(shortened).select(F.xxhash64(F.lit(2), "sig").alias("sig"), "doc_id", "size", "useful"))
    )
    members = stored(distinct_lists(members), "ngram-members")
    copies = found.where("kind = 'copy'").select(F.col("sig").alias("a"), F.col("doc_id").alias("b"))
    copies = copies.unionByName(equal.select(F.col("first").alias("a"), F.col("doc_id").alias("b")))
    found_components = resolve(members, sets, copies)
    sizes = found.where("kind = 'size'").select("doc_id", (-1 - F.col("info")).alias("n_shingles"))
    return sizes.join(found_components.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def with_node(documents: DataFrame, node: str) -> DataFrame:
    """Adds a column `node`: the doc_id, or where several rows have it, a 64-bit hash of doc_id and text."""
    (n,) = free_names(documents, "n")
    several = documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias(n)).where((F.col(n) > 1) & F.col("doc_id").isNotNull())
    several = stored(several, "ngram-several")
    text = F.coalesce("text", F.lit(""))
    text = F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise("")
    value = F.when(F.col(n).isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", text))
    return documents.join(several, "doc_id", "left").select(*documents.columns, value.alias(node))


def one_of_each(documents: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id, with all columns.

    Rows with a null doc_id belong to no group and stay. Rows with equal doc_id are grouped
    each by its text: one of them goes only if another of its group stays.
    """
    node, number = free_names(documents, "node", "number")
    rows = with_node(documents.where("doc_id is not null"), node)
    groups = near_duplicates(rows.select(F.col(node).alias("doc_id"), "text")).select(
        F.col("doc_id").alias("node"), F.col("component_id").alias("component")
    )
    owners = rows.select(F.col(node).alias("node"), "doc_id").distinct()
    smallest = groups.distinct().join(owners, "node").groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("kept"))
    row = F.row_number().over(Window.partitionBy(node).orderBy("text"))
    kept = rows.join(smallest.select(F.col("kept.node").alias(node)), node, "left_semi")
    first = kept.withColumn(number, row).where(F.col(number) == 1).select(*documents.columns)
    return first.unionByName(documents.where("doc_id is null"))
