"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

Pieces of the full length are sequences by themselves. The others are dealt out at random
into blocks of about `BLOCK_ITEMS`, and each block is packed by several islands: a
population of packings each, which starts from best fit over decreasing lengths. A
crossover injects whole well-filled sequences of one parent into the other, dissolves
those of the other that hold an injected piece, and best-fits the displaced pieces. After
each epoch every island sends its elite to the next island of the block; after the last
the best packing counts. An island stops as soon as no packing can have fewer sequences.

Then every block gives up its worst-filled sequences, and what has been given up is packed
in the same way, level by level, until one block is left. So only one block of the whole
corpus can end on a half-empty sequence.

Defined cases: a null text counts as empty and has the end id alone; repeated rows are
packed each by itself; ties of length are broken by the order of the stored rows; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.llm.common import stored
from noticeworks.llm.word_tokens import encode_rows, id_lists, read_vocabulary

BLOCK_ITEMS = 2_048
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
OFFSPRING = 10
#: Blocks of one level whose given-up sequences meet in a block of the next.
FAN_IN = 32
#: A sequence filled less than this is given up for the next level, and at least the worst one.
WELL_FILLED = 0.995
GIVEN_UP = 8
#: States (a block on an island) that one task works on.
STATES_A_TASK = 4

_STATE = "block bigint, island int, uid array<bigint>, length array<int>, population array<array<int>>"


def pieces(documents: DataFrame, vocabulary: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece, and its ids if wanted."""
    encode = encode_rows(read_vocabulary(vocabulary), end_id)

    def run(batches):
        for doc_ids, rows in encode(batches):
            owner, piece, parts = [], [], []
            for place, row in enumerate(rows):
                for number in range(0, len(row), capacity * 4):
                    owner.append(place)
                    piece.append(number // (capacity * 4))
                    parts.append(row[number : number + capacity * 4])
            columns = [
                doc_ids.take(pa.array(owner, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(np.array(piece, np.int64) * capacity),
                pa.array([len(part) // 4 for part in parts], pa.int64()),
                pa.array([zlib.crc32(part) for part in parts], pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, id_lists(parts)], [*names, "ids"]
            yield pa.record_batch(columns, names=names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return documents.select("doc_id", "text").mapInArrow(run, schema)


class Packing:
    """Sequences (lists of items) and the space left in each."""

    def __init__(self, bins: list[list[int]], space: list[int]):
        self.bins, self.space = bins, space

    @classmethod
    def of(cls, assignment, lengths: list[int], capacity: int) -> "Packing":
        bins: list[list[int]] = [[] for _ in range(max(assignment, default=-1) + 1)]
        for item, number in enumerate(assignment):
            bins[number].append(item)
        return cls(bins, [capacity - sum(lengths[item] for item in members) for members in bins])

    def assignment(self, count: int) -> list[int]:
        found = [0] * count
        for number, members in enumerate(self.bins):
            for item in members:
                found[item] = number
        return found

    def best_fit(self, items: list[int], lengths: list[int], capacity: int) -> None:
        """Puts items, longest first, where the least space is left over."""
        spaces = sorted((space, number) for number, space in enumerate(self.space))
        for item in items:
            length = lengths[item]
            at = bisect_left(spaces, (length, -1))
            if at < len(spaces):
                space, number = spaces.pop(at)
                self.bins[number].append(item)
            else:
                space, number = capacity, len(self.bins)
                self.bins.append([item])
                self.space.append(capacity)
            self.space[number] = space - length
            insort(spaces, (space - length, number))

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Fewer sequences first, then fuller ones."""
        return -len(self.bins), sum(((capacity - space) / capacity) ** 2 for space in self.space)


def crossover(into: Packing, donor: Packing, lengths: list[int], capacity: int, dice) -> Packing:
    """A child with whole well-filled sequences of the donor and what the other parent keeps besides."""
    ranked = sorted(range(len(donor.bins)), key=lambda number: (donor.space[number], number))
    well = ranked[: max(1, len(ranked) // 2)]
    chosen = [number for number in well if dice.random() < 0.5] or well[:1]
    injected = {item for number in chosen for item in donor.bins[number]}
    child = Packing([list(donor.bins[number]) for number in chosen], [donor.space[number] for number in chosen])
    displaced = []
    worst = max(into.space)
    for members, space in zip(into.bins, into.space):
        if any(item in injected for item in members) or space == worst:
            displaced += [item for item in members if item not in injected]
        else:
            child.bins.append(list(members))
            child.space.append(space)
    displaced.sort(key=lambda item: -lengths[item])
    child.best_fit(displaced, lengths, capacity)
    return child


def evolve(lengths: list[int], population: list[list[int]], capacity: int, seed: int) -> list[list[int]]:
    """One epoch on one island: the population as assignments of items to sequences, best first."""
    dice = np.random.default_rng(seed)
    least = -(-sum(lengths) // capacity)
    packings = [Packing.of(assignment, lengths, capacity) for assignment in population]
    while len(packings) < POPULATION and not (packings and len(packings[0].bins) <= least):
        order = sorted(
            range(len(lengths)), key=lambda item: -lengths[item] * (1 + (0.2 * dice.random() if packings else 0))
        )
        one = Packing([], [])
        one.best_fit(order, lengths, capacity)
        packings.append(one)
    packings.sort(key=lambda one: one.fitness(capacity), reverse=True)
    for _ in range(OFFSPRING):
        if len(packings) < 2 or len(packings[0].bins) <= least:
            break
        one, other = dice.choice(len(packings), 2, replace=False)
        packings.append(crossover(packings[one], packings[other], lengths, capacity, dice))
        packings.sort(key=lambda one: one.fitness(capacity), reverse=True)
        del packings[POPULATION:]
    return [one.assignment(len(lengths)) for one in packings]


def _nested(column: pa.Array) -> list[list[list[int]]]:
    return [row or [] for row in column.to_pylist()]


def epoch(states: DataFrame, capacity: int, number: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            table = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            found = []
            for block, island, lengths, population in zip(
                table["block"].to_pylist(), table["island"].to_pylist(), table["length"].to_pylist(), _nested(table["population"])
            ):
                found.append(evolve(lengths, population, capacity, (block * ISLANDS + island) * EPOCHS + number))
            yield pa.record_batch(
                [*batch.columns[:4], pa.array(found, pa.list_(pa.list_(pa.int32())))], names=batch.schema.names
            )

    return states.mapInArrow(run, _STATE)


def pack_blocks(items: DataFrame, count: int, capacity: int, label: str) -> DataFrame:
    """Packs (uid, length, block) within each block: block, uid, length and bin (from 0), and the space left in it."""
    tasks = max(1, min(-(-count * ISLANDS // STATES_A_TASK), 20_000))
    # Longest first; a block holds about BLOCK_ITEMS rows, as it is dealt out by a hash.
    members = F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("order"), "uid")))
    states = (
        items.groupBy("block")
        .agg(members.alias("members"))
        .select(
            "block",
            F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
            F.col("members.uid").alias("uid"),
            F.transform("members.order", lambda order: (-order).cast("int")).alias("length"),
            F.array().cast("array<array<int>>").alias("population"),
        )
        .repartition(tasks, "block", "island")
    )
    states = stored(epoch(states, capacity, 0), f"{label}-epoch-0")
    for number in range(1, EPOCHS):
        elite = states.select(
            "block",
            F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"),
            F.slice("population", 1, 1).alias("elite"),
        )
        moved = states.join(elite, ["block", "island"]).select(
            "block", "island", "uid", "length", F.concat("elite", "population").alias("population")
        )
        states = stored(epoch(moved.repartition(tasks, "block", "island"), capacity, number), f"{label}-epoch-{number}")
    bins = F.array_max(F.element_at("population", 1))
    best = states.withColumn("bins", bins).groupBy("block").agg(
        F.min_by(F.struct("uid", "length", F.element_at("population", 1).alias("bin")), F.struct("bins", "island")).alias("best")
    )
    rows = best.select(
        "block", F.posexplode(F.arrays_zip("best.uid", "best.length", "best.bin")).alias("at", "item")
    ).select("block", "at", F.col("item.uid").alias("uid"), F.col("item.length").alias("length"), F.col("item.bin").alias("bin"))
    return rows


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """uid, sequence_id and offset for rows (uid, length), lengths between 1 and `capacity`, uids different.

    Blocks of one level are packed together; each level has `FAN_IN` times fewer of them.
    """
    done = items.where(F.col("length") >= capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = items.where(F.col("length") < capacity).select("uid", "length")
    level, count = 0, max(1, -(-left.count() // BLOCK_ITEMS))
    left = left.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(count)))
    while True:
        placed = stored(pack_blocks(left, count, capacity, f"packing-{level}"), f"packed-{level}")
        sums = placed.groupBy("block", "bin").agg(
            F.sum("length").alias("filled"),
            F.array_sort(F.collect_list(F.struct("at", "uid", "length"))).alias("members"),
        )
        number = F.col("level") * F.lit(1 << 56) + F.col("block") * F.lit(1 << 20) + F.col("bin")
        sums = sums.withColumn("level", F.lit(level).cast("long")).withColumn("sequence_id", number)
        final = count == 1
        if not final:
            # The worst-filled sequences of each block go on to the next level.
            worst = F.sort_array(F.collect_list(F.struct("filled", "bin")))
            chosen = (
                sums.groupBy("block")
                .agg(F.slice(worst, 1, GIVEN_UP).alias("worst"))
                .select("block", F.posexplode("worst").alias("rank", "one"))
                .where((F.col("rank") == 0) | (F.col("one.filled") < int(WELL_FILLED * capacity)))
                .select("block", F.col("one.bin").alias("bin"))
            )
            sums = stored(sums.join(chosen.withColumn("given_up", F.lit(True)), ["block", "bin"], "left"), f"sequences-{level}")
            again = sums.where("given_up").select("block", F.explode("members").alias("item"))
            sums = sums.where("given_up is null")
        before = F.expr("transform(members, (m, i) -> struct(m.uid as uid, aggregate(slice(members, 1, i), 0L, (a, x) -> a + x.length) as offset))")
        done = done.unionByName(
            sums.select("sequence_id", F.explode(before).alias("item")).select(
                F.col("item.uid").alias("uid"), "sequence_id", F.col("item.offset").alias("offset")
            )
        )
        if final:
            return done
        count = -(-count // FAN_IN)
        left = again.select(
            F.col("item.uid").alias("uid"), F.col("item.length").alias("length"), F.pmod(F.col("block"), F.lit(count)).alias("block")
        )
        level += 1


def packed(documents: DataFrame, vocabulary: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset, and ids if wanted.
    """
    # Stored once, so that the row numbers stay what they are.
    rows = stored(pieces(documents, vocabulary, end_id, capacity, with_ids).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    places = pack(rows.select("uid", "length"), capacity)
    return rows.join(places, "uid").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])
    )
