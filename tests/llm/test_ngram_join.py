"""The n-gram join against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from noticeworks.llm import ngram_join
from noticeworks.llm.common import open_table
from noticeworks.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return frozenset()
    width = min(5, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute_force(rows):
    sets = [(doc_id, shingle_set(text)) for doc_id, text in rows]
    parent = {doc_id: doc_id for doc_id, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for place, (_, one) in enumerate(sets):
        for shingle in one:
            holders.setdefault(shingle, []).append(place)
    for a, (i, one) in enumerate(sets):
        near = {b for shingle in one for b in holders[shingle] if b > a}
        for b in near:
            j, other = sets[b]
            common = len(one & other)
            if i is not None and j is not None and 100 * common >= 80 * (len(one) + len(other) - common):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return sorted(((i, len(one), None if i is None else root(i)) for i, one in sets), key=repr)


def changed(words, dice, share):
    out = list(words)
    for _ in range(max(1, int(share * len(words)))):
        at = dice.randrange(len(out))
        kind = dice.random()
        if kind < 0.5:
            out[at] = f"w{dice.randrange(5000)}"
        elif kind < 0.75 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, f"w{dice.randrange(5000)}")
    return out


def corpus(seed, groups=60):
    """Groups of near copies of many sizes, passages that many texts share, and copies."""
    dice = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(groups):
        size = dice.choice([1, 2, 4, 5, 6, 8, 9, 10, 12, 15, 20, 30, 60, 150, 400])
        base = [f"w{dice.randrange(3000)}" for _ in range(size)]
        if dice.random() < 0.4:
            cut = dice.randrange(10, 60)
            base = base[: size // 2] + passage[:cut] + base[size // 2 :]
        for _ in range(dice.choice([1, 2, 3, 8])):
            texts.append(base)
            base = changed(base, dice, dice.choice([0, 0.005, 0.01, 0.02, 0.03])) if dice.random() < 0.8 else base
    hub = [f"h{i}" for i in range(120)]
    texts += [changed(hub, dice, 0.012) for _ in range(40)] + [hub] * 10
    texts += [passage[:50] + [f"u{dice.randrange(10**6)}" for _ in range(dice.randrange(1, 60))] for _ in range(60)]
    dice.shuffle(texts)
    return [(i * 3 % 1009, " ".join(words).upper() if i % 7 == 0 else "\t".join(words)) for i, words in enumerate(texts)]


@pytest.mark.parametrize(("seed", "frequent", "block"), [(1, 64, 512), (2, 2, 8), (3, 6, 512)])
def test_components_match_all_pairs(spark, monkeypatch, seed, frequent, block):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCUMENTS", block)
    rows = corpus(seed)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = ngram_join.near_duplicates(frame, frequent).collect()
    assert sorted((tuple(row) for row in got), key=repr) == brute_force(rows)


def test_given_documents(spark, small_dir, odd):
    rows = open_table(spark, small_dir, "documents").select("doc_id", "text")
    odder = odd.selectExpr("doc_id + 100000 as doc_id", "text").unionByName(
        spark.createDataFrame([(None, "a b c d e f g h"), (200_000, "A B C d e f g h")], "doc_id bigint, text string")
    )
    both = rows.unionByName(odder)
    got = ngram_join.near_duplicates(both).collect()
    expected = brute_force([(row.doc_id, row.text) for row in both.where("doc_id is not null").collect()])
    known = sorted((tuple(row) for row in got if row.doc_id is not None), key=repr)
    assert known == expected
    assert [tuple(row) for row in got if row.doc_id is None] == [(None, 4, None)]


def test_empty(none):
    assert ngram_join.near_duplicates(none).collect() == []


def test_linked_pairs_agree_on_enough_segments():
    """The pigeonhole itself: pairs at the threshold share more emitted segments than the slack."""
    dice = np.random.default_rng(5)
    for size in (5, 9, 14, 40, 133, 700):
        for _ in range(20):
            one = np.unique(dice.integers(0, 1 << 63, size, dtype=np.int64).view(np.uint64))
            other = one
            while True:
                more = np.unique(np.append(np.delete(other, 0), dice.integers(0, 1 << 63, 1).astype(np.uint64)))
                common = len(np.intersect1d(one, more))
                if 100 * common < 80 * (len(one) + len(more) - common):
                    break
                other = more
            number = max(ngram_join.band(len(one)), ngram_join.band(len(other)))
            (a, empty_a), (b, _) = ngram_join.signatures(one, number), ngram_join.signatures(other, number)
            assert len(np.intersect1d(a, b)) + empty_a >= 1 + ngram_join.scheme(number)[1]


def test_neighbourhoods_are_few_and_meet_for_linked_pairs():
    dice = np.random.default_rng(29)
    tried = 0
    for turn in range(600):
        size = int(dice.integers(20, 600))
        number = ngram_join.band(size)
        total, slack, enough = ngram_join.scheme(number)
        apart = ngram_join.differing(size, size)

        def segment(x):
            return (((x * ngram_join._ODD[2]) >> np.uint64(32)) * np.uint64(total)) >> np.uint64(32)

        # Equally large sets, as far apart as a linked pair may be, their differences in as many segments as can be.
        one = np.unique(dice.integers(0, 1 << 63, size, dtype=np.uint64))
        new = dice.integers(0, 1 << 63, 20 * size, dtype=np.uint64)
        hit, gone, more = set(), [], []
        for source, out in ((one, gone), (new, more)):
            for x, place in zip(source, segment(source)):
                if len(out) < apart // 2 and place not in hit and place >= total - ngram_join.asked(size, number):
                    hit.add(place)
                    out.append(x)
        other = np.sort(np.append(np.setdiff1d(one, gone), np.array(more, np.uint64)))
        assert len(other) == len(one)
        signed = [ngram_join.signatures(x, number) for x in (one, other)]
        shared = np.intersect1d(signed[0][0], signed[1][0])
        # Signatures that both have are dear first, then others of each by itself.
        room = [enough - empty for _, empty in signed]
        if min(room) < len(shared):
            continue
        dear = [set(shared.tolist()) for _ in signed]
        for i, (own, empty) in enumerate(signed):
            rest = np.setdiff1d(own, shared)
            dear[i] |= set(dice.permutation(rest)[: room[i] - len(shared)].tolist())
        if min(len(d) + empty for d, (_, empty) in zip(dear, signed)) <= slack:
            continue
        tried += 1
        rows = [ngram_join.neighbourhoods(x, number, d) for x, d in zip((one, other), dear)]
        assert len(np.intersect1d(*rows))
        for x, found in zip((one, other), rows):
            assert len(found) < len(x) / 2
    assert tried > 20


def test_long_chain_is_one_component(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 900), (900, 950), (7000, 7000)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint"), "chain").collect())
    assert got == {i: 0 for i in range(1, 201)} | {1000: 900, 950: 900}


def test_components_of_random_graphs(spark):
    dice = np.random.default_rng(6)
    for nodes, count in ((40, 25), (60, 200), (300, 250)):
        edges = [(int(a), int(b)) for a, b in dice.integers(0, nodes, (count, 2))]
        smallest = list(range(nodes))
        for _ in range(nodes):
            for a, b in edges:
                smallest[a] = smallest[b] = min(smallest[a], smallest[b])
        got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint"), "random").collect())
        assert got == {node: least for node, least in enumerate(smallest) if least != node}


def test_prefixes_meet_under_any_order(spark, monkeypatch):
    """Linked sets share a shingle of both prefixes, also where many shingles fall into one bucket."""
    dice = np.random.default_rng(3)
    rows, pairs = [], []
    for number in range(0, 400, 2):
        one = np.unique(dice.integers(-(1 << 62), 1 << 62, dice.integers(1, 60)))
        other = np.unique(np.append(dice.permutation(one)[: max(1, len(one) * 9 // 10)], dice.integers(0, 1 << 62, len(one) // 12)))
        common = len(np.intersect1d(one, other))
        if 100 * common >= 80 * (len(one) + len(other) - common):
            pairs.append((number, number + 1))
        rows += [(number, one.tolist(), True), (number + 1, other.tolist(), False)]
    sets = spark.createDataFrame(rows, "doc_id bigint, tokens array<bigint>, hard boolean")
    for buckets in (1, 64, 1 << 20):
        monkeypatch.setattr(ngram_join, "COUNTED_BUCKETS", buckets)
        found = {}
        for row in ngram_join.prefix_rows(sets).collect():
            found.setdefault(row.doc_id, set()).add(row.sig)
        assert len(pairs) > 50 and all(found[a] & found[b] for a, b in pairs)


def test_parities_never_differ_in_more_places_than_the_sets():
    dice = np.random.default_rng(8)
    for _ in range(200):
        one = np.unique(dice.integers(0, 1 << 62, dice.integers(1, 400)).astype(np.uint64))
        kept = one[dice.random(len(one)) < dice.random()]
        other = np.unique(np.append(kept, dice.integers(0, 1 << 62, dice.integers(1, 200)).astype(np.uint64)))
        bits = ngram_join.differing_bits(ngram_join.parities(one), ngram_join.parities(other))
        assert bits <= len(np.setxor1d(one, other))
        assert ngram_join.differing_bits(ngram_join.parities(one), ngram_join.parities(one)) == 0


@pytest.mark.parametrize(("seed", "frequent"), [(4, 64), (5, 2)])
def test_repeated_rows_match_all_pairs(spark, seed, frequent):
    """Rows stand up to three times; short texts are near longer ones that hold them."""
    dice = random.Random(seed)
    rows = corpus(seed, 20)
    for i in range(60):
        size = dice.randrange(8, 40)
        words = [f"r{i}x{k}" for k in range(size + 4)]
        longer = words + [f"s{i}x{k}" for k in range(size // 5)]
        rows += [(2_000 + 2 * i, " ".join(words)), (2_001 + 2 * i, " ".join(longer))]
    rows = [row for row in rows for _ in range(dice.choice([1, 2, 3]))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = ngram_join.near_duplicates(frame, frequent).collect()
    assert sorted((tuple(row) for row in got), key=repr) == brute_force(rows)


def several_texts():
    """Triples of documents: a text, the same one and another one, one near that other one."""
    rows = []
    for i in range(0, 120, 3):
        one, other = ([f"{kind}{i}x{k}" for k in range(60)] for kind in "ab")
        rows += [(i, " ".join(one)), (i + 1, " ".join(one)), (i + 1, " ".join(other)), (i + 2, " ".join(other[:-2]))]
    return rows


def test_documents_with_several_texts(spark):
    rows = several_texts()
    parts = [spark.createDataFrame(rows[k::4], "doc_id bigint, text string").coalesce(1) for k in range(4)]
    frame = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    got = ngram_join.near_duplicates(frame).collect()
    assert sorted((tuple(row) for row in got), key=repr) == brute_force(rows)


def test_lists_of_the_same_documents_keep_their_sizes(spark):
    rows = [("x", 1, 10), ("x", 2, 13), ("y", 1, 90), ("y", 2, 90), ("z", 1, 90), ("z", 2, 90)]
    rows = [(*row, True) for row in rows] + [("v", 5, 9, False), ("v", 6, 9, False), ("w", 7, 9, True)]
    got = ngram_join.distinct_lists(spark.createDataFrame(rows, "sig string, doc_id bigint, size bigint, useful boolean")).collect()
    assert sorted((row.doc_id, row.size) for row in got) == [(1, 10), (1, 90), (2, 13), (2, 90)]


def test_one_of_each_keeps_other_texts_of_a_document(spark):
    """Rows with one doc_id go only for a row that is equal or near."""
    rows = [*several_texts(), (500, "a b c d e f"), (500, "A b c  d e f"), (500, "quite another text"), (501, ""), (501, None), (502, " ")]
    frame = spark.createDataFrame([*rows, (None, "a b c d e f")], "doc_id bigint, text string").repartition(4)
    got = ngram_join.one_of_each(frame).collect()
    expected = [(i, shingle_set(text)) for i, text in rows if i < 500 and i % 3 == 0]
    expected += [(i, shingle_set(text)) for i, text in several_texts() if i % 3 == 1 and text[0] == "b"]
    expected += [(500, shingle_set("a b c d e f")), (500, shingle_set("quite another text")), (501, frozenset()), (502, frozenset())]
    known = [(row.doc_id, shingle_set(row.text)) for row in got if row.doc_id is not None]
    assert sorted(known, key=repr) == sorted(expected, key=repr)
    assert [row.text for row in got if row.doc_id is None] == ["a b c d e f"]
