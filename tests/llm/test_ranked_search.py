"""Ranked search against a plain scan of all documents for every item."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from noticeworks.llm import ranked_search as ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(documents, items, k=10):
    counted = [(doc_id, Counter(plain_terms(text))) for doc_id, text in documents]
    counted = [(doc_id, counts) for doc_id, counts in counted if counts]
    total, length = len(counted), sum(sum(counts.values()) for _, counts in counted)
    df = Counter(term for _, counts in counted for term in counts)
    wanted = {}
    for item, text in items:
        if item is not None:
            wanted.setdefault(item, set()).update(plain_terms(text))
    rows = []
    for item, words in wanted.items():
        scores = []
        for doc_id, counts in counted:
            m = 100 - 90 + 90 * sum(counts.values()) * total // length
            score = 0
            for word in words & counts.keys():
                weight = math.floor(1000 * math.log((2 * total + 2) / (2 * df[word] + 1)))
                score += weight * (1_000_000_000 * counts[word] // (1000 * counts[word] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        rows += [(item, rank, None if lost else doc_id, -s) for rank, (s, lost, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return rows


def sorted_rows(rows):
    return sorted((tuple(row) for row in rows), key=repr)


def corpus(count, seed=7):
    dice = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    common = 1 / np.arange(1, 61)
    return [(i, " ".join(dice.choice(words, int(dice.integers(1, 40)), p=common / common.sum()))) for i in range(count)]


ITEMS = [
    (1, "w1 w2 w3 W4, w40-w41/w59"),
    (2, " ".join(f"w{i}" for i in range(60)) + " " + " ".join(f"no{i}" for i in range(90))),
    (3, "w59"),
    (4, "nothing here"),
    (5, None),
    (6, ""),
    (None, "w1"),
    (7, "w5 w6"),
    (7, "w6 w7 w50"),
]


def frames(spark, documents, items):
    left = spark.createDataFrame([(*row, 9, 8, "x") for row in documents], "doc_id bigint, text string, n int, score int, terms string")
    right = spark.createDataFrame([(*row, 1, 2) for row in items], "item_id bigint, text string, rank int, doc_id int")
    return left.repartition(4), right


@pytest.mark.parametrize("block", [4096, 37])
def test_all_items_give_what_a_scan_gives(spark, monkeypatch, block):
    documents = corpus(600) + [(1000 + i, "w59 w1 w2") for i in range(300)]  # a large group of copies
    documents += [(None, "w59 w59"), (3, "w3"), (3, "w3"), (2000, None), (2001, ""), (2002, " ... \n"), (2003, "w1 " * 30_000)]
    monkeypatch.setattr(ranked, "BLOCK_DOCUMENTS", block)
    got = ranked.search(*frames(spark, documents, ITEMS), k=10)
    assert sorted_rows(got.collect()) == sorted_rows(brute(documents, ITEMS))


def test_blocks_of_items_give_the_same(spark):
    documents = corpus(200, seed=3)
    got = ranked.search(*frames(spark, documents, ITEMS), k=3, pairs=20)
    assert sorted_rows(got.collect()) == sorted_rows(brute(documents, ITEMS, k=3))


def test_odd_texts(spark, odd, odd_rows):
    items = [(i, text) for i, (_, text) in enumerate(odd_rows)]
    right = spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted_rows(ranked.search(odd, right, k=4).collect()) == sorted_rows(brute(odd_rows, items, k=4))


def test_empty_tables(spark):
    left, right = frames(spark, corpus(5), ITEMS)
    assert ranked.search(left.limit(0), right).count() == 0
    assert ranked.search(left, right.limit(0)).count() == 0


@pytest.mark.parametrize("piece", [1, 2, 7, 64])
def test_pieces_cut_no_term(monkeypatch, piece, odd_rows):
    monkeypatch.setattr(ranked, "PIECE", piece)
    for _, text in odd_rows:
        text = (text or "")[:3000]
        got = [term.decode() for part in ranked.terms(text.encode()) for term in part]
        assert got == plain_terms(text)


def test_most_documents_are_left_out():
    documents = corpus(3000, seed=2)
    number = {f"w{i}": i for i in range(60)}
    counts = [Counter(number[w] for w in text.split()) for _, text in documents]
    found = np.concatenate([sorted(c) for c in counts])
    times = np.concatenate([[c[t] for t in sorted(c)] for c in counts])
    starts = np.cumsum([0, *map(len, counts)])
    df = np.bincount(found, minlength=60)
    weights = np.floor(1000 * np.log((2 * 3000 + 2) / (2 * df + 1))).astype(np.int64)
    n = np.array([sum(c.values()) for c in counts])
    query = ranked.Query([1], [], weights, 3000, int(n.sum()))
    block = ranked.Block(query, ranked.pa.array(range(3000)), n, found, times, starts)
    best = ranked.Best(10)
    members = np.array([1, 3, 20, 45, 59])
    touched = np.isin(found, members)
    scored = ranked.search_block(block, members, weights, best)
    assert 0 < scored < len(set(np.repeat(np.arange(3000), np.diff(starts))[touched])) / 4
