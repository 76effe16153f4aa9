"""Classifiers, packing and nearest neighbours: held-out accuracy, invariants and brute force."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from noticeworks.llm import labelled, multi_index, packing, pu_quality, queries, toxicity
from noticeworks.llm.common import open_table

WORDS = P.path(queries.WORD_VOCABULARY)


def labelled_corpus(spark, rows=1_500):
    """English-like noise; toxic texts hold a word of an invented family, bad ones are full of signs."""
    dice = np.random.default_rng(4)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
    documents, labels = [], []
    for doc_id in range(rows):
        words = ["".join(dice.choice(syllables, dice.integers(1, 4))) for _ in range(dice.integers(20, 80))]
        toxic, bad = doc_id % 8 == 0, doc_id % 6 == 1
        if toxic:
            for _ in range(2):
                words.insert(dice.integers(len(words)), "grolm" + dice.choice(syllables))
        if bad:
            words = [word + "%%%" for word in words]
        documents.append((doc_id, " ".join(words), "xx", "src", 0))
        if doc_id % 5:
            labels.append((doc_id, int(not bad), int(toxic)))
    frame = spark.createDataFrame(documents, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return frame.repartition(4), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), documents


@pytest.fixture(scope="module")
def corpus(spark):
    return labelled_corpus(spark)


def test_toxicity_held_out(spark, corpus):
    documents, labels, _ = corpus
    model = toxicity.fit(documents, labels)
    rows = toxicity.scored(documents, model).collect()
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0) for row in rows)
    right = [row.predicted == (row.doc_id % 8 == 0) for row in rows if row.held_out]
    assert np.mean(right) > 0.98
    assert all(0 <= row.score <= 1 and row.predicted == (row.score >= 0.5) for row in rows)
    kept = toxicity.clean_rows(documents, model)
    assert kept.columns == documents.columns
    assert {row.doc_id for row in kept.collect()} == {row.doc_id for row in rows if not row.predicted}


def test_quality_held_out(corpus):
    documents, labels, _ = corpus
    model = pu_quality.fit(documents, labels)
    assert 0.7 < model.prior < 0.97
    rows = pu_quality.scored(documents, model).collect()
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1) for row in rows)
    right = [row.predicted == (row.doc_id % 6 != 1) for row in rows if row.held_out]
    assert np.mean(right) > 0.95


def test_labels_of_the_held_out_fold_change_nothing(corpus):
    """Turning over the labels that may not be learnt from leaves every score as it is."""
    documents, labels, _ = corpus
    crc = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    turned = labels.withColumn("toxic", F.when(crc % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = toxicity.fit(documents, labels), toxicity.fit(documents, turned)
    assert sorted(one.buckets) == sorted(other.buckets) and abs(one.bias - other.bias) < 1e-9


def test_models_without_labels_and_on_odd_texts(spark, corpus, odd, none):
    documents, labels, _ = corpus
    no_labels = labels.limit(0)
    for row in toxicity.scored(odd, toxicity.fit(documents, no_labels)).collect():
        assert row.score < 0.5
    assert pu_quality.fit(documents, no_labels) is None
    assert {row.score for row in pu_quality.scored(odd, None).collect()} == {0.5}
    nulls = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (4, 1, 0)], labels.schema))
    for module in (toxicity, pu_quality):
        model = module.fit(documents, nulls)
        scores = module.scored(odd, model).collect()
        assert len(scores) == odd.count() and all(0 <= row.score <= 1 for row in scores)
        assert module.scored(none, model).collect() == []


def check_packing(rows, texts, capacity=4096):
    """Every piece once, by the library's ids, in sequences without gaps or overflow."""
    tokenizer = Tokenizer.from_file(WORDS)
    expected = []
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for start in range(0, len(ids), capacity):
            part = ids[start : start + capacity]
            expected.append((doc_id, start // capacity, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(tuple(row)[:5] for row in rows) == sorted(expected)
    filled = {}
    for row in sorted(rows, key=lambda row: (row.sequence_id, row.offset)):
        assert row.offset == filled.get(row.sequence_id, 0)
        filled[row.sequence_id] = row.offset + row.length
    assert max(filled.values(), default=0) <= capacity
    return len(filled), -(-sum(part[3] for part in expected) // capacity)


def test_packing(spark, small_dir, odd, odd_rows, none):
    documents = open_table(spark, small_dir, "documents").select("doc_id", "text")
    both = documents.unionByName(odd.select("doc_id", "text"))
    rows = packing.packed(both, WORDS, 1, 4096).collect()
    texts = [(row.doc_id, row.text) for row in both.collect()]
    used, least = check_packing(rows, texts)
    assert used <= least + 1
    assert packing.packed(none, WORDS, 1, 4096).collect() == []


def test_packing_of_several_levels(spark):
    items = spark.range(9_000).select(F.col("id").alias("uid"), (50 + F.col("id") * 7919 % 900).alias("length"))
    rows = items.join(packing.pack(items, 1_000), "uid").collect()
    filled = {}
    for row in sorted(rows, key=lambda row: (row.sequence_id, row.offset)):
        assert row.offset == filled.get(row.sequence_id, 0)
        filled[row.sequence_id] = row.offset + row.length
    assert len(rows) == 9_000 and max(filled.values()) <= 1_000
    # Half of the pieces are longer than half a sequence, so some room is bound to stay empty.
    assert len(filled) <= 1.06 * sum(row.length for row in rows) / 1_000


def test_crossover_keeps_every_item_once():
    dice = np.random.default_rng(2)
    lengths = dice.integers(100, 700, 300).tolist()
    first = packing.evolve(lengths, [], 1_000, 1)
    assert len(first) >= 1
    for assignment in first:
        sums = np.bincount(assignment, weights=lengths)
        assert sums.max() <= 1_000 and sums.min() > 0
    again = packing.evolve(lengths, first, 1_000, 2)
    assert max(again[0]) <= max(first[0])


def test_nearest_neighbours(spark, small_dir):
    table = open_table(spark, small_dir, "embeddings")
    bad = [(9_000, None), (9_020, [0.0] * 64), (9_040, [float("nan")] * 64), (9_060, [None] * 64), (9_080, [1.0] * 3),
           (None, [1.0] * 64)]
    odd = spark.createDataFrame(bad, "vec_id bigint, embedding array<float>")
    # A group of equal vectors: ties go to the smaller ids.
    same = spark.range(30).select((F.col("id") + 5_000).alias("vec_id"), F.array(*[F.lit(0.5 - i % 2) for i in range(64)]).cast("array<float>").alias("embedding"))
    both = table.select("vec_id", "embedding").unionByName(same).unionByName(odd).withColumn("score", F.lit("x"))
    found = multi_index.search(both).toPandas()
    good = {r.vec_id: np.array(r.embedding, float) for r in table.select("vec_id", "embedding").unionByName(same).collect()}
    ids = np.array(sorted(good))
    vectors = np.stack([good[i] for i in ids])
    hits = []
    for query in ids[ids % 20 == 0]:
        own = found[found.query_id == query].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, len(own) + 1)) and query not in set(own.vec_id)
        scores = (vectors * good[query]).sum(1)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != query][:20]
        hits.append(len(set(ids[order]) & set(own.vec_id)) / len(order))
        assert np.allclose(own.score, [good[query] @ good[i] for i in own.vec_id])
        if query >= 5_000:
            assert own.vec_id.tolist() == ids[order].tolist()
    assert np.mean(hits) >= 0.9
    assert set(found.query_id) == set(ids[ids % 20 == 0].tolist())


def test_few_vectors_and_none(spark, small_dir):
    table = open_table(spark, small_dir, "embeddings").where("vec_id in (0, 1, 2, 20)")
    found = multi_index.search(table).collect()
    assert len(found) == 6
    assert multi_index.search(table.limit(0)).collect() == []
    assert multi_index.search(table.where("vec_id = 0")).collect() == []


def test_walk_takes_cells_in_order_of_distance():
    dice = np.random.default_rng(1)
    for _ in range(20):
        one, two = dice.random(7), dice.random(5)
        sizes = dice.integers(0, 3, 35)
        cells = multi_index.walk(one, two, sizes, 10**9)
        distance = (one[:, None] + two[None, :]).ravel()
        assert sorted(cells) == np.flatnonzero(sizes).tolist()
        assert np.all(np.diff(distance[cells]) >= 0)


def test_toxicity_scores_match_plain_loops(corpus):
    """The fitted model's scores, summed gram by gram over sets of plain Python strings."""
    documents, labels, rows = corpus
    model = toxicity.fit(documents, labels)
    weights = dict(zip(model.buckets.tolist(), model.weights.tolist()))

    def bucket(gram):
        """The hash of one n-gram in plain integers of 64 bits."""
        most = (1 << 64) - 1
        mixed = ord(gram[0]) * 0x9E3779B97F4A7C15 & most
        for letter in gram[1:]:
            mixed = (mixed ^ (mixed >> 29) ^ ord(letter)) * 0xBF58476D1CE4E5B9 & most
        return mixed >> 64 - toxicity.BITS

    known = {}
    expected = {}
    for doc_id, text, *_ in rows[:300]:
        whole = text.lower() + "\0"
        found = {whole[i : i + n] for n in toxicity.ORDERS for i in range(len(whole) - n + 1)}
        held = {known.setdefault(gram, bucket(gram)) for gram in found}
        expected[doc_id] = 1 / (1 + np.exp(-sum(weights.get(b, 0.0) for b in held) - model.bias))
    got = {row.doc_id: row.score for row in toxicity.scored(documents.where("doc_id < 300"), model).collect()}
    assert got == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("window", [7, 64])
def test_windows_lose_no_gram(monkeypatch, window):
    texts = [b"", b"ab", "Größe und Maß".encode(), b"x" * 500, b"the quick brown fox " * 30]
    whole = [row.tolist() for row in toxicity.present(texts)]
    monkeypatch.setattr(toxicity, "WINDOW", window)
    assert [row.tolist() for row in toxicity.present(texts)] == whole


def test_a_rare_class_is_drawn_whole_and_its_share_kept(spark, corpus):
    documents, labels, _ = corpus
    model = toxicity.fit(documents, labels, rows=600)
    rows = toxicity.scored(documents, model).collect()
    assert np.mean([row.predicted == (row.doc_id % 8 == 0) for row in rows if row.held_out]) > 0.98
    drawn, shares = labelled.at_most_by_class(labelled.label_rows(labels, "toxic", 5, 0), 600, seed=2)
    sizes = {row.label: row["count"] for row in drawn.groupBy("label").count().collect()}
    assert shares[1] == 1.0 and shares[0] < 0.6 and 500 < sum(sizes.values()) <= 600
    assert sizes[1] == labels.where("toxic = 1").count() - labels.where("toxic = 1 and crc32(cast(doc_id as string)) % 5 = 0").count()


def test_risk_gradient_matches_differences():
    """The slopes that training follows are the derivatives of the non-negative risk."""
    dice = np.random.default_rng(9)
    for prior, shift in ((0.3, 0.0), (0.9, 3.0)):
        p, u = dice.normal(shift, 1, 7), dice.normal(-shift, 1, 11)
        slopes = pu_quality.risk_slopes(p, u, prior)

        def risk(p, u):
            positive, rest = 1 / (1 + np.exp(p)), 1 / (1 + np.exp(-u))
            negative = rest.mean() - prior * (1 / (1 + np.exp(-p))).mean()
            return prior * positive.mean() + negative if negative >= 0 else -negative

        for part, slope in zip((p, u), slopes):
            for place in range(len(part)):
                part[place] += 1e-6
                above = risk(p, u)
                part[place] -= 2e-6
                below = risk(p, u)
                part[place] += 1e-6
                assert slope[place] == pytest.approx((above - below) / 2e-6, abs=1e-6)
