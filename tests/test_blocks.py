"""Counts and rankings block by block against the pairs themselves."""

import pytest
from pyspark.sql import functions as F

from noticeworks.operators import blocks, evaluation, funnel, ranking
from noticeworks.plans import catalog
from test_scale import hot_tables, plan


@pytest.mark.parametrize(
    "name", ["funnel_counts", "funnel_matches", "lexical_topk", "vector_topk", "rrf_fusion"]
)
def test_no_pair_becomes_a_row(spark, small_dir, name):
    text = plan(catalog.QUERIES[name](spark, small_dir))
    assert "FlatMapCoGroupsInArrow" in text and "array_intersect" not in text


@pytest.mark.parametrize("sizes", [(16384, 4096, 1 << 22, 1024), (7, 3, 10, 0)])
def test_blocks_of_any_size_give_all_pairs(spark, monkeypatch, sizes):
    for name, size in zip(("TENDERS", "PROVIDERS", "CELLS", "RARE"), sizes):
        monkeypatch.setattr(blocks, name, size)
    t, p, now = hot_tables(spark, tenders=90, providers=8)
    # Some rows without a place, a list of codes, or with a null among the places and codes.
    t = t.withColumn("location", F.when(F.col("expediente") != "t0003", F.col("location"))).withColumn(
        "cpv_codes", F.when(F.col("expediente") == "t0005", F.array(F.lit(None), F.lit("72000000"))).otherwise(F.col("cpv_codes"))
    )
    p = p.withColumn(
        "locations",
        F.when(F.col("provider_id") == "p04", F.array(F.lit(None), F.lit("L1"))).otherwise(F.col("locations")),
    )
    vector = lambda c: F.array(*[F.lit(float(i)) + (F.hash(c) % 5) for i in range(3)]).cast("array<float>")
    tv = t.select("expediente", F.when(F.hash("expediente") % 9 != 0, vector("expediente")).alias("embedding"))
    pv = p.select("provider_id", vector("provider_id").alias("embedding"))
    rows = funnel.candidate_pairs(
        ranking.unit_vectors(ranking.with_title_terms(t).join(tv, "expediente", "left"), 3),
        ranking.unit_vectors(ranking.query_terms(p).join(pv, "provider_id", "left"), 3),
        now,
    ).select(
        "provider_id",
        "expediente",
        "published_at",
        F.round(ranking.ranking.lexical_score(F.col("title_terms"), F.col("p_query_terms")), 12).alias("score"),
        F.round(1.0 - ranking.ranking.dot(F.col("embedding"), F.col("p_embedding")), 9).alias("distance"),
    ).collect()
    providers = {r["provider_id"] for r in p.select("provider_id").collect()}
    own = {name: [r for r in rows if r["provider_id"] == name] for name in providers}

    def best(value, key, k=5):
        found = {}
        for name, some in own.items():
            kept = sorted((r for r in some if r[value] is not None and (value != "score" or r[value] > 0)), key=key)
            found |= {(name, r["expediente"]): (place, r[value]) for place, r in enumerate(kept[:k], 1)}
        return found

    pairs = ranking.scored_pairs(t, p, now, tv, pv, 3)
    lexical = {(r[0], r[1]): (r["rank"], r["score"]) for r in ranking.lexical_topk(pairs, 5).collect()}
    nearest = {(r[0], r[1]): (r["rank"], r["distance"]) for r in ranking.vector_topk(pairs, 5).collect()}
    assert lexical == best("score", lambda r: (-r["score"], r["expediente"]))
    assert nearest == best("distance", lambda r: (r["distance"], r["expediente"]))
    newest = funnel.newest_matches(t, p, now, limit=3, offset=2).collect()
    ordered = best("published_at", lambda r: (-r["published_at"].timestamp(), r["expediente"]))
    assert {(r[0], r[1]): (r["position"], r["published_at"]) for r in newest} == {
        key: found for key, found in ordered.items() if found[0] > 2
    }
    counts = {r["provider_id"]: r["after_location"] for r in funnel.funnel_counts(t, p, now).collect()}
    assert counts == {name: len(some) for name, some in own.items()}


def test_vectors_move_as_they_are_stored(spark):
    """Single-precision vectors and their lengths reach the blocks, not vectors of doubles."""
    t, p, now = hot_tables(spark, tenders=4, providers=2)
    vector = F.array(F.lit(3.0), F.lit(4.0)).cast("array<float>").alias("embedding")
    pairs = ranking.scored_pairs(t, p, now, t.select("expediente", vector), p.select("provider_id", vector), 2)
    left, right = pairs.sides(lexical=True, vector=True)
    assert left.schema["embedding"].dataType.simpleString() == right.schema["p_embedding"].dataType.simpleString() == "array<float>"
    assert left.select("vector_norm").first()[0] == right.select("p_norm").first()[0] == 5.0


def test_recall_scales_stored_vectors_by_their_lengths(spark):
    judged = spark.createDataFrame([("p", "near", "relevant"), ("p", "long", "not_relevant")], "provider_id string, expediente string, label string")
    vectors = [("near", [1.0, 0.0]), ("long", [90.0, 90.0])]
    t = spark.createDataFrame(vectors, "expediente string, embedding array<float>").withColumn("title", F.lit(""))
    p = spark.createDataFrame([("p", [2.0, 0.0])], "provider_id string, embedding array<float>").withColumn("description", F.lit(""))
    t, p = ranking.with_norms(ranking.with_title_terms(t), 2), ranking.with_norms(ranking.query_terms(p), 2)
    assert t.schema["embedding"].dataType.simpleString() == "array<float>"
    found = {r["method"]: r["recall_1"] for r in evaluation.recall_at_k(judged, t, p, (1,)).collect()}
    assert found == {"lexical": 0.0, "vector": 1.0}


def test_rows_move_to_their_blocks_without_a_move_by_code(spark, small_dir):
    text = plan(catalog.QUERIES["vector_topk"](spark, small_dir))
    assert "hashpartitioning(group" in text and "hashpartitioning(code" not in text
