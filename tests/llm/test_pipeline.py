"""The pipeline's stages on a small table, and the registration of all queries."""

import __spark_entry__ as entry
import corpus_pipeline

import re

import pytest
from pyspark.sql import functions as F

from noticeworks.llm import cascade, ngram_join, queries, secret_ledger
from noticeworks.llm.common import open_table


def test_every_operator_and_the_pipeline_are_registered():
    names = entry.queries()
    assert "pipeline" in names and set(queries.QUERIES) <= set(names)
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_stages(spark, small_dir):
    docs = open_table(spark, small_dir, "documents")
    columns, before = docs.columns, {row.doc_id: row.text for row in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, small_dir).cache()
        rows = after.collect()
        if name != "best-fit packing":
            assert after.columns == columns
            kept = {row.doc_id: row.text for row in rows}
            assert len(kept) == len(rows) and set(kept) <= set(before)
        if name == "quality rules":
            rejects = {i for i, text in before.items() if any(r.rejects(cascade.Page(text.encode())) for r in cascade.RULES)}
            assert set(kept) == set(before) - rejects
        elif name == "n-gram Jaccard join":
            groups = ngram_join.near_duplicates(docs).collect()
            assert set(kept) == {row.component_id for row in groups}
        elif name == "secret scans":
            assert set(kept) == set(before)
            rules = [(rule, re.compile(rule.pattern)) for rule in secret_ledger.RULES]
            for i, text in before.items():
                assert (kept[i] == text) == (not secret_ledger.find(text.encode(), rules))
        elif name == "best-fit packing":
            assert {row.doc_id for row in rows} == set(before)
            assert all(len(row.ids) == row.length for row in rows)
        if name != "best-fit packing":
            before, docs = kept, after


GOOD = "The committee met on {} and agreed, after a long talk, that the bridge over the river {} should be mended before winter comes."
SECRET = GOOD.format("Monday", "Avon") + " password = hunter2hunter2 was the note left on the table for them."


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """Tables with nulls in every column, empty, blank and very long texts, repeated rows and clashing extra columns."""
    folder = str(tmp_path_factory.mktemp("odd"))
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, GOOD.format("Monday", "Avon")), (2, GOOD.format("Monday", "Avon")), (2, GOOD.format("Monday", "Avon"))]
    rows += [(3, SECRET), (4, ""), (5, None), (6, " \n\t "), (7, long), (8, long + " tail"), (None, GOOD.format("Friday", "Tees"))]
    rows += [(9, "You are a grolm and grolmer. " + GOOD.format("Tuesday", "Cam")), (10, "# # # # # # # # # # # # # #")]
    # Toxic, with a secret, of the long text's kind, plain: a model learns from 60 of each 80.
    ends = [" you grolm grolmer", " password = hunter2hunter2 was the note left for them", " " + long[:400], ""]
    rows += [(100 + i, GOOD.format(f"day {i}", f"stream{i} near the old mill, {i * i}") + ends[i % 4]) for i in range(80)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    documents = spark.createDataFrame([(i, text, None, "src" if i else None, None) for i, text in rows], schema)
    documents.write.parquet(f"{folder}/documents.parquet")
    labels = [(100 + i, 1, int(i % 4 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_run_on_odd_rows(spark, odd_dir):
    rows = corpus_pipeline.run(spark, odd_dir).collect()
    kept = {row.doc_id for row in rows}
    # Toxic, short and empty texts and copies are gone; one of each group and the row without an id stay.
    assert {1, 3, 7, None} <= kept and not kept & {2, 4, 5, 6, 8, 9, 10}
    assert {i for i in kept if i and i >= 100} == {100 + i for i in range(80) if i % 4}
    assert sum(row.length for row in rows if row.doc_id == 7) > 60_000


def test_stages_on_clashing_columns_and_empty_tables(spark, odd_dir):
    names = "blob salt spans span node number n component kept group bits size score label features _node _blob sig".split()
    docs = open_table(spark, odd_dir, "documents").select("*", *[F.lit(f"x{i}").alias(name) for i, name in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, odd_dir)
        if name != "best-fit packing":
            assert after.columns == docs.columns
            assert all(row[n] == f"x{i}" for row in after.collect() for i, n in enumerate(names))
        else:
            assert after.count() >= docs.count()
        empty = stage(spark, docs.limit(0), odd_dir)
        assert empty.columns == after.columns and empty.count() == 0
