"""The corpus pipeline: five stages, each over all that the one before it kept.

Toxic documents go, then those that a quality rule rejects; one document of each group of
near duplicates stays; secrets are replaced by a marker; what is left is packed into
sequences of tokens. The first four return the columns of `documents`.

Defined cases, in every stage: a null text is an empty one for scores, rules, shingles,
secrets and tokens, and stays null where its row is kept; it and an empty or blank text are
rejected by the quality rules, and where a stage runs by itself they belong to no group of
near duplicates and pack to their end token. Rows with a null doc_id are judged like others,
belong to no group of near duplicates, and stay. Rows that share a doc_id are told apart by
their text; repeated rows are one group. Texts of any length are worked on whole. Extra
columns, whatever their names, are kept by the first four stages and ignored by the last. A
null lang, source, n_chars or label changes nothing. Without labels nothing is called toxic.
Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from noticeworks.llm import cascade, ngram_join, packing, queries, secret_ledger, toxicity
from noticeworks.llm.common import open_table, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, doesn't call toxic."""
    model = toxicity.fit(docs, open_table(spark, sf_dir, "labels"))
    return toxicity.clean_rows(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return cascade.kept_rows(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a marker."""
    return secret_ledger.redact(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document with its ids, its sequence and its place there."""
    vocabulary = public_tokenizers.path(queries.WORD_VOCABULARY)
    return packing.packed(docs, vocabulary, end_id=1, capacity=queries.CAPACITY, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_tokens),
]

#: SQL can state neither the fitted classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each result is written and read again."""
    docs = open_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
