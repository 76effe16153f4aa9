"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTS = 1 << 30
#: A sample aims at this part of what it may hold.
DRAWN = 0.98


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % F.lit(folds)


def label_rows(labels: DataFrame, name: str, folds: int, held_out: int) -> DataFrame:
    """doc_id and label (0 or 1) of the rows that may be learnt from.

    Null ids and null labels are left out; of several labels for one id the largest counts.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull() & (fold("doc_id", folds) != held_out))
        .groupBy("doc_id")
        .agg(F.max(name).cast("int").alias("label"))
    )


def at_most(rows: DataFrame, count: int, seed: int) -> DataFrame:
    """About `count` rows and never more, chosen by a hash of doc_id; all rows where there are fewer."""
    total = rows.count()
    if total <= count:
        return rows
    chosen = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(_PARTS)) < F.lit(int(DRAWN * count / total * _PARTS))
    return rows.where(chosen).limit(count)


def at_most_by_class(rows: DataFrame, count: int, seed: int) -> tuple[DataFrame, list[float]]:
    """About `count` rows (doc_id, label) and never more, half of them for each label where it has as many,
    and the share of each label's rows that was drawn."""
    sizes = {0: 0, 1: 0} | {row.label: row["count"] for row in rows.where("label in (0, 1)").groupBy("label").count().collect()}
    rare = min(sizes, key=lambda label: (sizes[label], label))
    wanted = {rare: min(sizes[rare], count // 2)}
    wanted[1 - rare] = min(sizes[1 - rare], count - wanted[rare])
    parts = [at_most(rows.where(F.col("label") == label), wanted[label], seed) for label in (0, 1)]
    drawn = [1.0 if wanted[label] == sizes[label] else DRAWN * wanted[label] / sizes[label] for label in (0, 1)]
    return parts[0].unionByName(parts[1]), drawn
