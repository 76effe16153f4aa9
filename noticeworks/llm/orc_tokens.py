"""Token ids as ORC files: run-length encoded integers, row indexes and Bloom filters on ids.

`write_tokens` deals the documents out by ranges of doc_id, so that file k holds only
smaller ids than file k + 1 and each file is ascending. Each row keeps its place in its
file (`local_start`); a reader adds the sizes of the files before. ORC stores the ids in
stripes with integer run-length encoding; its row indexes (minimum and maximum for every
`ROW_GROUP` rows) and Bloom filters on doc_id let a reader skip stripes and row groups,
and Spark reads the stripes of a file in parallel.

Defined cases: a null text is empty and yields the end id alone; null doc_ids come first;
rows with equal doc_id are ordered by their text; an empty table gives an empty folder of
files and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeworks.llm.common import list_values
from noticeworks.llm.word_tokens import encode_rows, id_lists, read_vocabulary

SCHEMA = "doc_id bigint, local_start bigint, n_tokens bigint, ids array<int>"
#: Rows for which the row index and the Bloom filter keep one entry.
ROW_GROUP = 1_000
STRIPE_BYTES = 64 << 20


def write_tokens(documents: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Encodes every whole text and writes ORC files in ascending doc_id order below `path`."""
    encode = encode_rows(read_vocabulary(vocabulary), end_id)

    def run(batches):
        start = 0
        for doc_id, rows in encode(batches):
            counts = np.fromiter((len(row) // 4 for row in rows), np.int64, len(rows))
            starts = start + np.cumsum(counts) - counts
            start += int(counts.sum())
            yield pa.record_batch(
                [doc_id, pa.array(starts), pa.array(counts), id_lists(rows)],
                names=["doc_id", "local_start", "n_tokens", "ids"],
            )

    (
        documents.select("doc_id", "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, SCHEMA)
        .write.option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROW_GROUP))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.encoding.strategy", "COMPRESSION")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids.

    The sizes of the files are summed from two narrow columns: one row per file.
    """
    rows = spark.read.schema(SCHEMA).orc(path).withColumn("file", F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long"))
    sizes = rows.groupBy("file").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("size"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("file", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "file").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids"
    )


def find_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents: the condition reaches the ORC reader, which prunes by index and Bloom filter."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows.where(F.col("doc_id").isin([int(i) for i in doc_ids])).select("doc_id", "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """Replaces ids by ids_crc32, the unsigned crc32 of little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            values, offsets = list_values(batch.column(3))
            values = values.astype("<u4", copy=False)
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
            yield pa.record_batch(
                [*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
