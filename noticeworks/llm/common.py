"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from noticeworks.session import shared_dir, ship_package
from noticeworks.sources.tables import read_table

_BATCH_BYTES, _BATCH_BYTES_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

#: Input tables that only these operators read.
TABLES = {"pages": "page_id bigint, url string, html string", "benchmark": "item_id bigint, text string"}

#: Rows of a batch are worked on in blocks of about this many bytes of text.
BLOCK_BYTES = 4 << 20


def open_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """An input table, with this package handed to the Python workers, in batches of bounded size."""
    ship_package(spark)
    # Larger batches only cost memory here; a smaller setting of the caller's stays.
    if spark.conf.get(_BATCH_BYTES) == _BATCH_BYTES_DEFAULT:
        spark.conf.set(_BATCH_BYTES, BLOCK_BYTES)
    if name in TABLES:
        return spark.read.schema(TABLES[name]).parquet(f"{directory.rstrip('/')}/{name}.parquet")
    return read_table(spark, directory, name)


def free_names(frame: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores before it as it takes to differ from all columns of a table."""
    taken = {column.lower() for column in frame.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
    return found


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back, so that a lost executor costs no recomputation."""
    path = shared_dir(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as bytes one after another, and where each begins; a null text is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    everything = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return everything[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> list[bytes]:
    """Each text of a column as UTF-8 bytes; a null text is empty."""
    data, offsets = utf8(column)
    whole = data.tobytes()
    places = offsets.tolist()
    return [whole[a:b] for a, b in zip(places, places[1:])]


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each part holds about `size` bytes of text, one row at least."""
    for batch in batches:
        offsets = utf8(batch.column(batch.schema.get_field_index(column)))[1]
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def lists(values: np.ndarray, lengths) -> pa.ListArray:
    """A list column from the values of all rows and the length of each."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def list_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists of a column and where each list begins; a null list is empty."""
    if not len(column):
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    offsets = np.zeros(len(column) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return column.flatten().to_numpy(zero_copy_only=False), offsets
