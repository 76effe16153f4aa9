"""A Spark data source for archives of feed pages, read by range.

An archive is cut into byte ranges, one for each task, whatever the number of archives. A
task reads the archive's directory from its end, takes the members that begin in its own
range and reads these one by one, each by its own range of bytes. So an archive of any size
keeps as many tasks busy as it has ranges, no task holds more than one member, and a lost
task reads its range again. The driver looks only at file sizes.

Files are opened through Arrow's file systems, which know local paths, shared folders and
the common object stores. `readable` tells whether a path is one of them.
"""

from __future__ import annotations

import json
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from noticeworks.sources.members import unpacked

NAME = "notice_archives"
SCHEMA = "path string, member string, text string, error string"
#: Bytes of an archive that one task answers for.
RANGE_BYTES = 32 << 20
_LOCAL_HEADER = 30


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path there."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def readable(path: str) -> bool:
    try:
        opened(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def archive_files(paths: list[str]) -> list[tuple[str, int]]:
    """Path and size of every archive: of a folder all `.zip` files directly in it."""
    found = []
    for path in paths:
        system, inside = opened(path)
        info = system.get_file_info(inside)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == fs.FileType.File:
            found.append((path, info.size))
            continue
        for one in sorted(system.get_file_info(fs.FileSelector(inside)), key=lambda one: one.base_name):
            if one.type == fs.FileType.File and one.base_name.endswith(".zip"):
                found.append((f"{path.rstrip('/')}/{one.base_name}", one.size))
    return found


@dataclass
class ByteRange(InputPartition):
    """The members of an archive that begin at `start` or later and before `end`."""

    path: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, paths: list[str], range_bytes: int):
        self.paths, self.range_bytes = paths, range_bytes

    def partitions(self) -> list[ByteRange]:
        return [
            ByteRange(path, start, min(start + self.range_bytes, max(size, 1)))
            for path, size in archive_files(self.paths)
            for start in range(0, max(size, 1), self.range_bytes)
        ]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        for member, text, error in members(partition):
            columns = [[partition.path], [member], [text], [error]]
            yield pa.record_batch([pa.array(c, pa.string()) for c in columns], names=["path", "member", "text", "error"])


def members(part: ByteRange) -> Iterator[tuple[str | None, str | None, str | None]]:
    """Name and text, or what is wrong, of the feed pages that begin in a range of an archive."""
    system, inside = opened(part.path)
    with system.open_input_file(inside) as file:
        try:
            infos = zipfile.ZipFile(file).infolist()
        except (zipfile.BadZipFile, struct.error, pa.ArrowInvalid) as fault:
            # The whole archive can't be read; its first range says so.
            if part.start == 0:
                yield None, None, f"archive unreadable: {fault}"
            return
        for info in infos:
            if part.start <= info.header_offset < part.end and info.filename.endswith(".atom"):
                yield info.filename, *_text(file, info)


def _text(file: pa.NativeFile, info: zipfile.ZipInfo) -> tuple[str | None, str | None]:
    if info.flag_bits & 1:
        return None, "member encrypted"
    try:
        # Name and extra field are given again before the content, often with another length.
        file.seek(info.header_offset)
        lengths = struct.unpack("<HH", file.read(_LOCAL_HEADER)[26:])
        file.seek(info.header_offset + _LOCAL_HEADER + sum(lengths))
        return unpacked(file.read(info.compress_size), info.compress_type, info.CRC), None
    except (struct.error, pa.ArrowInvalid):
        return None, "member damaged"
    except ValueError as fault:
        return None, str(fault)


class ArchiveSource(DataSource):
    """Feed pages of archives: option `paths` (JSON list) and, if wanted, `rangeBytes`."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(json.loads(self.options["paths"]), int(self.options.get("rangeBytes", RANGE_BYTES)))


def read_archives(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every feed page packed in the archives: path, member and its text, or an error."""
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format(NAME).option("paths", json.dumps(paths)).option("rangeBytes", str(range_bytes))
    return reader.load()
