"""A data source of record lines: JSON lines with their exact place, in byte ranges, as a table and as a stream.

    register(spark)
    spark.read.format("record_lines").load(path)
    spark.readStream.format("record_lines").load(path)

Columns: file, offset (of the line's first byte), status, hive, day, time, path,
reason. Files (and folders of files) are on a file system that all executors mount.
A file is read in ranges of `rangeBytes`; a line belongs to the range in which it
begins, so (file, offset) orders lines whatever the ranges. Lines that are no JSON
objects, whose keys are no text, or whose status is unknown are skipped. A filter
`status = ...` is pushed into the reader, and lines without that text aren't parsed.
A stream takes lines that are appended; a line counts once its line end is there.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition

STATUSES = ("downloaded", "unavailable", "failed")
SCHEMA = "file string, offset long, status string, hive string, day string, time string, path string, reason string"


@dataclass
class Range(InputPartition):
    file: str
    start: int
    stop: int


def files_of(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isfile(path):
        return [path]
    return sorted(e.path for e in os.scandir(path) if e.is_file() and not e.name.startswith(("_", ".")))


def parsed(line: bytes, status: str | None) -> tuple | None:
    """(status, hive, day, time, path, reason) of a line, or None if it is none."""
    if status is not None and status.encode() not in line and b"\\" not in line:  # escapes may spell it
        return None
    try:
        record = json.loads(line)
    except ValueError:
        return None
    keys = ("status", "hive", "day", "time")
    if not isinstance(record, dict) or not all(isinstance(record.get(k), str) for k in keys) or record["status"] not in STATUSES or status not in (None, record["status"]):
        return None
    as_text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    return (*(record[k] for k in keys), as_text(record.get("path")), as_text(record.get("reason")))


def lines_in(part: Range, status: str | None) -> Iterator[tuple]:
    """Rows of the lines that begin in a range."""
    with open(part.file, "rb") as f:
        at = part.start
        if at:
            f.seek(at - 1)
            at += len(f.readline()) - 1  # a line that goes on from before belongs to the range before
        while at < part.stop:
            f.seek(at)
            line = f.readline()
            if not line:
                return
            if (row := parsed(line, status)) is not None:
                yield (part.file, at, *row)
            at += len(line)


class RecordReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size, self.status = path, size, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("status",) and isinstance(f.value, str) and f.value in STATUSES and self.status in (None, f.value):
                self.status = f.value
            else:
                yield f

    def partitions(self) -> list[Range]:
        return [Range(f, a, min(a + self.size, n)) for f in files_of(self.path) for n in [os.path.getsize(f)] for a in range(0, n, self.size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return lines_in(partition, self.status)


class RecordStream(DataSourceStreamReader):
    """Offsets: the bytes of each file that are read, up to a line end."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f: whole_size(f) for f in files_of(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(f, a, min(a + self.size, n)) for f, n in sorted(end.items()) for a in range(start.get(f, 0), n, self.size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return lines_in(partition, None)

    def commit(self, end: dict) -> None:
        pass


def whole_size(file: str) -> int:
    """The bytes of a file up to its last line end."""
    with open(file, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > 0:
            begin = max(0, at - 4096)
            f.seek(begin)
            found = f.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return 0


class RecordLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_lines"

    def schema(self) -> str:
        return SCHEMA

    def _parameters(self) -> tuple[str, int]:
        return self.options["path"], max(1, int(self.options.get("rangeBytes", 64 << 20)))

    def reader(self, schema) -> RecordReader:
        return RecordReader(*self._parameters())

    def streamReader(self, schema) -> RecordStream:
        return RecordStream(*self._parameters())


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let Python sources take filters, without which Spark refuses one that does."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordLines)
