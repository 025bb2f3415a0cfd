"""Spark data source ``jsonl_places``: lines of text files with their places, for tables and streams.

Files are cut into ranges of ``splitBytes``; a range holds the lines that begin in it, so a large file is read by many tasks, and
a task takes many small ranges, so its number does not grow with that of the files. A line comes with the byte at which it begins, the range and its number there. A stream takes whole lines as files grow: its
offset is, for each file, the byte behind the last line feed, and lies in the query's checkpoint. Files are opened by
``pyarrow.fs``: local and mounted paths, and what it has file systems for.
"""

from __future__ import annotations

import fnmatch
import os.path
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, range_start bigint, nth bigint, start bigint, value string"
SPLIT_BYTES = 32 << 20
TASKS = 64             # of a table whose ranges are small
READ_BYTES = 1 << 20
BATCH_ROWS = 4096


@dataclass
class Range:
    file: str
    begin: int
    end: int


@dataclass
class Ranges(InputPartition):
    """What one task reads."""

    ranges: list[Range]


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """File system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pa.fs.LocalFileSystem(), os.path.abspath(path)


def sizes(path: str, glob: str) -> dict[str, int]:
    """Bytes of each file: ``path`` itself, or what lies in it and fits ``glob``."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == pa.fs.FileType.File:
        return {info.path: info.size}
    found = system.get_file_info(pa.fs.FileSelector(at, allow_not_found=True))
    return {f.path: f.size for f in found if f.type == pa.fs.FileType.File and fnmatch.fnmatch(f.base_name, glob)}


def ranges(files: dict[str, tuple[int, int]], split: int) -> list[Range]:
    """Ranges of at most ``split`` bytes from the first to the second byte of each file."""
    return [Range(name, at, min(at + split, end)) for name, (begin, end) in sorted(files.items()) for at in range(begin, end, split)]


def dealt(parts: list[Range]) -> list[Ranges]:
    """Ranges in order, dealt to tasks of about SPLIT_BYTES, or of a ``TASKS``-th of all where that is less."""
    most = min(SPLIT_BYTES, -(-sum(r.end - r.begin for r in parts) // TASKS))
    out, size = [], most
    for part in parts:
        if size >= most:
            out.append(Ranges([]))
            size = 0
        out[-1].ranges.append(part)
        size += part.end - part.begin
    return out


def lines_of(path: str, part: Range) -> Iterator[tuple[int, bytes]]:
    """Start and bytes of the lines that begin in the range; a line feed ends a line, a return before it is not part of it."""
    with opened(path)[0].open_input_file(part.file) as source:
        at = part.begin
        if at:  # the line that runs into the range belongs to the one before
            source.seek(at - 1)
            at -= 1
        start, held = (at if not part.begin else None), b""
        while start is None or start < part.end:
            data = source.read(READ_BYTES)
            if not data:
                if start is not None and held:
                    yield start, held.removesuffix(b"\r")
                return
            pieces = (held + data).split(b"\n")
            held = pieces.pop()
            for piece in pieces:
                if start is not None:
                    if start >= part.end:
                        return
                    yield start, piece.removesuffix(b"\r")
                    start += len(piece) + 1
                else:
                    start = at + len(piece) + 1
            if start is None:
                at, held = at + len(held), b""  # only the place of the next line feed matters


def batches(path: str, parts: Ranges) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[str, int, int, int, str]] = []

    def made() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], ["file", "range_start", "nth", "start", "value"])

    for part in parts.ranges:
        for nth, (start, line) in enumerate(lines_of(path, part)):
            rows.append((part.file, part.begin, nth, start, line.decode("utf-8", "replace")))
            if len(rows) == BATCH_ROWS:
                yield made()
                rows = []
    if rows:
        yield made()


class _Options:
    def __init__(self, options):
        self.path, self.glob = options["path"], options.get("glob", "*.json*")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))


class Reader(_Options, DataSourceReader):
    def partitions(self) -> list[Ranges]:
        return dealt(ranges({name: (0, size) for name, size in sizes(self.path, self.glob).items()}, self.split))

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return batches(self.path, partition)


class StreamReader(_Options, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {name: self._whole(name, size) for name, size in sorted(sizes(self.path, self.glob).items())}

    def _whole(self, name: str, size: int) -> int:
        """The byte behind the last line feed."""
        with opened(self.path)[0].open_input_file(name) as source:
            end = size
            while end > 0:
                begin = max(0, end - READ_BYTES)
                source.seek(begin)
                last = source.read(end - begin).rfind(b"\n")
                if last >= 0:
                    return begin + last + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        return dealt(ranges({name: (start.get(name, 0), to) for name, to in end.items() if to > start.get(name, 0)}, self.split))

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return batches(self.path, partition)


class JsonlPlaces(DataSource):
    """Options: path, glob (``*.json*``), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_places"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def read_lines(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """Lines of the files with ``SCHEMA``."""
    spark.dataSource.register(JsonlPlaces)
    reader = (spark.readStream if stream else spark.read).format("jsonl_places").option("path", path)
    return reader.options(**{name: str(value) for name, value in options.items()}).load()


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Adds line_no, counted from 0 in each file: the number in the range and the lines of the ranges before it."""
    ends = lines.groupBy("file", "range_start").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    bases = ends.select("file", "range_start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    return lines.join(bases, ["file", "range_start"]).withColumn("line_no", F.col("nth") + F.col("_base")).drop("_base")
