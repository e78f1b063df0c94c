"""Log files that grow, read by bytes: a Spark data source for batches and streams.

A line's ``seq`` is the byte at which it begins in its file, so it stays the same however
the file is read. Files are cut into ranges of bytes, a task each; a line belongs to the
range in which it begins, and its task reads on to its end. A stream's offsets are the
bytes of each file that were taken; a batch ends with the last whole line, so a line that
is still being written waits. Files are opened through Arrow's file systems on driver and
executors (local and mounted paths, S3, GCS, HDFS).

Defined results: a start of n begins at byte n, or n bytes before the end if n is negative,
in whatever is there; a file that is shorter begins at 0. A gzip file is one range from its
start, and only batches read it. A file that became shorter is read anew. A last line
without line break is a line for batches. Bytes that are no ASCII become question marks.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from skirmish.sources.logs import named_lines

SCHEMA = "path string, seq long, line string"
RANGE = 64 << 20
_READ = 4 << 20


def _files(path: str) -> dict[str, int]:
    """Path and length of a file, or of all files of a folder."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True)) if info.type == fs.FileType.Directory else []
    scheme = path.split("://", 1)[0] + "://" if "://" in path else ""
    return {f"{scheme}{f.path}": f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def start_at(length: int, start: int) -> int:
    """The byte that ``start`` stands for in a file of this length."""
    if start > 0 and length > start:
        return start
    return length + start if start < 0 and length > -start else 0


def whole_lines(path: str, length: int) -> int:
    """The bytes of a file up to its last line break."""
    with _open(path) as file:
        end = length
        while end > 0:
            begin = max(0, end - 65536)
            file.seek(begin)
            at = file.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return 0


@dataclass
class Range(InputPartition):
    """Lines that begin in [low, high) of a file; ``cut`` if ``low`` may lie inside a line of the range before."""

    path: str
    low: int
    high: int
    cut: bool
    end: int | None = None


def ranges(path: str, low: int, high: int, size: int, end: int | None = None) -> list[Range]:
    return [Range(path, at, min(at + size, high), at > low, end) for at in range(low, high, size)]


def _batch(path: str, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    lines = [x.removesuffix(b"\r").decode("ascii", "replace").replace("\ufffd", "?") for _, x in rows]
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([at for at, _ in rows], pa.int64()), pa.array(lines, pa.string())], names=["path", "seq", "line"])


def read_range(part: Range) -> Iterator[pa.RecordBatch]:
    """The lines of a range, some megabytes at a time."""
    with gzip.open(_open(part.path)) if part.path.endswith(".gz") else _open(part.path) as file:
        at = part.low
        held = b""
        if part.cut:  # whether the byte before is a line break tells if a line begins at low
            file.seek(part.low - 1)
            at, skipping = part.low - 1, True
        else:
            file.seek(part.low)
            skipping = False
        limit = part.end if part.end is not None else None
        while True:
            room = _READ if limit is None else min(_READ, limit - at - len(held))
            got = file.read(room) if room > 0 else b""
            held += got
            pieces = held.split(b"\n")
            held = pieces.pop()
            rows = []
            for piece in pieces:
                if skipping:
                    skipping = False
                elif at < part.high:
                    rows.append((at, piece))
                at += len(piece) + 1
                if at >= part.high and not part.path.endswith(".gz"):
                    break
            if rows:
                yield _batch(part.path, rows)
            if at >= part.high and not part.path.endswith(".gz"):
                return
            if not got:
                if held and not skipping:
                    yield _batch(part.path, [(at, held)])
                return


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.path, self.start, self.size = options["path"], int(options.get("start", 0)), int(options.get("range", RANGE))

    def partitions(self) -> Sequence[InputPartition]:
        out: list[Range] = []
        for path, length in _files(self.path).items():
            out += [Range(path, 0, 1 << 62, False)] if path.endswith(".gz") else ranges(path, start_at(length, self.start), length, self.size)
        return out or [Range("", 0, 0, False)]

    def read(self, partition):
        return read_range(partition) if partition.path else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.start, self.size = options["path"], int(options.get("start", 0)), int(options.get("range", RANGE))

    def initialOffset(self) -> dict:  # noqa: N802
        return {p: start_at(n, self.start) for p, n in _files(self.path).items() if not p.endswith(".gz")}

    def latestOffset(self) -> dict:  # noqa: N802
        return {p: whole_lines(p, n) for p, n in _files(self.path).items() if not p.endswith(".gz")}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out: list[Range] = []
        for path, high in end.items():
            low = start.get(path, 0)
            out += ranges(path, low if low <= high else 0, high, self.size, high)
        return out

    def read(self, partition):
        return read_range(partition)


class GrowingLog(DataSource):
    """``spark.read`` or ``readStream`` ``.format("growing_log")`` with options path, start and range (bytes a task)."""

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)


def _lines(found: DataFrame) -> DataFrame:
    return named_lines(found.withColumnRenamed("path", "_path")).select("log_id", F.col("seq"), "owner", "server", "line")


def read_bytes(spark: SparkSession, path: str, start: int = 0, size: int = RANGE) -> DataFrame:
    """(log_id, seq, owner, server, line) of a log or a folder of logs, from a byte on."""
    spark.dataSource.register(GrowingLog)
    return _lines(spark.read.format("growing_log").option("path", path).option("start", start).option("range", size).load())


def stream_growing(spark: SparkSession, path: str, start: int = 0, size: int = RANGE) -> DataFrame:
    """The same lines as they are added to the files, and those of files that are added."""
    spark.dataSource.register(GrowingLog)
    return _lines(spark.readStream.format("growing_log").option("path", path).option("start", start).option("range", size).load())
