"""A streaming source of lines from log files that grow.

The offset is a byte position per file, always behind a line feed, so a line is read when
it is finished, and once. A batch takes at most ``maxBytes`` (and at least one line of
each file it reaches), oldest position first; a range of a file is split at line feeds
into tasks of ``splitBytes``. Files that appear later join in; a file that shrinks is not
read until it is longer than what was read of it.

Spark asks a Python source for the latest offset without saying where it stands, so the
end of every planned batch is also written to ``progress``, a folder that outlives the
query, like its checkpoint. A restarted query goes on from there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

NAME = "growing_lines"
SCHEMA = StructType([StructField("file", StringType()), StructField("pos", LongType()), StructField("line", StringType())])
ARROW = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("line", pa.string())])
BLOCK = 1 << 20


class Range(InputPartition):
    """Bytes of one file, from the start of a line to the end of one."""

    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.files, self.root = fs.FileSystem.from_uri(options["path"])
        self.notes, folder = fs.FileSystem.from_uri(options["progress"])
        self.note = f"{folder.rstrip('/')}/planned.json"
        self.most = int(options.get("maxbytes", 1 << 30))
        self.split = int(options.get("splitbytes", 64 << 20))
        self.known = self._read_note()

    def _read_note(self) -> dict[str, int]:
        if self.notes.get_file_info(self.note).type == fs.FileType.NotFound:
            return {}
        with self.notes.open_input_stream(self.note) as stream:
            return json.loads(stream.read())

    def _write_note(self) -> None:
        self.notes.create_dir(self.note.rsplit("/", 1)[0], recursive=True)
        with self.notes.open_output_stream(f"{self.note}.new") as stream:
            stream.write(json.dumps(self.known).encode())
        self.notes.move(f"{self.note}.new", self.note)

    def _sizes(self) -> dict[str, int]:
        chosen = fs.FileSelector(self.root, recursive=True, allow_not_found=True)
        hidden = lambda path: any(p[0] in "._" for p in path[len(self.root) :].strip("/").split("/"))
        found = self.files.get_file_info(chosen)
        return {i.path: i.size for i in found if i.type == fs.FileType.File and not hidden(i.path)}

    def _line_end(self, path: str, start: int, want: int, size: int) -> int:
        """The last line end in ``start .. want``, or the first one behind if there is none."""
        with self.files.open_input_file(path) as file:
            at = want
            while at > start:
                begin = max(start, at - BLOCK)
                file.seek(begin)
                found = file.read(at - begin).rfind(b"\n")
                if found >= 0:
                    return begin + found + 1
                at = begin
            at = want
            while at < size:
                file.seek(at)
                block = file.read(min(BLOCK, size - at))
                found = block.find(b"\n")
                if found >= 0:
                    return at + found + 1
                at += len(block)
        return start

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        left, after = self.most, dict(self.known)
        for path, size in sorted(self._sizes().items(), key=lambda f: (self.known.get(f[0], 0), f[0])):
            start = self.known.get(path, 0)
            if left <= 0:
                break
            if size > start:
                end = self._line_end(path, start, min(size, start + left), size)
                if end > start:
                    after[path] = end
                    left -= end - start
        self.known = after
        return after

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.known = {path: max(at, self.known.get(path, 0)) for path, at in {**self.known, **end}.items()}
        self._write_note()
        out = []
        for path, to in end.items():
            at = start.get(path, 0)
            while at < to:
                cut = to if to - at <= self.split else self._line_end(path, at, at + self.split, to)
                out.append(Range(path, at, cut))
                at = cut
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with self.files.open_input_file(partition.file) as file:
            at, rest = partition.start, b""
            while at < partition.end:
                file.seek(at)
                block = file.read(min(BLOCK, partition.end - at))
                at += len(block)
                *lines, rest = (rest + block).split(b"\n")
                if not lines:
                    continue
                begin, places = at - len(rest) - sum(len(one) + 1 for one in lines), []
                for one in lines:
                    places.append(begin)
                    begin += len(one) + 1
                text = [one.removesuffix(b"\r").decode("utf-8", "replace") for one in lines]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.file] * len(lines), pa.string()), pa.array(places, pa.int64()), pa.array(text, pa.string())], schema=ARROW)


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return SCHEMA

    def streamReader(self, schema: StructType) -> LogReader:
        return LogReader({k.lower(): v for k, v in self.options.items()})


def log_lines(spark: SparkSession, path: str, progress: str, max_bytes: int | None = None, split_bytes: int | None = None) -> DataFrame:
    """Stream of ``file, pos, line`` from all files under ``path``."""
    spark.dataSource.register(LogSource)
    reader = spark.readStream.format(NAME).option("path", path).option("progress", progress)
    for name, value in (("maxBytes", max_bytes), ("splitBytes", split_bytes)):
        if value is not None:
            reader = reader.option(name, str(value))
    return reader.load()


def stage_lines(lines: DataFrame) -> DataFrame:
    """``job_id, ts, line`` of lines that hold microseconds, job and text, parted by tabs; other lines are left out."""
    parts = F.split("line", "\t", 3)
    return lines.select(
        F.get(parts, F.lit(1)).try_cast("long").alias("job_id"), F.timestamp_micros(F.get(parts, F.lit(0)).try_cast("long")).alias("ts"),
        F.get(parts, F.lit(2)).alias("line")).filter("job_id IS NOT NULL AND ts IS NOT NULL AND line IS NOT NULL")
