"""Corpus input: scan, admission, decoding, archives, source lookup."""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patchloom.functions.text import split_lines

# Bytes of members or texts that a Python worker holds at a time, besides one that is larger.
PORTION = 4_000_000


def scan_files(spark: SparkSession, path: str | list[str], glob: str = "*.py", recursive: bool = True) -> DataFrame:
    """``file, content BINARY, length`` of matching files; missing folders are skipped.

    Columns that are not selected later are not read: listing alone opens no file.
    """
    found = []
    for one in [path] if isinstance(path, str) else path:
        if _exists(spark, one):
            found.append(one)
    if not found:
        raise FileNotFoundError(f"no input found under {path}")
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(found)
        .select(F.col("path").alias("file"), "content", "length")
    )


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def decode(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1, so no file is lost."""
    return F.when(
        F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")
    ).otherwise(F.decode(content, "ISO-8859-1"))


def with_lines(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("lines", split_lines(F.col(content)))


def exploded_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per line, 1-based; narrow, with the file's text left behind."""
    return files.select("file", F.posexplode(split_lines(F.col(content))).alias("pos", "text")).select(
        "file", (F.col("pos") + 1).alias("line_no"), "text"
    )


def unsafe_path(path: Column) -> Column:
    """Absolute paths and paths that climb out of their folder."""
    return path.rlike(r"^(?:/|\\|[A-Za-z]:)") | path.rlike(r"(?:^|[/\\])\.\.(?:[/\\]|\z)")


def admit(uploads: DataFrame, mode: str = "any") -> DataFrame:
    """Add ``reject_reason``: null for accepted names (``.py`` and ``.zip``, or one of them)."""
    suffixes = {"any": [".py", ".zip"], "py": [".py"], "zip": [".zip"]}[mode]
    name = F.col("file")
    wanted = F.lit(False)
    for suffix in suffixes:
        wanted = wanted | name.endswith(suffix)
    return uploads.withColumn(
        "reject_reason",
        F.when(unsafe_path(name), F.lit("unsafe path")).when(~wanted, F.lit("unsupported type")),
    )


def require_any(accepted: DataFrame) -> DataFrame:
    """Fail when nothing was accepted, without counting the rest."""
    if accepted.isEmpty():
        raise ValueError("no .py files found in the upload")
    return accepted


def zip_members(content: pa.Buffer) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    """Member, content and error of one archive; a broken archive or member becomes one error row."""
    try:
        archive = zipfile.ZipFile(pa.BufferReader(content))
    except zipfile.BadZipFile as error:
        yield None, None, f"BadZipFile: {error}"
        return
    for name in archive.namelist():
        try:
            yield name, archive.read(name), None
        except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError) as error:
            yield name, None, f"{type(error).__name__}: {error}"


def portions(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``column`` has about ``PORTION`` bytes; one row stays whole."""
    at = size = 0
    for k, n in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
        if size and size + n > PORTION:
            yield batch.slice(at, k - at)
            at, size = k, 0
        size += n
    if batch.num_rows > at:
        yield batch.slice(at)


def expand_archives(archives: DataFrame) -> DataFrame:
    """``archive, member, content, error, kept`` for rows ``file, content`` of zip archives.

    ``kept`` marks ``.py`` members outside cache folders whose names are safe.
    """
    kind = archives.schema["file"].dataType.simpleString()

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("archive", batch.schema.field(0).type), ("member", pa.string()), ("content", pa.binary()), ("error", pa.string())])
            rows, size = [], 0
            for k, content in enumerate(batch.column(1)):
                for name, data, error in zip_members(content.as_buffer()) if content.is_valid else ():
                    rows.append((k, name, data, error))
                    size += len(data or b"")
                    # what is held is bounded by bytes, however many members an archive has
                    if size >= PORTION:
                        yield made(batch.column(0), rows, schema)
                        rows, size = [], 0
            if rows:
                yield made(batch.column(0), rows, schema)

    def made(archive: pa.Array, rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        at, *columns = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [archive.take(pa.array(at)), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    member = F.col("member")
    return (
        archives.select(F.col("file").alias("archive"), F.col("content").cast("binary").alias("content"))
        .mapInArrow(expand, f"archive {kind}, member string, content binary, error string")
        .withColumn(
            "kept",
            F.col("error").isNull()
            & member.endswith(".py")
            & ~member.contains("__pycache__")
            & ~member.startswith("__")
            & ~unsafe_path(member),
        )
    )


def lookup_source(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Attach ``resolved`` and ``content`` by path, else by base name (smallest path wins).

    ``wanted`` has ``file`` (repeats allowed); ``files`` has unique ``file`` and ``content``.
    """
    base = F.regexp_extract(F.col("file"), r"([^/\\]*)\z", 1)
    exact = files.select("file", F.col("file").alias("_path"))
    by_base = files.groupBy(base.alias("_base")).agg(F.min("file").alias("_base_path"))
    paths = wanted.select("file").distinct().withColumn("_base", base)
    paths = paths.join(exact, "file", "left").join(by_base, "_base", "left")
    resolved = paths.select("file", F.coalesce("_path", "_base_path").alias("resolved"))
    content = files.select(F.col("file").alias("resolved"), "content")
    # paths are settled on narrow rows; the text travels once
    return wanted.join(resolved, "file", "left").join(content, "resolved", "left").select(*wanted.columns, "resolved", "content")
