"""One file per row: texts written to paths that the rows name, all of them or none.

A first job writes every text into a staging folder beside the target, under names that no
other attempt uses, and a table of what it wrote. Only when all tasks are through does a
second job move the files to their places, task by task; moving again changes nothing, so
a lost executor or a repeated task does no harm. If the first job fails, the staging
folder goes and the target is as it was. Files of an earlier run are replaced.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from patchloom.functions.text import unix_newlines

# Files per task where they are moved or read, and bytes of texts in one batch of rows.
FILES, BATCH_BYTES = 10_000, 4_000_000
MANIFEST = "path string, staged string, bytes long, sha256 string"
_ARROW = pa.schema([("path", pa.string()), ("staged", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string())])


def safe_path(path: Column) -> Column:
    """Relative paths that stay inside the target and apart from the folders kept there."""
    parts = F.split(path, "/")
    plain = F.forall(parts, lambda p: ~p.isin("", ".", "..")) & ~path.rlike(r"[\\\x00-\x1f]")
    return F.coalesce(plain & ~F.get(parts, F.lit(0)).rlike(r"^_(?:staging-|manifests$)"), F.lit(False))


def write_documents(rows: DataFrame, root: str, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Write ``text_col`` of every row to ``root/path_col``; returns ``path, bytes, sha256`` of what was written.

    Raises, and writes nothing, where a path is null, unsafe or named twice. Null texts are empty files.
    """
    spark = rows.sparkSession
    files, base = fs.FileSystem.from_uri(root)
    staging = f"_staging-{uuid.uuid4().hex}"
    chosen = rows.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), safe_path(F.col(path_col)).alias("safe"))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, top = fs.FileSystem.from_uri(root)
        # of this attempt; where the staging folder is gone, the job has failed and nothing may be written any more
        folder = f"{top}/{staging}/{uuid.uuid4().hex}"
        target.create_dir(folder, recursive=False)
        count = 0
        for batch in batches:
            out = []
            for path, text, safe in zip(*(batch.column(k) for k in range(3))):
                if not safe.as_py():
                    raise ValueError(f"no safe path: {path.as_py()!r}")
                raw, name = text.as_py().encode(), f"{folder}/{count}"
                with target.open_output_stream(name) as stream:
                    stream.write(raw)
                out.append((path.as_py(), name, len(raw), hashlib.sha256(raw).hexdigest()))
                count += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, _ARROW)], schema=_ARROW)

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, top = fs.FileSystem.from_uri(root)
        made = set()
        for batch in batches:
            for path, staged in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if target.get_file_info(staged).type == fs.FileType.NotFound:
                    continue  # an earlier attempt has moved it
                folder = f"{top}/{path}".rsplit("/", 1)[0]
                if folder not in made:
                    target.create_dir(folder, recursive=True)
                    made.add(folder)
                target.move(staged, f"{top}/{path}")
            yield batch

    written = f"{root.rstrip('/')}/{staging}/_written"
    listed = f"{root.rstrip('/')}/_manifests/{uuid.uuid4().hex}"
    files.create_dir(f"{base}/{staging}", recursive=True)
    try:
        chosen.mapInArrow(stage, MANIFEST).write.parquet(written)
        manifest = spark.read.schema(MANIFEST).parquet(written)
        twice = manifest.groupBy("path").count().filter("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"two rows name {twice[0]['path']!r}")
        _dealt(manifest).mapInArrow(publish, MANIFEST).drop("staged").write.parquet(listed)
    finally:
        _gone(files, f"{base}/{staging}")
    return spark.read.schema("path string, bytes long, sha256 string").parquet(listed)


def _dealt(paths: DataFrame) -> DataFrame:
    """Rows of a table of paths in tasks of about ``FILES`` files; small rows would else come in few large splits."""
    return paths.repartition(-(-paths.count() // FILES) or 1, "path")


def _gone(files: fs.FileSystem, folder: str) -> None:
    """Delete a folder that tasks of a failed job may still be writing into."""
    for _ in range(20):
        if files.get_file_info(folder).type == fs.FileType.NotFound:
            return
        try:
            files.delete_dir(folder)
        except OSError:
            time.sleep(0.1)  # a file came in between


def read_documents(written: DataFrame, root: str) -> DataFrame:
    """``path, text`` of the files that ``written`` (what ``write_documents`` returned) names."""
    kind = pa.schema([("path", pa.string()), ("text", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, top = fs.FileSystem.from_uri(root)
        paths, texts, size = [], [], 0
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            with target.open_input_stream(f"{top}/{path}") as stream:
                raw = stream.read()
            paths.append(path)
            texts.append(raw.decode())
            size += len(raw)
            if size >= BATCH_BYTES or len(paths) >= FILES:
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(texts)], schema=kind)
                paths, texts, size = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(texts)], schema=kind)

    return _dealt(written.select("path")).mapInArrow(read, "path string, text string")


def outputs(files: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """``path, text``: rewritten files of ``file, content`` beside their names, and reports of
    ``file, part, report`` as ``<name>_validation_report.json``, numbered from the second part on."""
    stem = F.regexp_replace("file", r"\.[^./]*$", "")
    ending = F.regexp_extract("file", r"(\.[^./]*)$", 1)
    out = files.select(F.concat(stem, F.lit(".refactored"), ending).alias("path"), unix_newlines(F.col("content")).alias("text"))
    if reports is None:
        return out
    number = F.when(F.col("part") > 0, F.concat(F.lit("."), F.col("part").cast("string"))).otherwise(F.lit(""))
    return out.unionByName(reports.select(F.concat(stem, F.lit("_validation_report"), number, F.lit(".json")).alias("path"), F.col("report").alias("text")))
