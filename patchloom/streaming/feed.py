"""A table kept by a stream: one base folder and few delta folders.

Every batch of changes becomes a delta under its own number. After ``every`` deltas they
are merged with the base into a new one, so a reader meets one base and fewer than
``every`` deltas however old the stream is. A folder counts once it is complete (its
success mark is written last). A batch that comes again replaces its delta, or changes
nothing where a base already holds it. Whatever merges rows must give the same result in
any order and for repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

Merge = Callable[[DataFrame], DataFrame]
EVERY = 16


def newest(key: str, batch: str = "batch_id") -> Merge:
    """The row of the latest batch per key."""
    def merge(rows: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c != key]
        return rows.groupBy(key).agg(F.max_by(F.struct(*columns), batch).alias("_row")).select(key, "_row.*").select(*rows.columns)
    return merge


class Feed:
    """``path/base/<n>`` holds all batches up to ``n``, ``path/delta/<n>`` the changes of one."""

    def __init__(self, spark: SparkSession, path: str, merge: Merge, every: int = EVERY):
        self.spark, self.path, self.merge, self.every = spark, path.rstrip("/"), merge, every

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}/{number:012d}"

    def _where(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _complete(self, kind: str) -> list[int]:
        """Numbers of the complete folders, at most a few more than ``every``."""
        where, files = self._where(f"{self.path}/{kind}")
        if not files.exists(where):
            return []
        names = [s.getPath().getName() for s in files.listStatus(where) if s.isDirectory()]
        return sorted(int(n) for n in names if files.exists(self._where(f"{self.path}/{kind}/{n}/_SUCCESS")[0]))

    def snapshot(self) -> tuple[int | None, list[int]]:
        """The newest base and the deltas after it."""
        bases = self._complete("base")
        base = bases[-1] if bases else None
        return base, [n for n in self._complete("delta") if base is None or n > base]

    def _rows(self, base: int | None, deltas: list[int], schema: StructType | None = None) -> DataFrame:
        paths = [self._folder("delta", n) for n in deltas] + ([] if base is None else [self._folder("base", base)])
        if not paths:
            if schema is None:
                raise ValueError(f"nothing has been written under {self.path}")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(*paths)

    def read(self, schema: StructType | None = None) -> DataFrame:
        """The merged table; ``schema`` is needed only where nothing may have been written yet."""
        return self.merge(self._rows(*self.snapshot(), schema))

    def commit(self, changes: DataFrame, number: int) -> None:
        """Add one batch, and merge when enough have gathered. For ``foreachBatch``."""
        base, deltas = self.snapshot()
        if base is not None and number <= base:
            return
        changes.write.mode("overwrite").parquet(self._folder("delta", number))
        deltas = sorted({*deltas, number})
        if len(deltas) >= self.every:
            self.compact(base, deltas, changes.schema)

    def compact(self, base: int | None, deltas: list[int], schema: StructType) -> None:
        self.merge(self._rows(base, deltas, schema)).write.mode("overwrite").parquet(self._folder("base", deltas[-1]))
        # the base before stays for readers that have begun
        for kind, numbers in (("delta", deltas), ("base", [n for n in self._complete("base") if base is not None and n < base])):
            for number in numbers:
                where, files = self._where(self._folder(kind, number))
                files.delete(where, True)
