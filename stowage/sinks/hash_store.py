"""Content hashes that outlive a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stowage.functions.paths import path_key
from stowage.schema import HASH_CACHE
from stowage.sinks.folders import finished, retire

_COLUMNS = [f.name for f in HASH_CACHE.fields]
_ROWS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in HASH_CACHE) + ", part bigint"
#: Parts that are read beside the last whole before a new whole is written.
FOLD = 16


class HashStore:
    """Hashes by (path in any case, size, modification time), as parquet below one folder.

    A pass appends what it has read as one part; after ``FOLD`` parts they become a new whole. What a
    whole covers is deleted only with the next whole, so a reader that began before still finds its files.
    A key that comes again replaces the earlier one. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _finished(self, kind: str) -> list[tuple[int, str]]:
        return [(numbers[0], at) for numbers, at in finished(self.spark, self.path, rf"{kind}=(\d+)")]

    def _rows(self) -> tuple[DataFrame, int, int]:
        """All rows with the number of their part, the highest number and how many parts stand beside the whole."""
        wholes = self._finished("whole")[-1:]
        upto = wholes[0][0] if wholes else -1
        parts = [(n, at) for n, at in self._finished("part") if n > upto]
        found = wholes + parts
        rows = (self.spark.read.schema(_ROWS).parquet(*[at for _, at in found]) if found
                else self.spark.createDataFrame([], _ROWS))
        return rows, max((n for n, _ in found), default=-1), len(parts)

    def read(self) -> DataFrame:
        """One row per key, as ``HASH_CACHE``."""
        return folded(self._rows()[0]).select(*_COLUMNS)

    def feed(self, hashes: DataFrame) -> None:
        """Stores hashes (local_path, size, mtime_utc, md5, sha256); those without an MD5 are none."""
        rows, last, beside = self._rows()
        (hashes.where(F.col("md5").isNotNull()).select(*_COLUMNS, F.lit(last + 1).cast("bigint").alias("part"))
         .write.mode("overwrite").parquet(f"{self.path}/part={last + 1}"))
        if beside + 1 >= FOLD:
            self.fold()

    def fold(self) -> None:
        """Writes a new whole, and deletes what the whole before it covered."""
        covered = self._finished("whole")
        rows, last, _ = self._rows()
        folded(rows).write.mode("overwrite").parquet(f"{self.path}/whole={last}")
        if covered:
            upto = covered[-1][0]
            old = [(n, at) for kind in ("part", "whole") for n, at in self._finished(kind)]
            retire(self.spark, [at for n, at in old if n < upto or (n == upto and "/part=" in at)])


def folded(rows: DataFrame) -> DataFrame:
    """The last row of each key."""
    return (rows.withColumn("path_key", path_key(F.col("local_path"))).groupBy("path_key", "size", "mtime_utc")
            .agg(F.max_by(F.struct("local_path", "md5", "sha256", "part"), "part").alias("r"))
            .select("r.local_path", "size", "mtime_utc", "r.md5", "r.sha256", "r.part"))
