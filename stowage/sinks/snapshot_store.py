"""Remote folders as they were last seen, with their age."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stowage.sinks.folders import finished, retire

FOLDERS = "folder string, taken_ms bigint"
ENTRIES = ("folder string, name string, is_collection boolean, length bigint, mtime_ms bigint, md5 string, "
           "path string")


class SnapshotStore:
    """Listings by folder, as parquet: ``folders=N`` and ``entries=N``.

    A snapshot counts once its folders are written, which is done last. The one before stays for readers that
    began with it, older ones are deleted. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _newest(self) -> int:
        found = finished(self.spark, self.path, r"folders=(\d+)")
        return found[-1][0][0] if found else -1

    def read(self) -> tuple[DataFrame, DataFrame]:
        """The folders with the time they were listed, and their entries."""
        number = self._newest()
        if number < 0:
            return self.spark.createDataFrame([], FOLDERS), self.spark.createDataFrame([], ENTRIES)
        read = self.spark.read
        return (read.schema(FOLDERS).parquet(f"{self.path}/folders={number}"),
                read.schema(ENTRIES).parquet(f"{self.path}/entries={number}"))

    def write(self, folders: DataFrame, entries: DataFrame) -> None:
        """Replaces what is known. Whoever writes leaves out folders that are too old to be used again."""
        number = self._newest() + 1
        columns = [part.split()[0] for part in ENTRIES.split(", ")]
        entries.select(*columns).write.mode("overwrite").parquet(f"{self.path}/entries={number}")
        folders.select("folder", F.col("taken_ms").cast("bigint").alias("taken_ms")).write.mode(
            "overwrite").parquet(f"{self.path}/folders={number}")
        old = [at for kind in ("folders", "entries") for (n,), at in finished(self.spark, self.path, rf"{kind}=(\d+)")
               if n < number - 1]
        retire(self.spark, old)
