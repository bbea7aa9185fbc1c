"""The ledger as plain parquet: full versions, and small change sets between them.

Layout below the store's folder: ``base/version=N-upto=M`` holds whole ledgers, ``changes/batch=N`` the
folded state changes of one batch. A folder counts once Spark has put its ``_SUCCESS`` there, and
no folder that is being read is ever overwritten. With a catalog that supports MERGE, use
``merge_into_table`` instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stowage.functions.paths import path_key
from stowage.operators.ledger import ledger_fold
from stowage.operators.sweep import keyed
from stowage.schema import LEDGER
from stowage.sinks.folders import finished, retire

#: Versions that stay for readers that began with them.
KEPT = 4
_COLUMNS = [f.name for f in LEDGER.fields]
# Each stored row also says which change it was last touched by, so that a late one cannot undo it.
_ROWS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LEDGER) + ", applied_seq bigint"
_CHANGES = "local_path string, state int, last_error string, attempts bigint, seq bigint"


class LedgerStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _finished(self, folder: str, pattern: str) -> list[tuple[list[int], str]]:
        return finished(self.spark, f"{self.path}/{folder}", pattern)

    def _newest(self) -> tuple[int, int, str | None]:
        """Number, last batch included and folder of the newest whole version."""
        versions = self._finished("base", r"version=(\d+)-upto=(-?\d+)")
        if not versions:
            return 0, -1, None
        (number, upto), folder = versions[-1]
        return number, upto, folder

    def _read(self, last: int | None = None) -> tuple[DataFrame, int]:
        """Rows with ``applied_seq`` after all batches, or those up to ``last``, and the last one."""
        _, upto, folder = self._newest()
        rows = (self.spark.createDataFrame([], _ROWS) if folder is None
                else self.spark.read.schema(_ROWS).parquet(folder))
        pending = [(batch, at) for batch, at in self._finished("changes", r"batch=(\d+)")
                   if batch[0] > upto and (last is None or batch[0] <= last)]
        if not pending:
            return rows, upto
        changes = self.spark.read.schema(_CHANGES).parquet(*[at for _, at in pending])
        return apply_changes(rows, changes), pending[-1][0][0]

    def snapshot(self) -> tuple[DataFrame, int]:
        """The newest version with all later changes applied, and the last batch among them.

        Whoever commits a ledger made from it passes that number on: batches that come meanwhile are
        then applied to the new version, and those it already holds are not.
        """
        rows, upto = self._read()
        return rows.select(*_COLUMNS), upto

    def current(self) -> DataFrame:
        return self.snapshot()[0]

    def commit(self, ledger: DataFrame, upto: int) -> int:
        """Writes a whole ledger that holds all batches up to ``upto`` as the next version.

        Fails, and leaves no version behind, if two rows have the same path in any case. Rows are
        dealt and sorted by their key, and keep the number of the change they were last touched by.
        """
        number = self._newest()[0]
        applied = keyed(self._read(upto)[0], "local_path").groupBy("path_key").agg(
            F.max("applied_seq").alias("applied_seq"))
        rows = (keyed(ledger, "local_path").select("path_key", *_COLUMNS)
                .withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("path_key")))
                .join(applied, "path_key", "left"))
        twice = F.raise_error(F.concat(F.lit("two ledger rows for "), "local_path"))
        only = F.when(F.col("same") == 1, F.col("local_path")).otherwise(twice.cast("string"))
        rows.withColumn("local_path", only).select(*_COLUMNS, "applied_seq").write.mode(
            "overwrite").parquet(f"{self.path}/base/version={number + 1}-upto={upto}")
        self._retire()
        return number + 1

    def _retire(self) -> None:
        """Deletes versions before the last ``KEPT``, and the batches that the oldest of those holds.

        Whoever reads an older snapshot has begun several commits ago.
        """
        versions = self._finished("base", r"version=(\d+)-upto=(-?\d+)")
        held = versions[-KEPT:][0][0][1]
        retire(self.spark, [at for _, at in versions[:-KEPT]] + [
            at for (batch,), at in self._finished("changes", r"batch=(\d+)") if batch <= held])

    def compact(self) -> int:
        """Turns the newest version and all changes since into the next version."""
        return self.commit(*self.snapshot())

    def record_batch(self, history: DataFrame, batch_id: int) -> None:
        """Folds one batch of state changes and stores it; the same batch again changes nothing."""
        if batch_id <= self._newest()[1]:
            return
        (ledger_fold(history).select("local_path", "state", "last_error", "attempts", "seq")
         .write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch_id}"))


def apply_changes(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """Folded changes onto rows with ``applied_seq``; the change with the highest ``seq`` of all that
    ever came decides the state, and uploads started add up. Unknown paths are ignored."""
    folded = (keyed(changes, "local_path").groupBy("path_key").agg(
        F.max_by(F.struct("state", "last_error"), "seq").alias("new"), F.max("seq").alias("seq"),
        F.sum("attempts").alias("started")))
    joined = keyed(ledger, "local_path").join(folded, "path_key", "left")
    hit = F.coalesce(F.col("seq") > F.coalesce("applied_seq", F.lit(-1)), F.lit(False))
    values = {
        "state": F.when(hit, F.col("new.state")).otherwise(F.col("state")),
        "last_error": F.when(hit, F.col("new.last_error")).otherwise(F.col("last_error")),
        "attempts": (F.col("attempts") + F.coalesce("started", F.lit(0))).cast("int"),
    }
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in _COLUMNS],
                         F.greatest("applied_seq", "seq").alias("applied_seq"))


def save_bucketed(ledger: DataFrame, table: str, buckets: int) -> None:
    """Saves the ledger as a table bucketed and sorted by its join key.

    A sweep against it shuffles the inventory only: the ledger side is read in place.
    """
    (keyed(ledger, "local_path").write.mode("overwrite").bucketBy(buckets, "path_key")
     .sortBy("path_key").saveAsTable(table))


def merge_into_table(updates: DataFrame, table: str) -> None:
    """The upsert as a MERGE, for tables whose catalog supports it."""
    payload = [c for c in _COLUMNS if c not in ("local_path", "first_seen_seq")]
    source = updates.alias("new")
    (source.mergeInto(table, path_key(F.col(f"{table}.local_path"))
                      == path_key(F.col("new.local_path")))
     .whenMatched().update({c: F.col(f"new.{c}") for c in payload})
     .whenNotMatched().insertAll()
     .merge())
