"""Following progress: the newest report per file, kept as a table, with totals after each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from stowage.operators.progress import describe_totals, latest_progress, transfer_totals
from stowage.schema import PROGRESS
from stowage.sinks.folders import finished, retire

#: Batches after which the table is folded into one row per file again.
FOLD_EVERY = 16


class ProgressTable:
    """Newest rows of each batch below ``path``/batches, folded now and then to ``path``/folded.

    Reading takes the last fold and the batches since, so at most ``FOLD_EVERY`` of them whatever the
    stream's age, and as many folders are kept: a fold deletes what the fold before it covered. Folders are written
    whole under the batch's number: a retry changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _folders(self, kind: str) -> list[tuple[int, str]]:
        return [(numbers[0], where) for numbers, where in finished(self.spark, f"{self.path}/{kind}", r"upto=(\d+)")]

    def store(self, batch: DataFrame, batch_id: int) -> None:
        """Keeps the batch's newest row per file, then the totals over all files so far."""
        latest_progress(batch).write.mode("overwrite").parquet(f"{self.path}/batches/upto={batch_id}")
        folds = self._folders("folded")
        since = folds[-1][0] if folds else -1
        if len([n for n, _ in self._folders("batches") if n > since]) >= FOLD_EVERY:
            self.latest().write.mode("overwrite").parquet(f"{self.path}/folded/upto={batch_id}")
            # What the fold before covers is read by nobody who begins now, and not by those who began with it.
            retire(self.spark, [at for kind, least in (("batches", since + 1), ("folded", since), ("totals", since))
                                for n, at in self._folders(kind) if n < least])
        describe_totals(transfer_totals(self.latest())).write.mode("overwrite").parquet(
            f"{self.path}/totals/upto={batch_id}")

    def latest(self) -> DataFrame:
        """The newest report of every file; a late report changes nothing, since ``seq`` decides."""
        folds = self._folders("folded")[-1:]
        since = folds[0][0] if folds else -1
        wanted = [at for _, at in folds] + [at for n, at in self._folders("batches") if n > since]
        if not wanted:
            return self.spark.createDataFrame([], PROGRESS)
        return latest_progress(self.spark.read.schema(PROGRESS).parquet(*wanted))

    def totals(self) -> DataFrame:
        """The totals stored with the last batch."""
        stored = self._folders("totals")
        if not stored:
            return describe_totals(transfer_totals(self.latest()))
        return self.spark.read.parquet(stored[-1][1])


def stream_progress(progress: DataFrame, table: ProgressTable, checkpoint: str) -> DataStreamWriter:
    """A writer that keeps ``table`` current; set its trigger and start it. The stream itself keeps no state."""
    return (progress.writeStream.option("checkpointLocation", checkpoint).foreachBatch(table.store))
