"""Applying state changes to the ledger as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from stowage.sinks.ledger_store import LedgerStore


def stream_ledger(history: DataFrame, store: LedgerStore, checkpoint: str) -> DataStreamWriter:
    """A writer that stores the folded changes (local_path, state, last_error, seq) of each batch.

    A batch is stored under its own number before anything acts on it, so a retry is harmless.
    Only changes are written; ``store.compact()`` folds them into a new version now and then.
    """
    return (history.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(store.record_batch))
