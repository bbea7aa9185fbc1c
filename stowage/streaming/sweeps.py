"""Sweeps started by the clock, and by notices that events were lost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from stowage.schema import SWEEP_INTERVAL_MINUTES
from stowage.sources.notices import lost_events

Sweep = Callable[[], DataFrame]
Report = Callable[[int, DataFrame | None, str | None], None]


def _guarded(sweep: Sweep, report: Report, batch_id: int) -> None:
    """A sweep that fails is reported and tried again at the next turn."""
    try:
        report(batch_id, sweep(), None)
    except Exception as error:
        report(batch_id, None, str(error))


def periodic_sweep(spark: SparkSession, sweep: Sweep, report: Report, checkpoint: str,
                   minutes: float = SWEEP_INTERVAL_MINUTES, floor_minutes: float = 1.0
                   ) -> DataStreamWriter:
    """A full sweep at every turn of the clock, never more often than the floor.

    Turns that pass while a sweep runs fall into the next batch, so requests coalesce.
    """
    seconds = max(minutes, floor_minutes) * 60
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (clock.writeStream.option("checkpointLocation", checkpoint)
            .trigger(processingTime=f"{seconds} seconds")
            .foreachBatch(lambda _, batch_id: _guarded(sweep, report, batch_id)))


def overflow_resweep(notices: DataFrame, sweep: Sweep, report: Report,
                     checkpoint: str) -> DataStreamWriter:
    """One full sweep for each batch that says events were lost, however many it says so of."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            _guarded(sweep, report, batch_id)

    return (lost_events(notices).writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(on_batch))
