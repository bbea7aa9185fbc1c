"""Continuous watch: notices and sweeps feed the gate, and the gate feeds the sync."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stowage.functions.rules import candidate_filter
from stowage.operators.sweep import in_flight_gate, sweep
from stowage.plans.staging import stage
from stowage.plans.sync import SyncOptions, SyncResult, one_pass_sync
from stowage.schema import (
    MAX_LOCKED_CHECKS, QUIET_PERIOD_MS, Readiness as R, SUPPRESSION_WINDOW_MS,
    SWEEP_INTERVAL_MINUTES)
from stowage.session import STATE_STORE
from stowage.sinks.ledger_store import LedgerStore
from stowage.sources.inventory import scan_inventory
from stowage.sources.notices import source_notices
from stowage.streaming.notices import stream_notices
from stowage.streaming.readiness import stream_readiness
from stowage.streaming.sweeps import overflow_resweep, periodic_sweep


@dataclass(frozen=True)
class WatchOptions:
    root: str
    dest_root: str
    extensions: tuple[str, ...] = ()
    quiet_ms: int = QUIET_PERIOD_MS
    window_ms: int = SUPPRESSION_WINDOW_MS
    max_checks: int = MAX_LOCKED_CHECKS
    sweep_minutes: float = SWEEP_INTERVAL_MINUTES
    keep_ms: int = 3_600_000


@dataclass
class Watch:
    notices: StreamingQuery
    gate: StreamingQuery
    sweeps: StreamingQuery
    resweeps: StreamingQuery

    def stop(self) -> None:
        for run in (self.sweeps, self.resweeps, self.notices, self.gate):
            run.stop()


def sync_released(store: LedgerStore, options: SyncOptions, clock: Callable[[], int] | None = None,
                  report: Callable[[SyncResult], None] | None = None) -> Callable[[DataFrame, int], None]:
    """An ``on_ready`` that runs a pass over the released paths.

    Each path counts once, and one that a batch brings a second time is settled by the ledger. Passes come one after
    the other, as batches do.
    """
    def on_ready(released: DataFrame, batch_id: int) -> None:
        spark = released.sparkSession
        chosen = stage(in_flight_gate(released, spark.createDataFrame([], "path string")), "released")
        if chosen.isEmpty():
            return
        now = clock() if clock else int(time.time() * 1000)
        result = one_pass_sync(spark, store, options, now, paths=chosen)
        if report:
            report(result)

    return on_ready


def start_watch(spark: SparkSession, options: WatchOptions, notices: DataFrame,
                observations: DataFrame, ledger: Callable[[], DataFrame], folder: str,
                on_ready: Callable[[DataFrame, int], None]) -> Watch:
    """Starts the streams of a continuous watch.

    ``notices`` and ``observations`` are streams. Candidates (noticed or swept paths) land as
    parquet in ``folder``/candidates for whoever looks at the files; their looks come back as
    ``observations``. ``on_ready`` gets the released paths of each batch, at least once: ``sync_released`` makes
    one that transfers them. What became of each sweep, its problem if it failed, is in ``folder``/sweeps.
    """
    o = options
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    passed = stream_notices(source_notices(notices, list(o.extensions)), o.window_ms, o.keep_ms)
    noticed = (passed.select("path").writeStream.format("parquet")
               .option("checkpointLocation", f"{folder}/checkpoints/notices")
               .start(f"{folder}/candidates/noticed"))

    def run_sweep() -> DataFrame:
        return sweep(scan_inventory(spark, o.root), ledger(), o.root, o.dest_root, o.extensions)

    def offer(label: str):
        def report(batch_id: int, swept: DataFrame | None, problem: str | None) -> None:
            # Written first: a sweep that can't be read fails here, and what it says comes back as a problem.
            if problem is None:
                (swept.where(~F.col("accounted")).select("path").write.mode("overwrite")
                 .parquet(f"{folder}/candidates/{label}-{batch_id}"))
            told = [(label, batch_id, problem)]
            (spark.createDataFrame(told, "sweep string, batch bigint, problem string").write.mode("overwrite")
             .parquet(f"{folder}/sweeps/{label}-{batch_id}"))
        return report

    sweeps = periodic_sweep(spark, run_sweep, offer("swept"), f"{folder}/checkpoints/sweeps",
                            o.sweep_minutes).start()
    resweeps = overflow_resweep(notices, run_sweep, offer("reswept"),
                                f"{folder}/checkpoints/resweeps").start()

    wanted = observations.where(candidate_filter(F.col("path"), list(o.extensions)))
    reports = stream_readiness(wanted, o.quiet_ms, o.max_checks)

    def release(batch: DataFrame, batch_id: int) -> None:
        on_ready(batch.where(F.col("reason") == R.READY).select("path"), batch_id)

    gate = (reports.writeStream.option("checkpointLocation", f"{folder}/checkpoints/gate")
            .foreachBatch(release).start())
    return Watch(noticed, gate, sweeps, resweeps)
