"""Streaming queries: each replays a table as a stream and reads what the stream wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stowage.operators.sweep import sweep, sweep_summary
from stowage.schema import PROGRESS
from stowage.session import STATE_STORE, shared_dir
from stowage.sinks.ledger_store import LedgerStore
from stowage.sources.notices import source_notices
from stowage.streaming.ledger import stream_ledger
from stowage.streaming.notices import stream_notices
from stowage.streaming.progress import ProgressTable, stream_progress
from stowage.streaming.readiness import stream_readiness
from stowage.streaming.stalls import stream_stalled
from stowage.streaming.sweeps import overflow_resweep, periodic_sweep
from workloads import sqltext as Q
from workloads.fixtures import (
    BASE, QUIET_MS, ROOT, cte, expressions, inventory, ledger, table, view)
from workloads.moving import _FIELDS, _TOTALS, _TOTALS_TEXT
from workloads.registry import query


def stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The whole table as a file stream."""
    return (spark.readStream.schema(table(spark, d, name).schema)
            .option("pathGlobFilter", f"{name}.parquet").parquet(d))


def replay(rows: DataFrame, label: str) -> DataFrame:
    """Runs a stream over all there is, and reads its output."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    where = shared_dir(spark, label)
    run = (rows.writeStream.format("parquet").option("checkpointLocation", f"{where}/checkpoint")
           .trigger(availableNow=True).start(f"{where}/out"))
    run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{where}/out")


def replay_in_turns(rows: DataFrame, closing: DataFrame, build: Callable[[DataFrame, str], DataFrame], label: str,
                    turns: int = 2) -> DataFrame:
    """Lands ``rows`` in slices of ``seq``, then ``closing``, whose time moves the watermark past every timer.

    After each landing the same stream is taken up again and run to its end, so each slice is a micro-batch. ``build``
    takes the stream and how late its rows may be: as far as the clock runs back from a slice to a later one, at least ten
    seconds. So no row is dropped as late and no timer is ahead of a row; ``closing`` comes later by as much.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    where = shared_dir(spark, label)
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    low, high = low or 0, high or 0
    # Where the slices begin; one slice's bounds also tell which row groups of the input it needs.
    starts = [low - -t * (high - low + 1) // turns for t in range(turns + 1)]
    turn = sum(((F.col("seq") >= at).cast("int") for at in starts[1:-1]), F.lit(0))
    spans = rows.groupBy(turn.alias("turn")).agg(F.min("ts_ms"), F.max("ts_ms")).orderBy("turn").collect()
    back = [last - first + 1 for n, (_, _, last) in enumerate(spans) for _, first, _ in spans[n + 1:]]
    late = max(10_000, *back)
    closing = closing.withColumn("ts_ms", F.col("ts_ms") + late)
    slices = [rows.where(F.col("seq").between(a, b - 1)) for a, b in zip(starts, starts[1:], strict=False)]
    for piece in [*slices, closing]:
        piece.select(*rows.columns).write.mode("append").parquet(f"{where}/in")
        out = build(spark.readStream.schema(rows.schema).parquet(f"{where}/in"), f"{late} milliseconds")
        (out.writeStream.format("parquet").option("checkpointLocation", f"{where}/checkpoint")
         .trigger(availableNow=True).start(f"{where}/out").awaitTermination())
    return spark.read.schema(out.schema).parquet(f"{where}/out")


@query("stream_notices", Q.kept_first("fx_notices", "path", "ts_ms", QUIET_MS) + """
SELECT path, kind, ts_ms, seq FROM fx_notices WHERE seq IN (SELECT seq FROM walk WHERE passes)""")
def _(spark, d):
    rows = stream(spark, d, "events").selectExpr(*expressions("fx_notices"))
    return replay(stream_notices(rows, QUIET_MS, keep_ms=None), "notices")


@query("stream_source_notices", cte("fx_notices") + """
SELECT path, kind, ts_ms, seq FROM fx_notices WHERE kind IN ('created', 'changed', 'renamed') AND NOT is_dir
 AND path LIKE '%.raw'""")
def _(spark, d):
    rows = stream(spark, d, "events").selectExpr(*expressions("fx_notices"))
    return replay(source_notices(rows, [".raw"]).drop("is_dir"), "source")


@query("stream_readiness", Q.READINESS + """
SELECT path, observed_ms, seq, CASE WHEN probe IN (1, 5) THEN 0 ELSE length END AS length, reason,
  quiet_ms, reason IN (2, 3, 4) AS still_watching FROM gate""")
def _(spark, d):
    rows = stream(spark, d, "events").selectExpr(*expressions("fx_observations"))
    out = replay(stream_readiness(rows, QUIET_MS, max_checks=1_000_000, keep_ms=None), "readiness")
    return out.select("path", "observed_ms", "seq", "length", "reason", "quiet_ms",
                      "still_watching")


@query("stream_hand_back", Q.HANDED_BACK + f"""
SELECT path, observed_ms, seq, CASE WHEN probe IN (1, 5) THEN 0 ELSE length END AS length, reason,
  quiet_ms, reason IN (2, 3, 4) AND locked <= {Q.MAX_CHECKS} AS still_watching, locked > {Q.MAX_CHECKS} AS handed_back FROM gate""")
def _(spark, d):
    rows = stream(spark, d, "events").selectExpr(*expressions("fx_observations"))
    out = replay(stream_readiness(rows, QUIET_MS, max_checks=Q.MAX_CHECKS, keep_ms=None), "hand-back")
    return out.select("path", "observed_ms", "seq", "length", "reason", "quiet_ms", "still_watching", "handed_back")


@query("stream_progress", _TOTALS + _TOTALS_TEXT)
def _(spark, d):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    where = shared_dir(spark, "progress")
    rows = stream(spark, d, "events").selectExpr(*expressions("fx_progress"))
    kept = ProgressTable(spark, f"{where}/table")
    stream_progress(rows.select(*[f.name for f in PROGRESS.fields]), kept, f"{where}/checkpoint"
                    ).trigger(availableNow=True).start().awaitTermination()
    return kept.totals()


_STALL_MS, _CLOSING_MS = 21_600_000, 1_900_000_000_000


@query("stream_stalled", cte("fx_progress") + f""",
moved AS (SELECT *, (lag(state) OVER w IS DISTINCT FROM state) OR (lag(bytes) OVER w IS DISTINCT FROM bytes) AS moved,
    coalesce(lead(ts_ms) OVER w, {_CLOSING_MS}) AS next_ms
  FROM fx_progress WINDOW w AS (PARTITION BY local_path ORDER BY seq)),
runs AS (SELECT *, count(*) FILTER (moved) OVER (PARTITION BY local_path ORDER BY seq) AS run FROM moved)
SELECT local_path, min_by(ts_ms, seq) AS last_change_ms FROM runs WHERE state = 2 GROUP BY local_path, run
HAVING max(next_ms) - min_by(ts_ms, seq) > {_STALL_MS}""")
def _(spark, d):
    """Every stall that ever was, each once, those without an end included."""
    told = {"local_path": "closing", "state": 9, "bytes": 0, "seq": 0, "ts_ms": _CLOSING_MS + 10_000}
    rows = view(spark, d, "fx_progress").select(*told)
    closing = spark.range(1).select(*[F.lit(told[f.name]).cast(f.dataType).alias(f.name) for f in rows.schema])
    return replay_in_turns(rows, closing, lambda r, late: stream_stalled(r, _STALL_MS, late), "stalled")


@query("stream_ledger", cte("fx_ledger", "fx_orders") + """,
h AS (SELECT lower(l.local_path) AS key, e.event_id AS seq, cast(e.event_id % 10 as int) AS state,
        CASE WHEN e.event_id % 10 = 9 THEN 'failed ' || e.event_id END AS last_error
      FROM events e JOIN fx_ledger l ON l.first_seen_seq = e.event_id),
f AS (SELECT key, max_by(state, seq) AS state, max_by(coalesce(last_error, ''), seq) AS last_error,
        count(*) FILTER (state = 2) AS started FROM h GROUP BY key)
SELECT l.local_path, coalesce(f.state, l.state) AS state,
  CASE WHEN f.key IS NULL THEN coalesce(l.last_error, '') ELSE f.last_error END AS last_error,
  cast(l.attempts + coalesce(f.started, 0) as int) AS attempts, l.first_seen_seq
FROM fx_ledger l LEFT JOIN f ON f.key = lower(l.local_path)""")
def _(spark, d):
    where = shared_dir(spark, "ledger-stream")
    store = LedgerStore(spark, f"{where}/ledger")
    store.commit(ledger(spark, d), -1)
    known = view(spark, d, "fx_ledger").select("k", "local_path")
    history = (stream(spark, d, "events").join(known, F.col("event_id") == F.col("k"))
               .selectExpr("local_path", "cast(event_id % 10 as int) as state",
                           "case when event_id % 10 = 9 then concat('failed ', event_id) end as last_error",
                           "event_id as seq"))
    (stream_ledger(history, store, f"{where}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return store.current().select(
        "local_path", "state", F.coalesce("last_error", F.lit("")).alias("last_error"),
        "attempts", "first_seen_seq")


@query("stream_ledger_late", cte("fx_ledger", "fx_orders") + """,
h AS (SELECT l.first_seen_seq AS seq, e.event_id % 10 AS early, (e.event_id + 3) % 10 AS late
      FROM events e JOIN fx_ledger l ON l.first_seen_seq = e.event_id)
SELECT l.local_path, cast(coalesce(h.early, l.state) as int) AS state,
  cast(l.attempts + CASE WHEN h.early = 2 THEN 1 ELSE 0 END + CASE WHEN h.late = 2 THEN 1 ELSE 0 END as int) AS attempts
FROM fx_ledger l LEFT JOIN h ON h.seq = l.first_seen_seq""")
def _(spark, d):
    """Changes, a commit from a snapshot that holds them, and older changes that come after it."""
    store = LedgerStore(spark, f"{shared_dir(spark, 'ledger-late')}/ledger")
    store.commit(ledger(spark, d), -1)
    known = view(spark, d, "fx_ledger").select("k", "local_path")
    changes = table(spark, d, "events").join(known, F.col("event_id") == F.col("k"))
    for batch, (state, seq) in enumerate((("event_id", "event_id * 2 + 1"), ("event_id + 3", "event_id * 2"))):
        store.record_batch(changes.selectExpr(
            "local_path", f"cast(({state}) % 10 as int) as state", "cast(null as string) as last_error",
            f"{seq} as seq"), batch)
        store.commit(*store.snapshot())
    return store.current().select("local_path", "state", "attempts")


_SWEPT_COUNTS = Q.SWEPT + """
SELECT count(*) AS examined, count(*) FILTER (NOT accounted) AS offered,
       count(*) FILTER (accounted) AS accounted FROM swept"""


class _Reports:
    """Writes each sweep's summary as a row set of its own."""

    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.where = spark, where

    def __call__(self, batch_id: int, swept: DataFrame | None, problem: str | None) -> None:
        if problem is not None:
            raise RuntimeError(problem)
        sweep_summary(swept).write.mode("overwrite").parquet(f"{self.where}/sweep={batch_id}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.where).drop("sweep").distinct()


@query("periodic_sweep", _SWEPT_COUNTS)
def _(spark, d):
    where = shared_dir(spark, "periodic")
    reports = _Reports(spark, f"{where}/reports")
    # One turn of the clock, however long its sweep takes: a clock that goes on has no idle moment to stop it in
    # once a sweep outlasts its interval.
    periodic_sweep(
        spark, lambda: sweep(inventory(spark, d), ledger(spark, d), BASE, ROOT), reports,
        f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return reports.read()


@query("overflow_resweep", _SWEPT_COUNTS)
def _(spark, d):
    where = shared_dir(spark, "resweep")
    reports = _Reports(spark, f"{where}/reports")
    notices = stream(spark, d, "events").selectExpr(*expressions("fx_notices"))
    overflow_resweep(
        notices, lambda: sweep(inventory(spark, d), ledger(spark, d), BASE, ROOT), reports,
        f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return reports.read()
