"""Whether files are safe to read, from repeated looks at them.

An observation is one look: path, length, probe (0 free, 1 missing, 2 locked, 5 unreadable),
observed_ms and seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stowage.functions.labels import readiness_detail
from stowage.operators.longkeys import (
    CLEAR, FIRE, FORCE_CLEAR, FORCE_START, NOT_FORCED, START, in_parts, mark_runs, run_cycles, time_chunk)
from stowage.operators.sweep import keyed
from stowage.schema import (
    MAX_LOCKED_CHECKS, PROGRESS_INTERVAL_MS, QUIET_PERIOD_MS, Readiness as R,
    SUPPRESSION_WINDOW_MS)

_GONE = (R.MISSING, R.UNREADABLE)


_ORDER = ["observed_ms", "seq"]


def _runs(looks: DataFrame, value: Column, width_ms: int | None) -> DataFrame:
    """Runs of ``value`` per path, over parts bounded in rows, or over chunks of time if a width is given."""
    rows = keyed(looks, "path")
    if width_ms is None:
        return mark_runs(in_parts(rows, "path_key", _ORDER), "path_key", _ORDER, F.col("_part"), value, F.col("observed_ms"))
    return mark_runs(rows, "path_key", _ORDER, time_chunk("observed_ms", width_ms), value, F.col("observed_ms"))


def _sighted(observations: DataFrame, width_ms: int | None) -> DataFrame:
    """Runs of the same length per path; a look that finds nothing ends the run."""
    return _runs(observations, F.when(~F.col("probe").isin(*_GONE), F.col("length")), width_ms)


def stability_islands(observations: DataFrame, width_ms: int | None = None) -> DataFrame:
    """One row per stretch in which a file kept its length, with the clock's start."""
    runs = _sighted(observations, width_ms).where(~F.col("probe").isin(*_GONE))
    return (runs.groupBy("path_key", "run")
            .agg(F.first("length").alias("length"), F.min("run_start").alias("first_ms"),
                 F.max("observed_ms").alias("last_ms"), F.count(F.lit(1)).alias("looks"))
            .withColumn("quiet_ms", F.col("last_ms") - F.col("first_ms")))


def readiness(observations: DataFrame, quiet_ms: int = QUIET_PERIOD_MS,
              width_ms: int | None = None, max_checks: int | None = None) -> DataFrame:
    """The verdict of every look, exactly as a tracker that sees them one by one would give it.

    With ``max_checks`` the tracker is a gate that hands a file back to the sweep once more looks in a row than that found
    it locked: it forgets the file, and the next look is the first one again.
    """
    seen = _sighted(observations, width_ms).drop("run", "run_start", "position")
    changed = F.col("previous").isNotNull() & (F.col("previous") != F.col("length"))
    forced = (F.when(F.col("probe").isin(*_GONE), FORCE_CLEAR)
              .when(changed, FORCE_START).otherwise(NOT_FORCED))
    cycled = run_cycles(seen, "path_key", "observed_ms", "seq", quiet_ms,
                        F.col("probe") != R.LOCKED, forced, restart=False,
                        held=F.col("probe") == R.LOCKED, limit=max_checks)
    code, since = F.col("code"), F.col("since")
    reason = (F.when(code == CLEAR, F.col("probe"))
              .when((code == START) & since.isNull(), R.SETTLING)
              .when(code == START, R.GROWING)
              .when(code == FIRE, R.READY)
              .when(F.col("probe") == R.LOCKED, R.LOCKED)
              .otherwise(R.SETTLING))
    quiet = F.when((code == START), F.lit(0)).otherwise(F.col("observed_ms") - since)
    return cycled.select(
        "path", "observed_ms", "seq",
        F.when(F.col("probe").isin(*_GONE), F.lit(0)).otherwise(F.col("length")).alias("length"),
        "previous", reason.cast("int").alias("reason"),
        F.when(~F.col("probe").isin(*_GONE), quiet).alias("quiet_ms"))


def with_detail(verdicts: DataFrame, quiet_ms: int = QUIET_PERIOD_MS) -> DataFrame:
    """Adds the sentence shown for each verdict."""
    return verdicts.withColumn("detail", readiness_detail(
        F.col("reason"), F.col("path"), F.col("length"), F.col("previous"), F.col("quiet_ms"),
        F.lit(quiet_ms), F.lit(None).cast("string")))


def locked_streak(verdicts: DataFrame, max_checks: int = MAX_LOCKED_CHECKS,
                  width_ms: int | None = None) -> DataFrame:
    """How many looks in a row found the file locked, and where it is handed back to the sweep.

    Looks after a hand-back start a new count. Verdicts of ``readiness`` with the same ``max_checks`` have forgotten the file
    by then, as the gate has.
    """
    locked = F.col("reason") == R.LOCKED
    runs = _runs(verdicts, locked, width_ms)
    check = F.when(locked, F.pmod(F.col("position") - 1, F.lit(max_checks + 1)) + 1).otherwise(0)
    return runs.select("path", "observed_ms", "seq", "reason", check.cast("bigint").alias("streak"),
                       (check > max_checks).alias("handed_back"))


def gate_bounded(observations: DataFrame, deadline_ms: int, quiet_ms: int = QUIET_PERIOD_MS,
                 width_ms: int | None = None) -> DataFrame:
    """What became of each file by the deadline: released, abandoned or still waiting.

    A file leaves the gate at its first Ready, Missing or Unreadable verdict.
    """
    verdicts = readiness(observations.where(F.col("observed_ms") <= deadline_ms), quiet_ms, width_ms)
    final = F.col("reason").isin(R.READY, *_GONE)
    look = F.struct("observed_ms", "seq", "reason", "path")
    per_path = (keyed(verdicts, "path").groupBy("path_key")
                .agg(F.min(F.when(final, look)).alias("done"), F.max(look).alias("last")))
    state = F.coalesce("done", "last")
    outcome = (F.when(F.col("done").isNull(), "waiting")
               .when(F.col("done.reason") == R.READY, "released").otherwise("abandoned"))
    return per_path.select(
        state["path"].alias("path"), outcome.alias("outcome"), state["reason"].alias("reason"),
        state["observed_ms"].alias("observed_ms"))


def suppress_repeats(notices: DataFrame, window_ms: int = SUPPRESSION_WINDOW_MS) -> DataFrame:
    """Drops a notice that comes within the window of the last notice of its path that passed."""
    cycled = run_cycles(keyed(notices, "path"), "path_key", "ts_ms", "seq", window_ms, F.lit(True),
                        F.lit(NOT_FORCED), restart=True)
    return cycled.where(F.col("code").isin(START, FIRE)).select(*notices.columns)


def thin_progress(progress: DataFrame, interval_ms: int = PROGRESS_INTERVAL_MS) -> DataFrame:
    """Keeps one report per interval since the last one kept, and always the final one."""
    final = F.when(F.col("bytes") >= F.col("total"), FORCE_START).otherwise(NOT_FORCED)
    cycled = run_cycles(keyed(progress, "local_path"), "path_key", "ts_ms", "seq", interval_ms,
                        F.lit(True), final, restart=True)
    return cycled.where(F.col("code").isin(START, FIRE)).select(*progress.columns)
