"""The readiness gate on a stream of looks at files."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stowage.functions.labels import readiness_detail, still_in_use_detail
from stowage.functions.paths import path_key
from stowage.schema import MAX_LOCKED_CHECKS, QUIET_PERIOD_MS, Readiness as R

_OUT = ("path string, observed_ms bigint, seq bigint, reason int, length bigint, "
        "previous bigint, quiet_ms bigint, checks int, still_watching boolean, "
        "handed_back boolean")
_REPORT = Row("path", "observed_ms", "seq", "reason", "length", "previous", "quiet_ms", "checks", "still_watching",
              "handed_back")
#: Looks are (path, length, probe, observed_ms, seq, path_key).
_TURN = itemgetter(3, 4)


class Gate(StatefulProcessor):
    """Per path: the length being watched, since when, and the locked looks in a row.

    Looks come and go as rows: most paths have few of them, and a pandas frame for each path, in and out, costs far
    more than the looks themselves.
    """

    def __init__(self, quiet_ms: int, max_checks: int, keep_ms: int | None = None):
        self.quiet_ms = quiet_ms
        self.max_checks = max_checks
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.watch = handle.getValueState("watch", "length bigint, since bigint, locked int",
                                          ttlDurationMs=self.keep_ms)

    def _look(self, state, length: int, probe: int, now: int):
        """(reason, previous length, quiet time, state after)."""
        if probe in (R.MISSING, R.UNREADABLE):
            return probe, None, None, None
        if state is None:
            return R.SETTLING, None, 0, (length, now, 0)
        watched, since, locked = state
        if watched != length:
            return R.GROWING, watched, 0, (length, now, 0)
        if probe == R.LOCKED:
            return R.LOCKED, watched, now - since, (length, since, locked + 1)
        if now - since < self.quiet_ms:
            return R.SETTLING, watched, now - since, (length, since, 0)
        return R.READY, watched, now - since, None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = tuple(self.watch.get()) if self.watch.exists() else None
        for path, length, probe, now, seq, *_ in sorted(rows, key=_TURN):
            reason, previous, quiet, state = self._look(state, length, probe, now)
            checks = state[2] if state is not None else 0
            handed_back = checks > self.max_checks
            if handed_back:
                state, checks = None, checks - 1
            gone = reason in (R.MISSING, R.UNREADABLE)
            yield _REPORT(path, now, seq, int(reason), 0 if gone else length, previous, quiet, checks,
                          state is not None, handed_back)
        if state is None:
            self.watch.clear()
        else:
            self.watch.update(state)

    def close(self) -> None:
        pass


KEEP_MS = 24 * 3_600_000


def stream_readiness(observations: DataFrame, quiet_ms: int = QUIET_PERIOD_MS,
                     max_checks: int = MAX_LOCKED_CHECKS, keep_ms: int | None = KEEP_MS) -> DataFrame:
    """One gate report per look. ``still_watching`` turns false when a file is released, gone,
    unreadable or handed back to the sweep after too many locked looks.

    A file that nobody looks at for ``keep_ms`` by the clock is forgotten: the next sweep offers it
    anew. A replay that is to end by itself passes None (see ``stream_notices``).
    """
    reports = (observations.select("path", "length", "probe", "observed_ms", "seq",
                                   path_key(F.col("path")).alias("path_key"))
               .groupBy("path_key")
               .transformWithState(
                   Gate(quiet_ms, max_checks, keep_ms), outputStructType=_OUT, outputMode="Append",
                   timeMode="None" if keep_ms is None else "ProcessingTime"))
    detail = F.when(F.col("handed_back"), still_in_use_detail(F.col("path"), F.col("checks"))
                    ).otherwise(readiness_detail(
                        F.col("reason"), F.col("path"), F.col("length"), F.col("previous"),
                        F.col("quiet_ms"), F.lit(quiet_ms), F.lit(None).cast("string")))
    return reports.withColumn("detail", detail)
