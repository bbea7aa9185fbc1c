"""Suppressing repeated notices on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stowage.functions.paths import path_key
from stowage.schema import SUPPRESSION_WINDOW_MS

_OUT = "path string, kind string, ts_ms bigint, seq bigint"


class PassFirst(StatefulProcessor):
    """Holds when the last notice of a path passed; forgets paths that went quiet."""

    def __init__(self, window_ms: int, keep_ms: int | None):
        self.window_ms = window_ms
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_passed", "ts bigint", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts_ms", "seq"], kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        keep = []
        for ts in batch["ts_ms"].tolist():
            passes = last is None or ts - last >= self.window_ms
            keep.append(passes)
            last = ts if passes else last
        self.last.update((int(last),))
        yield batch.loc[keep, ["path", "kind", "ts_ms", "seq"]]

    def close(self) -> None:
        pass


#: The window is judged by the notices' own times, so state has to outlive any batch or backlog.
KEEP_MS = 24 * 3_600_000


def stream_notices(notices: DataFrame, window_ms: int = SUPPRESSION_WINDOW_MS,
                   keep_ms: int | None = KEEP_MS) -> DataFrame:
    """Lets a notice pass unless its path's last passed notice is within the window.

    The state of a path outlives its last notice by ``keep_ms`` by the clock, four windows at least, so
    paths that are never heard of again cost nothing. A stream with such a clock has always another
    batch to run: a replay that is to end by itself passes None and keeps all state.
    """
    keep = None if keep_ms is None else max(4 * window_ms, keep_ms)
    return (notices.select("path", "kind", "ts_ms", "seq",
                           path_key(F.col("path")).alias("path_key"))
            .groupBy("path_key")
            .transformWithStateInPandas(
                PassFirst(window_ms, keep), outputStructType=_OUT, outputMode="Append",
                timeMode="None" if keep is None else "ProcessingTime"))
