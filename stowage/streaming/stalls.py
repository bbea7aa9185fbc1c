"""Noticing uploads that stopped moving, by event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stowage.functions.paths import path_key
from stowage.schema import STALL_TIMEOUT_MS, TransferState as S


#: Reports of an input partition that are packed at once.
PACK_ROWS = 8_192
_COLUMNS = ("seq", "ts_ms", "state", "bytes")
_PACK = "local_path string, seq array<bigint>, ts_ms array<bigint>, state array<int>, bytes array<bigint>, last_ms bigint"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the reports of a path that lie near each other in the input, in lists.

    A stateful operator takes its rows one by one in Python: of a path with many reports in a batch it takes few rows.
    """

    def packed(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        lists = pa.Table.from_batches(held).group_by("local_path", use_threads=False).aggregate(
            [*((c, "list") for c in _COLUMNS), ("ts_ms", "max")])
        return (lists.select(["local_path", *(f"{c}_list" for c in _COLUMNS), "ts_ms_max"])
                .rename_columns(["local_path", *_COLUMNS, "last_ms"]).combine_chunks().to_batches())

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= PACK_ROWS:
            yield from packed(held)
            held, n = [], 0
    if n:
        yield from packed(held)


class StallWatch(StatefulProcessor):
    """Tells each run of reports without a move once, when it has lasted for longer than the timeout.

    Takes reports in packs. A later report of the path tells a stall, or a timer if the watermark gets there first. A
    report that is still to come is no earlier than the watermark, so both give the same answer, however the stream is
    cut into batches.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState(
            "seen", "local_path string, seq bigint, state int, bytes bigint, moved_ms bigint, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        packs = pd.concat(list(rows))
        path = packs["local_path"].to_numpy().repeat(packs["seq"].map(len))
        seq, ts, state, size = (np.concatenate(packs[c].to_list()) for c in _COLUMNS)
        seq, order = np.unique(seq, return_index=True)
        told = False
        if self.seen.exists():
            head_path, head_seq, head_state, head_size, head_ms, told = self.seen.get()
            later = seq > head_seq
            seq, order = seq[later], order[later]
            # The run so far stands first, as a report made when it last moved.
            path, seq, ts, state, size = (
                np.append([head], column) for head, column in (
                    (head_path, path[order]), (head_seq, seq), (head_ms, ts[order]), (head_state, state[order]),
                    (head_size, size[order])))
        else:
            path, ts, state, size = path[order], ts[order], state[order], size[order]
        moves = np.ones(len(seq), bool)
        moves[1:] = (state[1:] != state[:-1]) | (size[1:] != size[:-1])
        run = moves.cumsum() - 1
        begun = ts[moves]
        # Each report looks back at the run that was in force before it.
        before = run[:-1]
        late = (ts[1:] - begun[before] > self.timeout_ms) & (state[:-1] == S.UPLOADING)
        stalls = set(before[late].tolist())
        ended = run[-1] in stalls or (told and run[-1] == 0)
        self.seen.update((path[-1], int(seq[-1]), int(state[-1]), int(size[-1]), int(begun[-1]), bool(ended)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state[-1] == S.UPLOADING and not ended:
            self.handle.registerTimer(int(begun[-1]) + self.timeout_ms + 1)
        fresh = sorted(stalls - ({0} if told else set()))
        yield pd.DataFrame({"local_path": path[moves][fresh], "last_change_ms": begun[fresh]}
                           ).astype({"local_path": str, "last_change_ms": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        path, seq, state, moved, ms, _ = self.seen.get()
        self.seen.update((path, seq, state, moved, ms, True))
        yield pd.DataFrame({"local_path": [path], "last_change_ms": [ms]})

    def close(self) -> None:
        pass


def stream_stalled(progress: DataFrame, timeout_ms: int = STALL_TIMEOUT_MS,
                   lateness: str = "10 seconds") -> DataFrame:
    """Each stall of an upload, once: its byte count has not moved for longer than the timeout, by the clock of the
    reports. A stall with no later report comes once the watermark has passed its end."""
    packs = progress.select("local_path", *_COLUMNS).mapInArrow(_pack, _PACK)
    return (packs.withColumn("ts", F.timestamp_millis("last_ms"))
            .withColumn("path_key", path_key(F.col("local_path")))
            .withWatermark("ts", lateness)
            .groupBy("path_key")
            .transformWithStateInPandas(
                StallWatch(timeout_ms), outputStructType="local_path string, last_change_ms bigint",
                outputMode="Append", timeMode="EventTime"))
