"""Order-dependent work over keys that may hold a large share of all rows.

A plain window per key would put a hot key's rows into one task. Windows (``mark_runs``) work on chunks
of a key's order (an hour of looks, a block of sequence numbers), and what crosses a chunk border is
carried by a second pass over one small row per chunk. Timers (``run_cycles``) work on parts of
bounded size in the order of (key, time).
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from stowage.plans.staging import stage

HOUR_MS = 3_600_000
SEQ_BLOCK = 65_536


def time_chunk(time_ms: str, width_ms: int = HOUR_MS) -> Column:
    return F.floor(F.col(time_ms) / width_ms).cast("bigint")


def seq_chunk(seq: str, width: int = SEQ_BLOCK) -> Column:
    """Sequence numbers are unique, so a chunk never holds more than ``width`` rows."""
    return F.floor(F.col(seq) / width).cast("bigint")


def in_parts(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df``, written once and dealt by ranges of (key, order), with the range as ``_part``.

    A part is bounded in rows: a key goes through as many as it needs, at whatever times its rows come.
    """
    return stage(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "parts")


def mark_runs(df: DataFrame, key: str, order: list[str], chunk: Column, value: Column,
              start: Column) -> DataFrame:
    """Finds runs of equal ``value`` per key, with ``chunk`` a time, a block of numbers or the part of ``in_parts``.

    Adds ``run`` (from 1), ``run_start`` (``start`` at the run's first row), ``position`` in the
    run (from 1), ``previous`` (the value of the row before) and ``chunk``.
    """
    inside = Window.partitionBy(key, "chunk").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (
        df.withColumn("chunk", chunk).withColumn("_value", value).withColumn("_start", start)
        .withColumn("_rn", F.row_number().over(inside))
        .withColumn("_prev", F.lag("_value").over(inside))
        .withColumn("_new", (F.col("_rn") > 1) & ~F.col("_prev").eqNullSafe(F.col("_value")))
        .withColumn("_n", F.sum(F.col("_new").cast("bigint")).over(so_far))
        .withColumn("_at", F.last(F.when(F.col("_new"), F.struct("_start", "_rn")),
                                  ignorenulls=True).over(so_far)))

    border = local.groupBy(key, "chunk").agg(
        F.max("_rn").alias("rows"), F.max("_n").alias("opened"),
        F.max(F.when(F.col("_rn") == 1, F.struct("_value", "_start"))).alias("head"),
        F.max_by(F.struct("_value", "_at"), "_rn").alias("tail"))
    chain = Window.partitionBy(key).orderBy("chunk")
    earlier = chain.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        border
        .withColumn("_c_prev", F.lag(F.col("tail._value")).over(chain))
        .withColumn("_c_opens", (F.row_number().over(chain) == 1)
                    | ~F.col("_c_prev").eqNullSafe(F.col("head._value")))
        .withColumn("_c_rows", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
        .withColumn("_c_runs", F.coalesce(
            F.sum(F.col("opened") + F.col("_c_opens").cast("bigint")).over(earlier), F.lit(0)))
        .withColumn("_head_at", F.when(F.col("_c_opens"), F.struct(
            F.col("head._start").alias("start"), (F.col("_c_rows") + 1).alias("row"))))
        .withColumn("_tail_at", F.coalesce(
            F.when(F.col("tail._at").isNotNull(), F.struct(
                F.col("tail._at._start").alias("start"),
                (F.col("tail._at._rn") + F.col("_c_rows")).alias("row"))),
            F.col("_head_at")))
        .withColumn("_c_at", F.coalesce(
            F.col("_head_at"), F.last("_tail_at", ignorenulls=True).over(earlier)))
        .select(key, "chunk", "_c_prev", "_c_opens", "_c_rows", "_c_runs", "_c_at"))

    at = F.when(F.col("_at").isNotNull(), F.struct(
        F.col("_at._start").alias("start"),
        (F.col("_at._rn") + F.col("_c_rows")).alias("row"))).otherwise(F.col("_c_at"))
    return (
        local.join(carried, [key, "chunk"])
        .withColumn("_at", at)
        .select(
            *df.columns, "chunk",
            (F.col("_c_runs") + F.col("_c_opens").cast("bigint") + F.col("_n")).alias("run"),
            F.col("_at.start").alias("run_start"),
            (F.col("_c_rows") + F.col("_rn") - F.col("_at.row") + 1).alias("position"),
            F.when(F.col("_rn") == 1, F.col("_c_prev")).otherwise(F.col("_prev"))
            .alias("previous")))


# What a row did to its cycle.
START, FIRE, HOLD, CLEAR, HAND = "start", "fire", "hold", "clear", "hand"
NOT_FORCED, FORCE_START, FORCE_CLEAR = 0, 1, 2
_CODES = (HOLD, START, FIRE, CLEAR, HAND)

#: A timer: since when it runs, and how many held rows in a row it has seen. No timer: -1.
State = tuple[int, int]
_NONE: State = (-1, 0)


class _Looks:
    """Consecutive rows in order of (key, time): where a timer that starts at a row is next touched."""

    def __init__(self, key: np.ndarray, time: np.ndarray, may_fire: np.ndarray, forced: np.ndarray, held: np.ndarray,
                 wait: int, limit: int | None):
        self.n, self.time, self.wait, self.limit = len(time), time, wait, limit
        first = np.ones(self.n, bool)
        first[1:] = key[1:] != key[:-1]
        self.first = first
        starts = np.flatnonzero(first)
        number = np.cumsum(first) - 1
        self.end = np.append(starts[1:], self.n)[number]
        # Keys one after the other on one time line, further apart than any wait.
        low = int(time.min()) if self.n else 0
        self._span = (int(time.max()) - low if self.n else 0) + wait + 1
        self._line = (time - low) + number * self._span
        self.may_fire = may_fire
        self._fires = np.flatnonzero(may_fire)
        self._forced = np.flatnonzero(forced != NOT_FORCED)
        self.forced = forced
        # Held rows in a row up to each row, and the rows that complete one too many of them.
        row = np.arange(self.n)
        counts = held & (forced == NOT_FORCED) if limit is not None else np.zeros(self.n, bool)
        self.run = row - np.maximum.accumulate(np.where(~counts, row, np.where(first, row - 1, -1))) if self.n else row
        self.full = np.flatnonzero(self.run == limit + 1) if limit is not None else row[:0]
        self.lead = int(np.argmin(np.append(counts[:self.end[0]], False))) if self.n else 0
        self.touched = self._touched(row, self._line)
        if len(self.full):
            after = row + limit + 1
            here = np.minimum(after, self.n - 1)
            soon = np.where((after < self.end) & (self.run[here] > limit), after,
                            np.append(self.full, self.n)[np.searchsorted(self.full, after)])
            self.touched = np.minimum(self.touched, soon)

    def _touched(self, row: np.ndarray, since: np.ndarray) -> np.ndarray:
        """First later row of the key that fires a timer running since then, or is forced; else the key's end."""
        at = np.maximum(np.searchsorted(self._line[self._fires], since + self.wait), np.searchsorted(self._fires, row, "right"))
        fire = np.append(self._fires, self.n)[at]
        force = np.append(self._forced, self.n)[np.searchsorted(self._forced, row, "right")]
        return np.minimum(np.minimum(fire, force), self.end[np.maximum(row, 0)])

    def touched_from(self, state: State) -> int:
        """The same for a timer that the first key brings along."""
        since, count = state
        line = np.array([since - int(self.time[0]) + int(self._line[0])])
        at = int(self._touched(np.array([-1]), line)[0])
        if self.limit is not None:
            if self.lead > self.limit - count:
                return min(at, self.limit - count)
            if len(self.full):
                return min(at, int(self.full[0]))
        return at

    def fired(self, row: int, since: int) -> bool:
        return bool(self.may_fire[row]) and int(self.time[row]) - since >= self.wait

    def left(self, row: int) -> State:
        """The timer behind the last row if it began at this one."""
        return _NONE if row < 0 else (int(self.time[row]), min(int(self.run[-1]), self.n - 1 - row))

    def passed(self, state: State) -> State:
        """The timer behind the last row if it was brought along and nothing touched it."""
        trail = int(self.run[-1])
        return state[0], state[1] + trail if trail == self.n else trail


def _replay(looks: _Looks, state: State, restart: bool) -> tuple[np.ndarray, np.ndarray, State]:
    """Codes and timer starts of the rows (-1: none ran), and the timer of the last key after them."""
    n, code, found = looks.n, np.zeros(looks.n, np.int8), np.full(looks.n, -1, np.int64)
    time, forced, touched, first = looks.time.tolist(), looks.forced.tolist(), looks.touched.tolist(), looks.first.tolist()
    at, since, begun = 0, None, -1
    if state[0] >= 0 and n:
        since = state[0]
        at = looks.touched_from(state)
        found[:at] = since
    while at < n:
        if first[at] and at:
            since = None
        if since is not None:
            found[at] = since
        if forced[at] == FORCE_CLEAR:
            code[at], since = 3, None
        elif since is None or forced[at] == FORCE_START:
            code[at], since = 1, time[at]
        elif looks.fired(at, since):
            code[at], since = 2, time[at] if restart else None
        else:
            code[at], since = 4, None
        if since is None:
            at += 1
        else:
            begun, until = at, touched[at]
            found[at + 1:until] = since
            at = until
    if since is None:
        return code, found, _NONE
    return code, found, looks.left(begun) if begun >= 0 else looks.passed(state)


@dataclass
class _Exits:
    """What a whole part of one key makes of any timer it is entered with.

    ``fresh`` is the exit of one entered without a timer. ``times`` and ``exits`` have, for the rows that can be the first
    to touch a timer that was brought along, their times and exits, one entry where the exit changes: a timer
    brought along is touched by the first row that may fire at ``since + wait`` or later, or by the first row that is
    forced or hands back. ``handed`` has the exit for each number of held rows that were still allowed, as far as the held
    rows at the part's beginning use them up.
    """

    fresh: State
    times: list[int]
    exits: list[State]
    handed: list[State]


def _passage(looks: _Looks, restart: bool) -> _Exits:
    n, forced, time, touched = looks.n, looks.forced.tolist(), looks.time.tolist(), looks.touched.tolist()
    # Rows at which the timer begins that is left behind the part (-1: none).
    started, idle = [-1] * n, [-1] * n
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            idle[i] = idle[i + 1] if forced[i + 1] == FORCE_CLEAR else started[i + 1]
        j = touched[i]
        if j >= n:
            started[i] = i
        elif forced[j] == FORCE_START or (forced[j] == NOT_FORCED and restart and looks.fired(j, time[i])):
            started[i] = started[j]
        else:
            started[i] = idle[j]
    fresh = idle[0] if forced[0] == FORCE_CLEAR else started[0]
    stop = min([n, *looks._forced[:1].tolist(), *looks.full[:1].tolist()])
    able = looks._fires[looks._fires < stop]
    # No timer that was brought along starts after the first row.
    able = able[:int(np.searchsorted(looks.time[able], looks.time[0] + looks.wait)) + 1]
    times = [time[i] for i in able.tolist()]
    exits = [started[i] if restart else idle[i] for i in able.tolist()]
    if stop < n:
        times.append(2**62)
        exits.append(started[stop] if forced[stop] == FORCE_START else idle[stop])
    # Entry k serves timers due after the time before it, up to its own: only the last of equal exits is needed.
    keep = [k for k in range(len(exits)) if k + 1 == len(exits) or exits[k + 1] != exits[k]]
    used = min(looks.lead, looks.limit + 1) if looks.limit is not None else 0
    return _Exits(looks.left(fresh), [times[k] for k in keep], [looks.left(exits[k]) for k in keep],
                  [looks.left(idle[k]) for k in range(used)])


def _arrays(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
    return tuple(np.asarray(batch.column(c)) for c in ("_key", "_t", "_fires", "_forced", "_held"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where the part changes."""
    for batch in batches:
        part = np.asarray(batch.column("_part"))
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


_EXITS = ("part int, fresh array<bigint>, times array<bigint>, exits array<array<bigint>>, handed array<array<bigint>>, "
          "lead bigint, trail bigint, n bigint")


def _entries(rows: DataFrame, wait_ms: int, restart: bool, limit: int | None) -> dict[int, State]:
    """The timer that each part's first key brings along, where it began in a part before.

    ``rows`` is dealt by part and sorted. Only parts in which a key goes on or goes through are looked at. Their exits
    are chained in tasks, key by key, one part's exits at a time; what comes to the driver is two numbers for each part.
    """
    ends = rows.groupBy("_part").agg(F.min("_key").alias("first"), F.max("_key").alias("last")).orderBy("_part").collect()
    carried = {b["_part"] for a, b in zip(ends, ends[1:], strict=False) if a["last"] == b["first"]}
    through = {e["_part"] for e in ends if e["_part"] in carried and e["first"] == e["last"]}
    before = {a["_part"]: b["_part"] for a, b in zip(ends, ends[1:], strict=False) if b["_part"] in carried}
    if not carried:
        return {}
    wanted = sorted(set(before) | through)
    pair = pa.list_(pa.int64())
    schema = pa.schema([("part", pa.int32()), ("fresh", pair), ("times", pair), ("exits", pa.list_(pair)),
                        ("handed", pa.list_(pair)), ("lead", pa.int64()), ("trail", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            part = held[0].column("_part")[0].as_py()
            arrays = _arrays(pa.Table.from_batches(held))
            if part not in through:
                last = arrays[0] == arrays[0][-1]
                arrays = tuple(a[last] for a in arrays)
            looks = _Looks(*arrays, wait_ms, limit)
            found = _passage(looks, restart)
            return pa.RecordBatch.from_pydict({
                "part": [part], "fresh": [list(found.fresh)], "times": [found.times], "exits": [[list(e) for e in found.exits]],
                "handed": [[list(e) for e in found.handed]], "lead": [looks.lead], "trail": [int(looks.run[-1])], "n": [looks.n]},
                schema)

        for piece in _parts(batches):
            if held and held[0].column("_part")[0] != piece.column("_part")[0]:
                yield out()
                held.clear()
            held.append(piece)
        if held:
            yield out()

    slim = rows.where(F.col("_part").isin(wanted)).select("_part", "_key", "_t", "_s", "_fires", "_forced", "_held")
    found = _dealt(slim).drop("_s").mapInArrow(run, _EXITS)
    # Parts that follow each other with one key are a chain; it begins where the key does.
    chains: dict[int, int] = {}
    for a, b in sorted(before.items()):
        chains[b] = chains.get(a, a) if a in through else a
    links = rows.sparkSession.createDataFrame(
        [(a, b, chains[b], a in through) for a, b in sorted(before.items())], "part int, next int, chain int, through boolean")
    # One row for each part.
    told = found.join(F.broadcast(links), "part").repartition("chain").sortWithinPartitions("chain", "part").mapInArrow(
        _chained(wait_ms, limit), "part int, since bigint, count bigint")
    return {r["part"]: (r["since"], r["count"]) for r in told.where("since >= 0").collect()}


def _chained(wait_ms: int, limit: int | None):
    """Goes along sorted rows of exits and tells the timer that each next part is entered with (since -1: none)."""

    def step(state: State, row: dict) -> State:
        since, count = state
        if since < 0 or not row["through"]:
            return tuple(row["fresh"])
        if limit is not None and limit - count < len(row["handed"]):
            return tuple(row["handed"][limit - count])
        hit = bisect.bisect_left(row["times"], since + wait_ms)
        if hit < len(row["times"]):
            return tuple(row["exits"][hit])
        return since, count + row["n"] if row["lead"] == row["n"] else row["trail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, state = None, _NONE
        for batch in batches:
            found = []
            for place in range(len(batch)):
                row = batch.slice(place, 1).to_pylist()[0]
                state = step(state if row["chain"] == chain else _NONE, row)
                chain = row["chain"]
                found.append((row["next"], *state))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()),
                                              pa.array([f[2] for f in found], pa.int64())], ["part", "since", "count"])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("_part").sortWithinPartitions("_part", "_key", "_t", "_s")


def run_cycles(df: DataFrame, key: str, time_ms: str, seq: str, wait_ms: int, fires: Column,
               forced: Column, restart: bool, held: Column | None = None, limit: int | None = None) -> DataFrame:
    """Replays a timer per key whose start depends on what it did before.

    A row starts the timer when none runs. A later row that may fire does so once ``wait_ms`` has
    passed; the timer then restarts at that row, or stops. A forced row starts or clears the timer
    whatever its state. With a ``limit``, a timer that has seen more ``held`` rows in a row than that is handed back: it
    stops, and the next row starts another. Held rows do not fire. Adds ``code`` and ``since``, the start of the timer as the row found it.
    Times are not negative.

    Such a chain has no window form. The rows are range-partitioned by (key, time), so parts are bounded in
    rows and a hot key goes through many of them. A part that a key goes through is cut down to its
    exits (see ``_passage``); chaining those gives each part's entry, and all parts are then replayed at once,
    batch by batch. No key's rows are ever held together.
    """
    names = [c for c in df.columns if c not in ("chunk", "_part")]
    parted = ["_part"] if "_part" in df.columns else []
    rows = df.select(*names, F.col(key).cast("string").alias("_key"), F.col(time_ms).cast("bigint").alias("_t"),
                     F.col(seq).cast("bigint").alias("_s"), F.coalesce(fires, F.lit(False)).alias("_fires"),
                     forced.cast("int").alias("_forced"),
                     F.coalesce(F.lit(False) if held is None else held, F.lit(False)).alias("_held"), *parted)
    # Rows that are in parts of (key, time, seq) already stay in them.
    rows = stage(rows, "cycles") if parted else in_parts(rows, "_key", ["_t", "_s"])
    entries = _entries(rows, wait_ms, restart, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, state = None, None, _NONE
        for piece in _parts(batches):
            now = piece.column("_part")[0].as_py()
            arrays = _arrays(piece)
            if now != part:
                state = entries.get(now, _NONE)
            elif arrays[0][0] != last:
                state = _NONE
            looks = _Looks(*arrays, wait_ms, limit)
            code, found, state = _replay(looks, state, restart)
            part, last = now, arrays[0][-1]
            told = pa.DictionaryArray.from_arrays(pa.array(code), pa.array(_CODES)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in names), told, pa.array(found, mask=found < 0)],
                                             [*names, "code", "since"])

    schema = T.StructType([*rows.select(*names).schema, T.StructField("code", T.StringType()),
                           T.StructField("since", T.LongType())])
    return _dealt(rows).mapInArrow(run, schema)
