"""Streams cut into several micro-batches against their batch twins."""

from __future__ import annotations

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import Row, functions as F

from stowage.operators import readiness as R
from stowage.operators.ledger import ledger_fold
from stowage.operators.progress import latest_progress
from stowage.operators.sweep import sweep_summary
from stowage.schema import LEDGER, NOTICES, OBSERVATIONS, PROGRESS
from stowage.sinks.ledger_store import LedgerStore
from stowage.streaming import stalls
from stowage.streaming.ledger import stream_ledger
from stowage.streaming.notices import stream_notices
from stowage.streaming.progress import FOLD_EVERY, ProgressTable, stream_progress
from stowage.streaming.readiness import Gate, stream_readiness
from stowage.streaming.stalls import stream_stalled
from stowage.streaming.sweeps import overflow_resweep
from tests.conftest import SMALL
from tests.test_looks import LOOKS, random_looks
import workloads.streams  # noqa: F401 (registers its queries)
from workloads.fixtures import view
from workloads.registry import QUERIES


@pytest.fixture
def landed(spark, tmp_path):
    """Lands rows as three files that arrive one after the other."""

    def land(frame, schema, order):
        rows = frame.orderBy(order).collect()
        third = len(rows) // 3 + 1
        for part in range(3):
            piece = spark.createDataFrame(rows[part * third:(part + 1) * third], frame.schema)
            piece.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).coalesce(1).write.mode(
                "append").parquet(str(tmp_path / "in"))
        return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
                .parquet(str(tmp_path / "in")))
    return land


def run(writer, tmp_path):
    writer.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(
        availableNow=True).start().awaitTermination()


def collect(stream, spark, tmp_path):
    out = str(tmp_path / "out")
    run(stream.writeStream.format("parquet").option("path", out), tmp_path)
    return spark.read.schema(stream.schema).parquet(out)


def test_readiness_stream(spark, rows, landed, tmp_path):
    looks = rows(LOOKS, *random_looks(7, 90, 3, 4_000))
    got = collect(stream_readiness(landed(looks, OBSERVATIONS, "seq"), 10_000, 10**6, None), spark, tmp_path)
    batch = R.readiness(looks, 10_000, 10_000)
    assert sorted((r.seq, r.reason) for r in got.collect()) == sorted(
        (r.seq, r.reason) for r in batch.collect())
    assert got.where("detail IS NULL").count() == 0


class _Held:
    """A value state of one path."""

    def __init__(self, *_, **__):
        self.now = None

    getValueState = lambda self, *_, **__: self
    exists = lambda self: self.now is not None
    get = lambda self: self.now

    def update(self, now):
        self.now = now

    def clear(self):
        self.now = None


def test_gate_takes_and_gives_rows():
    """A path costs its looks, not two data frames."""
    look, gate, held = Row("path", "length", "probe", "observed_ms", "seq", "path_key"), Gate(10, 3), _Held()
    gate.init(held)
    first = list(gate.handleInputRows(("a",), iter([look("A", 5, 0, 7, 2, "a"), look("A", 4, 0, 3, 1, "a")]), None))
    assert [(r.seq, r.reason, r.previous, r.still_watching) for r in first] == [(1, 4, None, True), (2, 3, 4, True)]
    assert held.now == (5, 7, 0)
    last = list(gate.handleInputRows(("a",), iter([look("A", 5, 0, 17, 3, "a")]), None))
    assert [(r.reason, r.quiet_ms, r.still_watching, r.handed_back) for r in last] == [(0, 10, False, False)] and held.now is None


def test_held_file_is_handed_back(spark, rows, landed, tmp_path):
    looks = rows(LOOKS, *[("Run.raw", 5, 2, i * 1_000, i) for i in range(7)])
    got = collect(stream_readiness(landed(looks, OBSERVATIONS, "seq"), 10_000, 3, None), spark, tmp_path)
    seen = {r.seq: r for r in got.collect()}
    assert [s for s, r in sorted(seen.items()) if not r.still_watching] == [4]
    assert "for all of the last 3 checks" in seen[4].detail and seen[5].reason == 4


def test_notices_stream(spark, rows, landed, tmp_path):
    data = [("a", "changed", False, t, s) for s, t in enumerate([0, 500, 999, 1000, 1500, 2100, 9000])]
    frame = rows("path string, kind string, is_dir boolean, ts_ms bigint, seq bigint", *data)
    got = collect(stream_notices(landed(frame, NOTICES, "seq"), keep_ms=None), spark, tmp_path)
    assert sorted(r.ts_ms for r in got.collect()) == [0, 1000, 2100, 9000]


def reports(rows, *data):
    frame = rows("local_path string, state int, bytes bigint, seq bigint, ts_ms bigint", *data)
    return frame.select(*[
        F.col(f.name).cast(f.dataType) if f.name in frame.columns
        else F.lit(1 if f.name in ("total", "rate") else None).cast(f.dataType).alias(f.name)
        for f in PROGRESS.fields])


def test_progress_stream_ignores_late_reports(spark, rows, landed, tmp_path):
    frame = reports(rows, ("A", 2, 1, 1, 10), ("a", 4, 9, 5, 20), ("b", 2, 1, 2, 30), ("a", 2, 5, 3, 40),
                    ("b", 2, 2, 4, 50))
    table = ProgressTable(spark, str(tmp_path / "table"))
    run(stream_progress(landed(frame, PROGRESS, "ts_ms"), table, str(tmp_path / "checkpoint")), tmp_path)
    got = {(r.local_path, r.state, r.bytes) for r in table.latest().collect()}
    assert got == {("a", 4, 9), ("b", 2, 2)}
    assert got == {(r.local_path, r.state, r.bytes) for r in latest_progress(frame).collect()}
    assert table.totals().first().summary.startswith("1 active")


def test_progress_table_folds_its_batches(spark, rows, tmp_path):
    table = ProgressTable(spark, str(tmp_path / "table"))
    for batch in range(FOLD_EVERY + 2):
        table.store(reports(rows, ("A", 2, batch, batch, batch), (f"f{batch}", 4, 1, batch, batch)), batch)
    assert len(table._folders("folded")) == 1
    assert {(r.local_path, r.bytes) for r in table.latest().collect()} == {
        ("A", FOLD_EVERY + 1), *((f"f{n}", 1) for n in range(FOLD_EVERY + 2))}
    table.store(reports(rows, ("A", 2, 0, 0, 0)), FOLD_EVERY + 2)
    assert table.latest().where("local_path = 'A'").first().bytes == FOLD_EVERY + 1


def test_old_folders_are_deleted(spark, rows, tmp_path, monkeypatch):
    """However long a stream or a ledger lives, a bounded number of folders is listed."""
    monkeypatch.setattr("stowage.streaming.progress.FOLD_EVERY", 3)
    table, store = ProgressTable(spark, str(tmp_path / "table")), LedgerStore(spark, str(tmp_path / "store"))
    store.commit(spark.createDataFrame([("A", "r", 1, 1, None, None, 1, 0, None, 0, None, False, 1)], LEDGER), -1)
    for batch in range(14):
        table.store(reports(rows, ("A", 2, batch, batch, batch), (f"f{batch}", 4, 1, batch, batch)), batch)
        store.record_batch(rows("local_path string, state int, last_error string, seq bigint", ("a", 2, None, batch)), batch)
        if batch % 2:
            store.compact()
    assert table.latest().count() == 15 and table.totals().count() == 1
    assert len(table._folders("batches")) <= 6 and len(table._folders("folded")) <= 2 and len(table._folders("totals")) <= 7
    assert store.current().first().attempts == 14
    assert len(list((tmp_path / "store/base").iterdir())) == 4 and len(list((tmp_path / "store/changes").iterdir())) <= 8


def test_ledger_stream_counts_started_uploads(spark, rows, landed, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "store"))
    store.commit(spark.createDataFrame(
        [(p, "r", 1, 1, None, None, 1, 0, None, 1, None, False, i) for i, p in enumerate("AB")], LEDGER), -1)
    history = rows("local_path string, state int, last_error string, seq bigint",
                   ("a", 2, None, 1), ("a", 9, "x", 2), ("a", 2, None, 3), ("b", 3, None, 4), ("a", 4, None, 5))
    schema = history.schema
    run(stream_ledger(landed(history, schema, "seq"), store, str(tmp_path / "checkpoint")), tmp_path)
    got = {r.local_path: (r.state, r.attempts, r.last_error) for r in store.current().collect()}
    assert got == {"A": (4, 3, None), "B": (3, 1, None)}
    assert {r.local_path: r.attempts for r in ledger_fold(history).collect()} == {"a": 2, "b": 0}


def test_overflow_starts_one_sweep_per_batch(rows, landed, tmp_path, spark):
    data = [("a", "changed", False, 0, 0), ("", "overflow", False, 1, 1), ("", "overflow", False, 2, 2),
            ("b", "created", False, 3, 3), ("c", "created", False, 4, 4), ("d", "overflow", False, 5, 5)]
    frame = rows("path string, kind string, is_dir boolean, ts_ms bigint, seq bigint", *data)
    seen = []

    def sweep():
        if len(seen) == 1:
            raise OSError("share is away")
        return spark.range(1)

    run(overflow_resweep(landed(frame, NOTICES, "seq"), sweep,
                         lambda batch, swept, problem: seen.append(problem),
                         str(tmp_path / "checkpoint")), tmp_path)
    assert seen == [None, "share is away"]


def test_a_sweep_that_outlasts_its_interval_ends(spark, monkeypatch):
    turns = []

    def slow(swept):
        turns.append(1)
        if len(turns) > 2:
            raise OSError("the clock goes on")
        time.sleep(6.5)
        return sweep_summary(swept)

    monkeypatch.setattr("workloads.streams.sweep_summary", slow)
    assert QUERIES["periodic_sweep"](spark, SMALL).count() == 1 and len(turns) == 1


def test_stalled_stream(spark, rows, landed, tmp_path):
    t = 1_700_000_000_000
    frame = reports(rows, ("a", 2, 10, 0, t), ("a", 2, 10, 1, t + 100_000), ("b", 2, 5, 2, t),
                    ("b", 4, 6, 3, t + 100_000), ("c", 4, 1, 4, t + 400_000),
                    ("c", 4, 1, 5, t + 500_000))
    stream = stream_stalled(landed(frame, PROGRESS, "seq"), 120_000, "200 seconds")
    got = collect(stream, spark, tmp_path)
    assert [(r.local_path, r.last_change_ms) for r in got.collect()] == [("a", t)]


def stalls_by_loop(data, timeout, end):
    found, now = [], {}
    for path, state, size, _, t in sorted(data, key=lambda r: r[3]) + [(p, 9, 0, 0, end) for p in {r[0] for r in data}]:
        begun = now.get(path)
        if begun and begun[0] == 2 and t - begun[2] > timeout and not begun[3]:
            found.append((path, begun[2]))
            begun[3] = True
        if not begun or begun[:2] != [state, size]:
            now[path] = [state, size, t, False]
    return sorted(found)


@pytest.mark.parametrize("files", [1, 4])
def test_each_stall_is_told_once_however_the_stream_is_cut(spark, rows, tmp_path, files):
    rng, t = random.Random(5), 1_700_000_000_000
    data = []
    for seq in range(160):
        t += rng.choice([1_000, 20_000, 60_000])
        data.append((f"f{rng.randrange(4)}", rng.choice([2, 2, 2, 4]), rng.randrange(2), seq, t))
    end = t + 10**9
    frame = reports(rows, *data, ("closing", 4, 0, 999, end))
    step = 161 // files + 1
    for part in range(files):
        (frame.where(F.floor(F.least("seq", F.lit(160)) / step) == part).coalesce(1).write.mode("append")
         .parquet(str(tmp_path / "in")))
    stream = spark.readStream.schema(PROGRESS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = collect(stream_stalled(stream, 120_000), spark, tmp_path)
    want = stalls_by_loop(data, 120_000, end)
    assert len(want) > 10 and sorted((r.local_path, r.last_change_ms) for r in got.collect()) == want


def test_a_path_goes_to_its_state_in_few_rows():
    """A stateful operator takes rows one by one, so the reports of a path come to it in packs, none lost."""
    data = [{"local_path": f"f{seq % 2}", "seq": seq, "ts_ms": 7 * seq, "state": seq % 5, "bytes": -seq} for seq in range(20_000)]
    table = pa.Table.from_pylist(data)
    packs = [p for batch in stalls._pack(iter(table.to_batches(1_024))) for p in batch.to_pylist()]
    assert len(packs) == 6
    got = [dict(zip(("seq", "ts_ms", "state", "bytes"), r, strict=True), local_path=p["local_path"])
           for p in packs for r in zip(p["seq"], p["ts_ms"], p["state"], p["bytes"], strict=True)]
    assert sorted(got, key=lambda r: r["seq"]) == data and all(p["last_ms"] == max(p["ts_ms"]) for p in packs)


def test_no_report_is_lost_where_the_clock_runs_back(spark, tmp_path):
    """Later numbers with the times of earlier ones: the second turn of the replay is no later than it says."""
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.unionByName(events.withColumn("event_id", F.col("event_id") + 100_000)).write.parquet(str(tmp_path / "events.parquet"))
    data = view(spark, str(tmp_path), "fx_progress").select("local_path", "state", "bytes", "seq", "ts_ms").collect()
    want = stalls_by_loop(data, 21_600_000, 1_900_000_000_000)
    got = QUERIES["stream_stalled"](spark, str(tmp_path)).collect()
    assert len(want) > 100 and sorted((r.local_path, r.last_change_ms) for r in got) == want
