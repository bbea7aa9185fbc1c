"""The watch from notices and looks to copies."""

from __future__ import annotations

import os
import time

from stowage.plans.sync import SyncOptions
from stowage.plans.watch import WatchOptions, start_watch, sync_released
from stowage.session import shared_dir
from stowage.sinks.ledger_store import LedgerStore

LOOKS = "path string, length bigint, probe int, observed_ms bigint, seq bigint"
NOTICES = "path string, kind string, is_dir boolean, ts_ms bigint, seq bigint"


def test_from_notices_to_copies(spark, tmp_path):
    root, mirror, folder = tmp_path / "root", tmp_path / "mirror", tmp_path / "watch"
    for where in (root, mirror):
        where.mkdir()
    for name in ("a.raw", "busy.raw", "notes.txt"):
        (root / name).write_text(name)
    a, busy = str(root / "a.raw"), str(root / "busy.raw")
    spark.createDataFrame([(a, "created", False, 1, 1), (a, "changed", False, 2, 2), ("", "overflow", False, 3, 3),
                           (str(root / "notes.txt"), "created", False, 4, 4)], NOTICES).coalesce(1).write.parquet(str(tmp_path / "notices"))
    spark.createDataFrame([(a, 5, 0, 0, 1), (a, 5, 0, 11_000, 2), (busy, 8, 2, 0, 3), (busy, 8, 2, 11_000, 4)],
                          LOOKS).coalesce(1).write.parquet(str(tmp_path / "looks"))
    store, calls, passes = LedgerStore(spark, shared_dir(spark, "ledger")), [], []

    def ledger():
        calls.append(1)
        if len(calls) == 1:
            raise OSError("the ledger is away")
        return store.current()

    ready = sync_released(store, SyncOptions(str(root), str(mirror), "/r/", (".raw",), tasks=2), lambda: 1_700_000_000_000, passes.append)
    watch = start_watch(
        spark, WatchOptions(str(root), "/r/", (".raw",)), spark.readStream.schema(NOTICES).parquet(str(tmp_path / "notices")),
        spark.readStream.schema(LOOKS).parquet(str(tmp_path / "looks")), ledger, str(folder), ready)
    try:
        until = time.monotonic() + 120
        done = lambda kind: os.path.exists(folder / "sweeps" / f"{kind}-0" / "_SUCCESS")
        while time.monotonic() < until and not (
                passes and done("swept") and done("reswept") and watch.notices.recentProgress):
            for run in (watch.notices, watch.gate, watch.sweeps, watch.resweeps):
                assert run.exception() is None
            time.sleep(0.5)
    finally:
        watch.stop()

    # Only the file that was quiet and free is sent.
    assert (mirror / "a.raw").read_text() == "a.raw" and not (mirror / "busy.raw").exists()
    assert [(os.path.basename(r.local_path), r.state, r.attempts) for r in store.current().collect()] == [("a.raw", 4, 1)]
    assert len(passes) == 1 and passes[0].sweep.first().examined == 1
    assert {r.path for r in spark.read.parquet(f"{folder}/candidates/noticed").collect()} == {a}
    # One of the two sweeps failed and says so; the other offers what the ledger does not know.
    swept = {r.sweep: r.problem for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/sweeps").collect()}
    assert set(swept) == {"swept", "reswept"} and sorted(map(bool, swept.values())) == [False, True]
    assert "the ledger is away" in max(filter(None, swept.values()))
    good = next(k for k, v in swept.items() if v is None)
    assert busy in {r.path for r in spark.read.parquet(f"{folder}/candidates/{good}-0").collect()}
