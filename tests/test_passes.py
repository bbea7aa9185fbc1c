"""Passes that remember: known hashes, announced uploads, folder snapshots, named paths."""

from __future__ import annotations

import os
import shutil

import pytest
from pyspark.sql import functions as F

from stowage.operators.ladder import cached_hashes
from stowage.plans import sync
from stowage.plans.sync import SyncOptions, one_pass_sync
from stowage.schema import HASH_CACHE
from stowage.session import shared_dir
from stowage.sinks import hash_store
from stowage.sinks.folders import finished
from stowage.sinks.hash_store import HashStore
from stowage.sinks.ledger_store import LedgerStore
from stowage.sinks.snapshot_store import SnapshotStore
from stowage.sources.hashing import OPENING, dealt_out
from stowage.sources.inventory import list_folders, stat_files

NOW = 1_700_000_000_000


def fill(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.raw").write_text(text)
    return folder


def book(store):
    return {os.path.basename(r.local_path): r for r in store.current().collect()}


def told(result):
    return {(os.path.basename(r.path), r.action, r.tier) for r in result.decisions.collect()}


def test_a_second_pass_reads_and_lists_nothing(spark, tmp_path):
    root, mirror = fill(tmp_path / "root", a="one", b="two", c="three"), fill(tmp_path / "mirror", a="one")
    (mirror / "b.raw").mkdir()
    hashes, remote = HashStore(spark, str(tmp_path / "hashes")), SnapshotStore(spark, str(tmp_path / "remote"))
    options = SyncOptions(str(root), str(mirror), "/r/", tasks=2, sha256=True)

    def go(now):
        store = LedgerStore(spark, shared_dir(spark, "ledger"))
        return one_pass_sync(spark, store, options, now, hashes=hashes, snapshots=remote), store

    first, store = go(NOW)
    # A folder already stands where b.raw would go.
    assert told(first) == {("a.raw", "Skip", 2), ("b.raw", "Conflict", 1), ("c.raw", "Upload", 1)}
    assert {(r.folder, r.status) for r in first.listed.collect()} == {("/r/", "refresh")}
    assert sorted((os.path.relpath(r.path, tmp_path), r.hit) for r in first.read.collect()) == [
        ("mirror/a.raw", False), ("root/a.raw", False)]
    assert book(store)["b.raw"].last_error.startswith("A folder named")

    # Other bytes of the same length and time: whoever read them would decide otherwise.
    for where in (root / "a.raw", root / "c.raw", mirror / "a.raw", mirror / "c.raw"):
        seen = os.stat(where)
        where.write_text("x" * seen.st_size if "root" in str(where) else "y" * seen.st_size)
        os.utime(where, ns=(seen.st_atime_ns, seen.st_mtime_ns))
    again, store = go(NOW + 300_000)
    assert told(again) == {("a.raw", "Skip", 2), ("b.raw", "Conflict", 1), ("c.raw", "Skip", 2)}
    assert [r.status for r in again.listed.collect()] == ["fresh"]
    assert again.read.count() == 4 and again.read.where("NOT hit").count() == 0
    # SHA-256 comes with the MD5 that this side has read.
    assert all(r.sha256 for r in again.decisions.where("action = 'Skip'").collect())

    late, _ = go(NOW + 300_001)
    assert [r.status for r in late.listed.collect()] == ["refresh"] and late.read.where("NOT hit").count() == 0


def test_a_killed_pass_is_taken_up(spark, tmp_path, monkeypatch):
    root, mirror = fill(tmp_path / "root", x="one", y="two"), fill(tmp_path / "mirror")
    store = LedgerStore(spark, shared_dir(spark, "ledger"))
    options = SyncOptions(str(root), str(mirror), "/r/", tasks=2)

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch, pytest.raises(RuntimeError, match="killed"):
        patch.setattr(sync, "mirror_copy", killed)
        one_pass_sync(spark, store, options, NOW)
    assert {n: (r.state, r.attempts) for n, r in book(store).items()} == {"x.raw": (2, 1), "y.raw": (2, 1)}

    (root / "y.raw").unlink()
    with monkeypatch.context() as patch, pytest.raises(RuntimeError, match="killed"):
        patch.setattr(sync, "_checked", killed)
        one_pass_sync(spark, store, options, NOW + 1)
    assert {n: (r.state, r.attempts) for n, r in book(store).items()} == {"x.raw": (2, 2), "y.raw": (2, 1)}
    assert (mirror / "x.raw").read_text() == "one"

    # The name filter would pass x.raw over now; it is finished all the same. Its copy had arrived.
    done = one_pass_sync(spark, store, SyncOptions(str(root), str(mirror), "/r/", (".wiff",), tasks=2), NOW + 2)
    assert {(os.path.basename(r.local_path), r.action) for r in done.recovered.collect()} == {("x.raw", "requeue"), ("y.raw", "fail")}
    assert told(done) == {("x.raw", "Skip", 2)} and done.outcomes.count() == 0
    assert {n: (r.state, r.attempts, r.last_error) for n, r in book(store).items()} == {
        "x.raw": (5, 2, None), "y.raw": (9, 1, "The local file no longer exists.")}


def test_named_paths_bad_folders_and_changed_sources(spark, tmp_path, monkeypatch):
    root, mirror = fill(tmp_path / "root", w="one", other="not named"), tmp_path / "mirror"
    fill(root / "sub", z="two")
    mirror.mkdir()
    (mirror / "sub").write_text("a file where a folder has to be")
    store = LedgerStore(spark, shared_dir(spark, "ledger"))
    options = SyncOptions(str(root), str(mirror), "/r/", tasks=2)
    copy = sync.mirror_copy

    def changing(work, *args):
        (root / "w.raw").write_text("one, and more")
        return copy(work, *args)

    monkeypatch.setattr(sync, "mirror_copy", changing)
    named = spark.createDataFrame([(str(root / n),) for n in ("w.raw", "sub/z.raw", "gone.raw", "w.raw")], "path string")
    result = one_pass_sync(spark, store, options, NOW, paths=named)
    assert result.sweep.first().examined == 2
    rows = book(store)
    assert {n: (r.state, r.attempts) for n, r in rows.items()} == {"w.raw": (8, 1), "z.raw": (9, 0)}
    assert "changed while" in rows["w.raw"].last_error and str(mirror / "sub") in rows["z.raw"].last_error
    # The folder of a copy that is not proven is not remembered, nor is one that could not be listed.
    assert SnapshotStore(spark, f"{store.path}/remote").read()[0].count() == 0
    assert {r.size for r in HashStore(spark, f"{store.path}/hashes").read().collect()} == set()


def test_hashes_are_kept_once_and_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hash_store, "FOLD", 3)
    store, where = HashStore(spark, str(tmp_path / "h")), str(tmp_path / "h")
    for turn in range(8):
        store.feed(spark.createDataFrame(
            [("/A", 1, 1, f"a{turn}", None), ("/b", turn, 1, "b", "s"), ("/none", 1, 1, None, None)], HASH_CACHE))
        got = {(r.local_path, r.size): r.md5 for r in store.read().collect()}
        assert got == {("/A", 1): f"a{turn}", **{("/b", t): "b" for t in range(turn + 1)}}
    store.feed(spark.createDataFrame([("/a", 1, 1, "other case", None)], HASH_CACHE))
    assert {r.md5 for r in store.read().where("size = 1 AND md5 <> 'b'").collect()} == {"other case"}
    assert len(finished(spark, where, r"whole=(\d+)")) <= 2 and len(finished(spark, where, r"part=(\d+)")) <= 6


def test_a_cache_with_twins(spark):
    cache = spark.createDataFrame([
        ("/A", 1, 1, "AA", None), ("/a", 1, 1, "aa", "s"), ("/b", 1, 1, "b1", None), ("/B", 1, 1, "b2", None),
        ("/c", 1, 1, "c", "s1"), ("/c", 1, 1, "c", "s2")], HASH_CACHE)
    files = spark.createDataFrame([("/a", 1, 1), ("/b", 1, 1), ("/c", 1, 1), ("/c", 2, 1)], "path string, length long, mtime_ms long")
    got = sorted((r.path, r.length, r.md5 and r.md5.lower(), r.sha256, r.hit) for r in cached_hashes(files, cache).collect())
    assert got == [("/a", 1, "aa", "s", True), ("/b", 1, None, None, False), ("/c", 1, "c", None, True), ("/c", 2, None, None, False)]


def test_snapshots_keep_the_last_two(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert [f.count() for f in store.read()] == [0, 0]
    for turn in range(4):
        store.write(spark.createDataFrame([("/f/", turn)], "folder string, taken_ms long"), store.read()[1])
    assert store.read()[0].first().taken_ms == 3
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["entries=2", "entries=3", "folders=2", "folders=3"]


def test_looking_at_folders_and_files(spark, tmp_path):
    fill(tmp_path / "d", a="one")
    (tmp_path / "d" / "sub").mkdir()
    (tmp_path / "d" / ".hidden").write_text("no")
    asked = spark.createDataFrame([(str(tmp_path / n),) for n in ("d", "gone", "d/a.raw")], "path string")
    got = {(os.path.basename(r.parent), r.name, r.is_collection, r.length, r.problem is None) for r in list_folders(asked).collect()}
    assert got == {("d", "a.raw", False, 3, True), ("d", "sub", True, 0, True), ("a.raw", None, None, None, False)}
    assert [(r.path, r.length) for r in stat_files(asked).collect()] == [(str(tmp_path / "d/a.raw"), 3)]
    shutil.rmtree(tmp_path / "d")
    assert list_folders(asked).count() == 0 == stat_files(asked).count()


@pytest.mark.parametrize("tasks", [1, 7, 40])
def test_work_is_dealt_by_bytes(spark, tasks):
    """No task gets more than its share and one file, however unequal the files are."""
    sizes = [7 * 2**30] + [2**20 * (i % 9) for i in range(300)] + [0] * 500 + [2**28] * 3
    files = spark.createDataFrame([(f"/f{i}", s) for i, s in enumerate(sizes)] + [("/null", None)], "path string, length long")
    dealt = dealt_out(files, tasks, "length")
    got = dealt.withColumn("task", F.spark_partition_id()).collect()
    assert dealt.columns == files.columns and dealt.rdd.getNumPartitions() == tasks
    assert sorted(r.path for r in got) == sorted(r.path for r in files.collect())
    cost = lambda r: (r.length or 0) + OPENING
    mean, largest, loads = sum(map(cost, got)) / tasks, max(map(cost, got)), {}
    for r in got:
        loads[r.task] = loads.get(r.task, 0) + cost(r)
    assert max(loads.values()) <= mean + largest
    others = {t: n - (largest if any(r.task == t and cost(r) == largest for r in got) else 0) for t, n in loads.items()}
    assert max(others.values()) <= mean + 2**28 + OPENING
