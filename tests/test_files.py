from __future__ import annotations

import hashlib
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from stowage.operators import remote as R
from stowage.plans.audit import status
from stowage.plans.sync import SyncOptions, one_pass_sync
from stowage.schema import LEDGER
from stowage.session import shared_dir
from stowage.sinks.audit_csv import export_audit_csv
from stowage.sinks.ledger_store import LedgerStore
from stowage.sinks.mirror import mirror_copy
from stowage.sources import listings, manifests
from stowage.sources.hashing import hash_files
from stowage.sources.inventory import scan_inventory, scan_problem, scan_tree


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "data"
    for name, text in {"a.raw": "one", "2026/b c.raw": "two", "2026/x/_c.raw": "three",
                       "2026/.hidden.raw": "no", ".secret/d.raw": "no", "bad;name.raw": "semi",
                       "notes.txt": "text"}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    os.symlink(root / "2026", root / "loop")
    return root


def names(frame, root):
    return sorted(os.path.relpath(r.path, root) for r in frame.collect())


def test_walk(spark, tree):
    found = scan_inventory(spark, str(tree))
    assert names(found, tree) == ["2026/b c.raw", "2026/x/_c.raw", "a.raw", "bad;name.raw", "notes.txt"]
    assert names(scan_inventory(spark, str(tree), recursive=False), tree) == [
        "a.raw", "bad;name.raw", "notes.txt"]
    row = found.where(F.col("path").endswith("a.raw")).first()
    assert row.length == 3 and row.mtime_ms == os.stat(tree / "a.raw").st_mtime_ns // 1_000_000
    for budget in (1, 3):
        assert names(scan_tree(spark, str(tree), budget=budget), tree) == names(found, tree)
    assert {r.path for r in scan_tree(spark, f"file://{tree / '2026'}").collect()} == {
        f"file://{tree}/2026/b c.raw", f"file://{tree}/2026/x/_c.raw"}


def test_deep_and_wide_trees_take_few_rounds(spark, tmp_path, monkeypatch):
    deep = tmp_path / "deep" / "/".join("d" for _ in range(300))
    deep.mkdir(parents=True)
    (deep / "end.raw").write_text("x")
    for n in range(3000):
        (tmp_path / "wide" / f"w{n}").mkdir(parents=True)
    (tmp_path / "wide" / "w7" / "one.raw").write_text("y")
    monkeypatch.setattr(os, "scandir", lambda *_: pytest.fail("the driver lists a folder"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert names(scan_tree(spark, str(tmp_path), budget=500), tmp_path)[0].endswith("d/end.raw")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before <= 40


def test_missing_root_is_a_problem_not_an_error(spark, tmp_path):
    gone = str(tmp_path / "gone")
    scanned = scan_tree(spark, gone)
    assert scanned.where("problem IS NULL").count() == 0
    assert scan_problem(scanned, gone).first().problem.startswith("Could not read the monitored folder")


def test_hashes_and_copies(spark, tree, tmp_path):
    files = scan_inventory(spark, str(tree)).unionByName(
        spark.createDataFrame([(str(tree / "gone"), 1, 1)], "path string, length bigint, mtime_ms bigint"))
    hashed = {r.path: (r.md5, r.sha256, r.error) for r in hash_files(files, sha256=True, tasks=3).collect()}
    assert hashed[str(tree / "a.raw")] == (
        hashlib.md5(b"one").hexdigest(), hashlib.sha256(b"one").hexdigest(), None)
    assert hashed[str(tree / "gone")][2]
    out = tmp_path / "out"
    work = files.withColumn("target", F.substr("path", F.lit(len(str(tree)) + 2)))
    done = {r.path: r for r in mirror_copy(work, str(out), parallelism=2).collect()}
    assert len(done) == 6 and done[str(tree / "gone")].error
    copied = out / "2026" / "b c.raw"
    assert copied.read_text() == "two"
    assert os.stat(copied).st_mtime_ns // 1_000_000 == os.stat(tree / "2026/b c.raw").st_mtime_ns // 1_000_000
    assert not [f for _, _, fs in os.walk(out) for f in fs if f.endswith(".part")]


def test_one_pass_and_again(spark, tree, tmp_path):
    mirror = tmp_path / "mirror"
    mirror.mkdir()
    (mirror / "a.raw").write_text("other")
    (mirror / "2026").mkdir()
    (mirror / "2026" / "b c.raw").write_text("two")
    store = LedgerStore(spark, shared_dir(spark, "ledger"))
    options = SyncOptions(str(tree), str(mirror), "/r/", (".raw",), sidecars=True, tasks=2)
    first = one_pass_sync(spark, store, options, 1_700_000_000_000, 2.0)
    assert {(os.path.basename(r.path), r.action, r.tier) for r in first.decisions.collect()} == {
        ("a.raw", "Conflict", 1), ("b c.raw", "Skip", 2), ("_c.raw", "Upload", 1)}
    assert first.problem.first().problem is None
    got = first.summary.first()
    assert (got.uploaded, got.skipped, got.conflicts, got.failed, got.bytes_sent) == (1, 1, 1, 1, 5)
    book = {os.path.basename(r.local_path): r for r in store.current().collect()}
    assert {n: (r.state, r.verify_method, r.attempts) for n, r in book.items()} == {
        "a.raw": (6, 0, 0), "b c.raw": (5, 2, 0), "_c.raw": (4, 2, 1), "bad;name.raw": (9, 0, 0)}
    assert len({r.first_seen_seq for r in book.values()}) == 4
    assert "semicolon" in book["bad;name.raw"].last_error
    sidecar = (mirror / "2026/x/_c.raw.md5").read_text()
    assert sidecar.startswith(hashlib.md5(b"three").hexdigest() + "  _c.raw\n# file      _c.raw\n# bytes     5\n")
    check = subprocess.run(["md5sum", "-c", "_c.raw.md5"], cwd=mirror / "2026/x", capture_output=True)
    assert check.returncode == 0

    again = one_pass_sync(spark, store, options, 1_700_000_100_000)
    # Only the name that cannot be sent is offered again; a conflict waits for a person.
    found = again.sweep.first()
    assert (found.examined, found.offered, found.accounted) == (4, 1, 3)
    assert again.decisions.count() == 0 and again.outcomes.count() == 0

    (tree / "a.raw").write_text("other")
    (tree / "2026/x/_c.raw").write_text("three, changed")
    third = one_pass_sync(spark, store, options, 1_700_000_200_000)
    assert {(os.path.basename(r.path), r.action) for r in third.decisions.collect()} == {
        ("a.raw", "Skip"), ("_c.raw", "Upload")}
    after = {os.path.basename(r.local_path): r for r in store.current().collect()}
    assert after["_c.raw"].attempts == 2 and after["a.raw"].state == 5
    assert after["_c.raw"].first_seen_seq == book["_c.raw"].first_seen_seq

    report = status(store.current())
    assert {r.name: r.rows for r in report.counts.collect()} == {"Skipped": 2, "Verified": 1, "Failed": 1}
    assert report.attention.count() == 1 and report.rows.count() == 4


def test_store_keeps_versions_and_batches(spark):
    store = LedgerStore(spark, shared_dir(spark, "store"))
    assert store.current().count() == 0
    row = ("A", "r", 1, 1, None, None, 1, 0, None, 0, None, False, 1)
    store.commit(spark.createDataFrame([row], LEDGER), -1)
    change = "local_path string, state int, last_error string, seq bigint"
    uploads = spark.createDataFrame([("a", 2, None, 1), ("a", 9, "x", 2), ("b", 2, None, 3)], change)
    for _ in range(2):  # the same batch twice counts once
        store.record_batch(uploads, 0)
        store.record_batch(spark.createDataFrame([("a", 2, None, 4)], change), 1)
    now = store.current().collect()
    assert [(r.state, r.attempts, r.last_error) for r in now] == [(2, 2, None)]
    store.compact()
    store.record_batch(uploads, 1)  # already part of the version
    assert [(r.state, r.attempts) for r in store.current().collect()] == [(2, 2)]


def test_a_late_change_does_not_undo_a_newer_one(spark):
    store = LedgerStore(spark, shared_dir(spark, "store"))
    rows = [(p, "r", 1, 1, None, None, 1, 0, None, 0, None, False, i) for i, p in enumerate("AB")]
    store.commit(spark.createDataFrame(rows, LEDGER), -1)
    change = "local_path string, state int, last_error string, seq bigint"
    store.record_batch(spark.createDataFrame([("a", 4, None, 9)], change), 0)
    store.compact()
    store.record_batch(spark.createDataFrame([("A", 9, "old", 5), ("b", 2, None, 6)], change), 1)
    for _ in range(2):
        got = {r.local_path: (r.state, r.last_error) for r in store.current().collect()}
        assert got == {"A": (4, None), "B": (2, None)}
        store.compact()
    with pytest.raises(Exception, match="two ledger rows for"):
        store.commit(spark.createDataFrame([rows[0], ("a", *rows[0][1:])], LEDGER), 1)
    assert store.current().count() == 2


def test_paths_that_differ_in_case_stay_one_row(spark, tmp_path):
    tree, mirror = tmp_path / "tree", tmp_path / "mirror"
    tree.mkdir()
    mirror.mkdir()
    for name in ("run.raw", "RUN.raw"):
        (tree / name).write_text(name)
    store = LedgerStore(spark, shared_dir(spark, "ledger"))
    options = SyncOptions(str(tree), str(mirror), "/r/", tasks=2)
    counts = []
    for turn in range(3):
        one_pass_sync(spark, store, options, 1_700_000_000_000 + turn)
        counts.append(store.current().count())
    assert counts == [1, 1, 1]


def test_a_pass_keeps_what_came_before_it(spark, tree, tmp_path):
    """A batch that the pass has read is not applied to its version again."""
    mirror = tmp_path / "mirror"
    mirror.mkdir()
    store = LedgerStore(spark, shared_dir(spark, "ledger"))
    options = SyncOptions(str(tree), str(mirror), "/r/", (".raw",), tasks=2)
    one_pass_sync(spark, store, options, 1_700_000_000_000)
    path = str(tree / "a.raw")
    store.record_batch(spark.createDataFrame([(path, 2, None, 1), (path, 9, "boom", 2)],
                                             "local_path string, state int, last_error string, seq bigint"), 0)
    assert {r.state for r in store.current().where(F.col("local_path") == path).collect()} == {9}
    one_pass_sync(spark, store, options, 1_700_000_100_000)
    row = store.current().where(F.col("local_path") == path).first()
    assert (row.state, row.last_error, row.attempts) == (5, None, 2)


HASH = "d41d8cd98f00b204e9800998ecf8427e"


def test_manifests(spark, tmp_path):
    docs = lambda *values: spark.createDataFrame([("f", v) for v in values], "folder string, value string")
    body = f"\r\n{HASH.upper()} *low tide.bin\r\n{HASH}  b*c\n\n{'0' * 32} *low tide.bin\n"
    got = {r.name: r.md5 for r in manifests.parse_md5_manifest(docs(body)).collect()}
    assert got == {"low tide.bin": "0" * 32, "b*c": HASH}
    assert manifests.parse_md5_single(docs(body)).first().md5 == HASH
    assert manifests.parse_md5_single(docs("\n\r\n")).first().md5 is None
    for bad in ("<html>", HASH + " *", HASH[:-1] + " *x", HASH + "-*x"):
        with pytest.raises(Exception, match="Unexpected line in an md5sum response"):
            manifests.parse_md5_manifest(docs(bad)).collect()
        with pytest.raises(Exception, match="Unexpected line"):
            manifests.parse_md5_single(docs(bad)).collect()
        lenient = docs(f"{HASH} *ok\n{bad}")
        assert manifests.parse_md5_manifest(lenient, strict=False).count() == 1
        assert manifests.manifest_errors(lenient).count() == 1
    (tmp_path / "sums").write_text(f"{HASH} *x\n")
    assert manifests.read_md5_manifest(spark, str(tmp_path)).first().name == "x"
    assert manifests.read_md5_single(spark, str(tmp_path)).first().md5 == HASH


def test_manifest_diff(spark):
    book = "folder string, name string, md5 string"
    expected = spark.createDataFrame([("f", "ebb", "a"), ("f", "flow", "b"), ("f", "c", "x")], book)
    actual = spark.createDataFrame([("f", "ebb", "A"), ("f", "FLOW", "b"), ("f", "c", "y")], book)
    assert {r.name: r.status for r in R.manifest_diff(expected, actual).collect()} == {
        "ebb": "match", "flow": "missing", "FLOW": "extra", "c": "changed"}
    assert [r.name for r in R.name_except(expected, actual).collect()] == ["flow"]


def test_listings(spark, tmp_path):
    body = ('{"FILES":[{"text":"dry dock","collection":true,"canread":true,"options":"OPTIONS, get"},'
            '{"Text":"ebb,]2.bin","leaf":true,"contentlength":"40961","canUpload":true,'
            '"options":"PUT, move ","lastmodified":"2031-07-09T03:04:05-02:00"},'
            '{"text":"","size":1},{"text":"f","leaf":false,"creationdate":"bad","size":7},]}')
    (tmp_path / "%40lab.json").write_text(body)
    (tmp_path / "login.json").write_text("<html>")
    (tmp_path / "empty.json").write_text("{}")
    parsed = listings.read_listing_json(spark, str(tmp_path))
    got = {r.name: r for r in listings.listing_entries(parsed).collect()}
    assert set(got) == {"dry dock", "ebb,]2.bin", "f"}
    run = got["ebb,]2.bin"]
    assert (run.length, run.is_collection, run.folder) == (40961, False, "/%40lab/")
    assert run.path == "/%40lab/ebb%2C%5D2.bin" and run.last_modified.hour == 5
    assert run.permissions.allowed_methods == ["PUT", "MOVE"] and run.permissions.can_upload
    assert got["f"].is_collection and got["f"].path.endswith("/f/") and got["f"].last_modified is None
    assert not got["dry dock"].permissions.can_upload and got["dry dock"].length == 0
    problems = {r.folder: r.problem for r in listings.listing_problems(parsed).collect()}
    assert problems == {"/login/": listings.NOT_JSON, "/empty/": listings.NO_FILES}


def test_csv_quotes_only_where_needed(spark, tmp_path):
    row = ('C:\\a, b.raw', "/r/x", 1, 1, HASH, None, 9, 0, None, 0, 'said "no"\nthen left', False, 1)
    export_audit_csv(spark.createDataFrame([row], LEDGER).coalesce(1), str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text == ("Local path,Remote path,State,Verification,Size (bytes),MD5,Verified (UTC),Detail\n"
                    f'"C:\\a, b.raw",/r/x,Failed,Not verified,1,{HASH},,"said ""no""\nthen left"\n')
