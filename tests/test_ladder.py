from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stowage.operators import audit as A, ladder, ledger as L, sweep as S
from stowage.operators.progress import describe_totals, transfer_totals
from stowage.schema import LEDGER

BASE, ROOT = "C:\\D", "/r/"
FILES = "path string, length bigint, mtime_ms bigint"


def entry(path, state, size=10, mtime=5, verify=2, attempts=0, md5="h", remote=None, seq=1, error=None):
    name = path.rsplit("\\", 1)[-1]
    return (path, remote or ROOT + name, size, mtime, md5, None, state, verify, None, attempts,
            error, False, seq)


@pytest.fixture
def ledger(spark):
    return lambda *rows: spark.createDataFrame(list(rows), LEDGER)


def test_sweep_offers_what_is_not_settled(rows, ledger):
    tree = rows(FILES, *[(f"C:\\D\\{n}", 10, 5) for n in (
        "run1.raw", "notes.txt", "~working.raw", "f2.raw", "f5.raw", "f0.raw", "c.raw", "d.raw",
        "moved.raw", "semi;x.raw", "weak.raw", "new.raw")])
    book = ledger(
        entry("c:\\d\\RUN1.RAW", 4, remote=ROOT + "run1.raw"), entry("C:\\D\\f2.raw", 9, attempts=2),
        entry("C:\\D\\f5.raw", 9, attempts=5), entry("C:\\D\\f0.raw", 9),
        entry("C:\\D\\c.raw", 6), entry("C:\\D\\d.raw", 6, size=11),
        entry("C:\\D\\moved.raw", 4, remote="/elsewhere/moved.raw"),
        entry("C:\\D\\semi;x.raw", 6), entry("C:\\D\\weak.raw", 4, verify=1))
    swept = S.sweep(tree, book, BASE, ROOT, [".raw"])
    settled = {r.path.rsplit("\\", 1)[-1] for r in swept.where("accounted").collect()}
    assert settled == {"run1.raw", "f5.raw", "c.raw"}
    counts = S.sweep_summary(swept).first()
    assert (counts.examined, counts.offered, counts.accounted) == (10, 7, 3)


def decide(rows, ledger, remote_length, remote_md5, local_md5, policy, known=(), folder=False):
    asked = []

    def hasher(df):
        asked.append(df)
        return df.withColumn("md5", F.lit(local_md5)).withColumn("sha256", F.lit(None).cast("string"))

    files = ladder.located(rows(FILES, ("C:\\D\\a.raw", 10, 5)), BASE, ROOT)
    remote = [] if remote_length is None else [(ROOT, "a.raw", folder, remote_length, remote_md5)]
    schema = "folder string, name string, is_collection boolean, length bigint, md5 string"
    listing = rows(schema, *remote)
    book = ledger(*known)
    out = ladder.decide(files, book, ladder.remote_snapshot(listing, listing), None, hasher, policy)
    return out.first(), asked[0].count()


ASK, SKIP, OVERWRITE, RENAME = range(4)


@pytest.mark.parametrize("case, expected", [
    # remote length, remote md5, local md5, policy -> action, tier, files hashed
    ((None, None, "h", ASK), ("Upload", 1, 0)),
    ((12, "h", "h", ASK), ("Conflict", 1, 0)),
    ((10, None, "h", ASK), ("Conflict", 1, 0)),
    ((10, "H", "h", ASK), ("Skip", 2, 1)),
    ((10, "h", "h", OVERWRITE), ("Skip", 2, 1)),
    ((10, "x", "h", ASK), ("Conflict", 2, 1)),
    ((10, "x", "h", SKIP), ("Skip", 2, 1)),
    ((10, "x", "h", OVERWRITE), ("Upload", 2, 1)),
    ((10, "x", "h", RENAME), ("Conflict", 2, 1)),
])
def test_ladder_answers_and_costs(rows, ledger, case, expected):
    got, hashed = decide(rows, ledger, *case)
    assert (got.action, got.tier, hashed) == expected
    proven = got.action == "Skip" and case[3] != SKIP
    assert got.implied_verification == (2 if proven else 0)
    if case[3] == RENAME:
        assert got.reason.endswith(" A new name is needed.")


def test_settled_file_costs_nothing(rows, ledger):
    got, hashed = decide(rows, ledger, 10, "x", "h", ASK, [entry("c:\\d\\A.raw", 4, remote=ROOT + "a.raw")])
    assert (got.action, got.tier, got.remote_hash, hashed) == ("Skip", 0, "h", 0)


@pytest.mark.parametrize("length, tier", [(12, 1), (10, 2)])
def test_our_own_copy_is_replaced(rows, ledger, length, tier):
    known = [entry("C:\\D\\a.raw", 4, mtime=4, md5="X")]
    got, _ = decide(rows, ledger, length, "x", "h", ASK, known)
    assert (got.action, got.tier) == ("Upload", tier)


def test_folder_in_the_way_and_copy_elsewhere(rows, ledger):
    got, _ = decide(rows, ledger, 0, None, "h", OVERWRITE, folder=True)
    assert (got.action, got.reason) == ("Conflict", "A folder named 'a.raw' already occupies the destination.")
    known = [entry("C:\\D\\z.raw", 4, seq=9), entry("C:\\D\\b.raw", 5, seq=2), entry("C:\\D\\y.raw", 9, seq=1)]
    got, _ = decide(rows, ledger, 10, "x", "h", ASK, known)
    assert got.already_uploaded_as == "C:\\D\\b.raw"


def test_cache_hits_are_not_hashed(rows):
    files = rows(FILES, ("A", 1, 1), ("B", 1, 1), ("C", 1, 2))
    cache = rows("local_path string, size bigint, mtime_utc bigint, md5 string, sha256 string",
                 ("a", 1, 1, "m", None), ("b", 1, 1, None, "s"), ("c", 1, 1, "old", None))
    asked = []

    def hasher(df):
        asked.append(df)
        return df.withColumn("md5", F.lit("n")).withColumn("sha256", F.lit(None).cast("string"))

    got = {r.path: r.md5 for r in ladder.hashed(files, cache, hasher).collect()}
    assert got == {"A": "m", "B": "n", "C": "n"} and asked[0].count() == 2


def test_ledger_writes(rows, ledger):
    book = ledger(entry("C:\\D\\A.raw", 1, seq=1, error="e"), entry("C:\\D\\b.raw", 1, seq=2))
    changed = L.ledger_set_state(book, rows("local_path string, state int, last_error string",
                                            ("c:\\d\\a.RAW", 2, None), ("nope", 9, "x")))
    first = {r.local_path: r for r in changed.collect()}
    assert len(first) == 2 and first["C:\\D\\A.raw"].attempts == 1
    assert first["C:\\D\\A.raw"].last_error is None and first["C:\\D\\b.raw"].attempts == 0
    merged = L.ledger_upsert(book, ledger(entry("c:\\d\\a.raw", 4, seq=7), entry("new", 4, seq=8)))
    got = {r.local_path: (r.state, r.first_seen_seq) for r in merged.collect()}
    assert got == {"C:\\D\\A.raw": (4, 1), "C:\\D\\b.raw": (1, 2), "new": (4, 8)}
    newest = [r.local_path for r in L.rows_by_state(merged, [4, 1], 2).collect()]
    assert newest == ["new", "C:\\D\\b.raw"]
    assert L.rows_by_state(merged, [], 5).count() == 0
    failed = L.ledger_fail_unknown(book, rows(
        "local_path string, length bigint, mtime_ms bigint, last_error string, first_seen_seq bigint",
        ("c:\\D\\B.RAW", 1, 1, "x", 5), ("q;1", None, None, "bad name", 6))).collect()
    assert [(r.local_path, r.remote_path, r.size, r.attempts) for r in failed] == [("q;1", "", 0, 0)]


def test_search_finds_old_rows(ledger):
    book = ledger(*[entry(f"C:\\D\\{'hit' if i < 3 else 'no'}{i}.raw", 4, seq=i) for i in range(6)])
    assert A.audit_view(book, A.VERIFIED, "HIT").count() == 3
    assert [r.first_seen_seq for r in A.audit_view(book, A.VERIFIED, "hit", limit=2).collect()] == [2, 1]
    view = A.audit_view(book, A.VERIFIED, "hit")
    assert A.audit_summary(book, view).first().summary == "6 on the server (6 hash-verified) - showing 3"
    assert A.audit_view(book, A.NEEDS_ATTENTION).count() == 0
    line = A.audit_summary(book).first().summary
    assert line == "6 on the server (6 hash-verified) - showing 6"
    assert A.audit_summary(book.limit(0)).first().summary == "Nothing recorded yet."


def test_totals_of_seven_rows(rows):
    data = [(2, 50, 100, 1e6), (2, 25, 100, 5e5), (1, 0, 200, 0.0), (4, 9, 9, 0.0), (5, 9, 9, 0.0),
            (9, 1, 9, 0.0), (6, 0, 9, 0.0)]
    latest = rows("state int, bytes bigint, total bigint, rate double", *data)
    got = describe_totals(transfer_totals(latest)).first()
    assert (got.active, got.queued, got.finished, got.needs_attention) == (2, 1, 2, 2)
    assert (got.bytes_sent, got.bytes_total, got.rate) == (75, 400, 1_500_000.0)
    assert got.summary == "2 active - 1 queued - 1.4 MB/s - 1s left"


def test_stored_names_collide(rows):
    from stowage.functions.paths import parse_remote_path

    plan = rows("path string, d string", ("a", "x/run;1"), ("b", "x/run;2"), ("c", "x/other"),
                ("d", "y%20z"), ("e", "y z")).withColumn("segments", parse_remote_path(F.col("d")).segments)
    got = {r.path: (r.stored, r.sources, r.decoded_collision)
           for r in S.stored_name_collisions(plan).collect()}
    assert got == {"a": ("x/run", 2, False), "b": ("x/run", 2, False),
                   "d": ("y z", 2, True), "e": ("y z", 2, True)}


def test_bucketed_ledger_is_not_shuffled(spark, rows, ledger):
    from stowage.sinks.ledger_store import save_bucketed

    book = ledger(entry("C:\\D\\a.raw", 4), entry("C:\\D\\b.raw", 9, attempts=5, seq=2))
    save_bucketed(book, "bucketed_ledger", 4)
    tree = rows(FILES, ("C:\\D\\A.raw", 10, 5), ("C:\\D\\b.raw", 10, 5), ("C:\\D\\c.raw", 10, 5))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        swept = S.sweep(tree, spark.table("bucketed_ledger"), BASE, ROOT)
        plan = swept._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert sorted((r.path[-5:], r.accounted) for r in swept.collect()) == [
            ("A.raw", False), ("b.raw", True), ("c.raw", False)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE bucketed_ledger")


def test_one_hot_content_and_folder(spark, ledger):
    """A third of all files share their bytes, their folder and their stored name."""
    files = spark.range(3000).selectExpr(
        "concat('p', id) as path", "if(id % 3 = 0, 0, id) as length",
        "md5(cast(if(id % 3 = 0, 0, id) as string)) as md5")
    zero = files.where("length = 0").first().md5
    book = ledger(*[entry(f"k{i}", 4, size=0, md5=zero, seq=9 - i) for i in range(3)])
    found = ladder.find_by_content(files, book)
    assert found.count() == 3000
    assert found.where("already_uploaded_as = 'k2'").count() == 1000
    plan = files.select("path", F.array(F.lit("x"), F.when(
        F.col("length") == 0, F.concat(F.lit("run;"), "path")).otherwise(F.col("path"))).alias("segments"))
    clashes = S.stored_name_collisions(plan)
    assert clashes.count() == 1000 and clashes.select("sources").distinct().collect()[0].sources == 1000
