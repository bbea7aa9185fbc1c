"""Real files: the documents are landed as files first, and then walked, hashed and copied."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stowage.plans.staging import stage
from stowage.plans.sync import SyncOptions, one_pass_sync
from stowage.session import shared_dir
from stowage.sinks.hash_store import HashStore
from stowage.sinks.ledger_store import LedgerStore
from stowage.sinks.mirror import mirror_copy
from stowage.sinks.sidecars import write_sidecars
from stowage.sinks.snapshot_store import SnapshotStore
from stowage.sources.hashing import content_hashes, hash_files
from stowage.sources.inventory import scan_inventory, scan_problem, scan_tree
from workloads.fixtures import cte, view
from workloads.registry import query


def put(texts: DataFrame, label: str) -> str:
    """Writes (target, text) as files below a new shared folder."""
    root = shared_dir(texts.sparkSession, label)
    landed = stage(write_sidecars(texts.repartition(32), root), "landed")
    failed = landed.where(F.col("error").isNotNull()).first()
    if failed:
        raise OSError(failed["error"])
    return root


def land(spark: SparkSession, d: str, which: str = "true") -> str:
    """Writes the documents that fit a condition to files below the shared folder."""
    rows = view(spark, d, "fx_contents").where(which)
    return put(rows.select(F.col("path").alias("target"), F.col("content").alias("text")), "files")


def _below(path: str, root: str):
    return F.substr(F.col(path), F.lit(len(root) + 2))


@query("content_hashes", cte("fx_contents") + """
SELECT path, md5, sha256(content) AS sha256 FROM fx_contents""")
def _(spark, d):
    rows = view(spark, d, "fx_contents").drop("md5")
    return content_hashes(rows, F.col("content"), sha256=True).select("path", "md5", "sha256")


@query("scan_inventory", cte("fx_contents") + " SELECT path, length FROM fx_contents")
def _(spark, d):
    root = land(spark, d)
    return scan_inventory(spark, root).select(_below("path", root).alias("path"), "length")


@query("scan_fault", cte("fx_contents") + """
SELECT 'landed' AS root, count(*) AS files, cast(NULL as string) AS problem FROM fx_contents
UNION ALL SELECT 'gone', 0, 'Could not read the monitored folder'""")
def _(spark, d):
    """A tree that is there, and a root that is not: a fault to report, not an error."""
    landed, asked = land(spark, d), None
    for name, root in (("landed", landed), ("gone", f"{landed}/gone")):
        scanned = scan_tree(spark, root)
        row = scan_problem(scanned, root).select(
            F.lit(name).alias("root"),
            scanned.select(F.count_if(F.col("problem").isNull())).scalar().alias("files"),
            F.when(F.col("problem").startswith("Could not read the monitored folder"),
                   "Could not read the monitored folder").otherwise(F.col("problem")).alias("problem"))
        asked = row if asked is None else asked.unionByName(row)
    return asked


@query("hash_files", cte("fx_contents") + " SELECT path, length, md5, sha256(content) AS sha256 FROM fx_contents")
def _(spark, d):
    root = land(spark, d)
    hashed = hash_files(scan_inventory(spark, root), sha256=True)
    return hashed.where(F.col("error").isNull()).select(
        _below("path", root).alias("path"), "length", "md5", "sha256")


@query("mirror_copy", cte("fx_contents") + """
SELECT path, length AS bytes, md5, cast(NULL as string) AS error FROM fx_contents
UNION ALL SELECT path || '.gone', 0, NULL, 'missing' FROM fx_contents WHERE doc_id % 10 = 0""")
def _(spark, d):
    root = land(spark, d)
    listed = scan_inventory(spark, root).withColumn("target", _below("path", root))
    gone = (view(spark, d, "fx_contents").where("doc_id % 10 = 0").select(
        F.concat(F.lit(f"{root}/"), "path", F.lit(".gone")).alias("path"),
        F.lit(0).cast("bigint").alias("mtime_ms"), F.concat("path", F.lit(".gone")).alias("target")))
    work = listed.select("path", "mtime_ms", "target").unionByName(gone)
    outcomes: DataFrame = stage(mirror_copy(work, shared_dir(spark, "mirror")), "outcomes")
    return outcomes.select(_below("path", root).alias("path"), "bytes", "md5",
                           F.when(F.col("error").isNotNull(), "missing").alias("error"))


@query("cached_pass", cte("fx_contents") + """
SELECT path, CASE WHEN doc_id % 3 = 1 AND translate(content, 'aeiou', 'uaeio') <> content THEN 'Conflict' ELSE 'Skip' END AS action,
  2 AS tier, md5, true AS known FROM fx_contents""")
def _(spark, d):
    """A second pass over unchanged files, with a ledger that knows nothing: every hash it needs is known."""
    rows = view(spark, d, "fx_contents")
    root = land(spark, d)
    there = F.when(F.col("doc_id") % 3 == 1, F.translate("content", "aeiou", "uaeio")).otherwise(F.col("content"))
    mirror = put(rows.where("doc_id % 3 < 2").select(F.col("path").alias("target"), there.alias("text")), "mirror")
    hashes, remote = HashStore(spark, shared_dir(spark, "hashes")), SnapshotStore(spark, shared_dir(spark, "remote"))
    for turn in range(2):
        store = LedgerStore(spark, shared_dir(spark, "ledger"))
        done = one_pass_sync(spark, store, SyncOptions(root, mirror, "/r/"), 1_700_000_000_000 + turn, hashes=hashes, snapshots=remote)
    known = done.read.select("path", F.col("hit").alias("known"))
    return done.decisions.join(known, "path", "left").select(_below("path", root).alias("path"), "action", "tier", "md5", "known")


@query("recovered_pass", cte("fx_contents") + """
SELECT path, CASE WHEN doc_id % 5 = 0 THEN 9 WHEN doc_id % 3 = 0 THEN 5 ELSE 4 END AS state,
  cast(CASE WHEN doc_id % 4 = 3 THEN 0 ELSE doc_id % 3 END + CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 <> 0 THEN 1 ELSE 0 END AS int) AS attempts,
  CASE WHEN doc_id % 5 = 0 THEN 'The local file no longer exists.' END AS last_error,
  CASE WHEN doc_id % 5 <> 0 THEN md5 END AS md5
FROM fx_contents WHERE doc_id % 5 <> 0 OR doc_id % 4 <> 3""")
def _(spark, d):
    """A pass after one that was killed: some uploads had begun, some of those had arrived, some files are gone."""
    root, mirror = land(spark, d, "doc_id % 5 <> 0"), land(spark, d, "doc_id % 5 <> 0 AND doc_id % 3 = 0")
    begun = view(spark, d, "fx_contents").where("doc_id % 4 <> 3").select(
        F.concat(F.lit(f"{root}/"), "path").alias("local_path"), F.concat(F.lit("/r/"), "path").alias("remote_path"),
        F.col("length").alias("size"), F.lit(0).cast("bigint").alias("mtime_utc"), F.lit(None).cast("string").alias("md5"),
        F.lit(None).cast("string").alias("sha256"), F.expr("int(element_at(array(2, 3, 1), int(doc_id % 4) + 1))").alias("state"),
        F.lit(0).alias("verify_method"), F.lit(None).cast("timestamp").alias("verified_utc"),
        F.expr("int(doc_id % 3)").alias("attempts"), F.lit(None).cast("string").alias("last_error"),
        F.lit(False).alias("is_dataset"), F.col("doc_id").alias("first_seen_seq"))
    store = LedgerStore(spark, shared_dir(spark, "ledger"))
    store.commit(begun, -1)
    one_pass_sync(spark, store, SyncOptions(root, mirror, "/r/"), 1_700_000_000_000)
    return store.current().select(_below("local_path", root).alias("path"), "state", "attempts", "last_error", "md5")
