"""One pass: find what is not safely transferred, decide, copy, verify, record.

A pass remembers. Hashes of files on both sides go into a hash store, and a file that has kept its size and
time is not read again. Listings of remote folders are kept with their age. Before anything is copied the ledger says
so, and the next pass takes up what a pass that was killed has left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stowage.functions.paths import encoded_root, file_name
from stowage.functions.rules import stamp_matches
from stowage.operators.ladder import cheap_decisions, conclude, hashed, located, remote_hash_matters, stepped, with_ledger, OPEN
from stowage.operators.ledger import ledger_fail_unknown, ledger_set_state, ledger_upsert
from stowage.operators.progress import run_summary
from stowage.operators.remote import fetched_folders, snapshot_fresh, snapshot_overlay, verify_outcomes
from stowage.operators.sweep import destination_plan, keyed, recover_interrupted, sweep, sweep_summary, union_candidates
from stowage.plans.staging import stage
from stowage.schema import (
    ConflictPolicy, MAX_UPLOAD_ATTEMPTS, SNAPSHOT_LIFETIME_MS, TransferState as S, VerifyMethod)
from stowage.sinks.hash_store import HashStore
from stowage.sinks.ledger_store import LedgerStore
from stowage.sinks.mirror import mirror_copy
from stowage.sinks.sidecars import sidecar_text, write_sidecars
from stowage.sinks.snapshot_store import SnapshotStore
from stowage.sources.hashing import file_hasher, hash_files
from stowage.sources.inventory import list_folders, scan_problem, scan_tree, stat_files

_SUPERSEDED = "The file changed while it was being uploaded."
_CACHE = ("local_path", "size", "mtime_utc", "md5", "sha256")


@dataclass(frozen=True)
class SyncOptions:
    """Where files come from and go to. ``mirror`` is the folder that stands for ``dest_root``."""

    root: str
    mirror: str
    dest_root: str = "/"
    extensions: tuple[str, ...] = ()
    recursive: bool = True
    policy: int = ConflictPolicy.ASK
    max_attempts: int = MAX_UPLOAD_ATTEMPTS
    verify: bool = True
    sidecars: bool = False
    sha256: bool = False
    producer: str = "stowage"
    tasks: int | None = None
    snapshot_ms: int = SNAPSHOT_LIFETIME_MS


@dataclass
class SyncResult:
    """What a pass found and did.

    ``listed`` has the remote folders the pass needed and whether it listed them, ``read`` the files whose hash it needed and
    whether it was known (``hit``), on either side.
    """

    swept: DataFrame
    sweep: DataFrame
    problem: DataFrame
    decisions: DataFrame
    outcomes: DataFrame
    summary: DataFrame
    sidecars: DataFrame | None
    recovered: DataFrame
    listed: DataFrame
    read: DataFrame


def _below_mirror(encoded: Column, dest_root: str) -> Column:
    """The decoded place of an encoded destination or folder below the mirror."""
    below = F.substr(encoded, F.lit(len(encoded_root(dest_root)) + 1))
    return F.url_decode(F.replace(below, F.lit("+"), F.lit("%2B")))


def refreshed(needed: DataFrame, store: SnapshotStore, mirror: str, dest_root: str, now_ms: int,
              lifetime_ms: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Snapshots of the ``needed`` folders: usable ones from the store, the others listed now.

    Returns the needed folders with ``status``, the known folders with their age, their entries, and the folders that
    could not be listed, with the problem. Those are in no snapshot, so they are asked for again next time.
    """
    folders, entries = store.read()
    usable = folders.where(F.lit(now_ms) - F.col("taken_ms") <= lifetime_ms)
    status = stage(snapshot_fresh(needed, folders, now_ms, lifetime_ms), "folders")
    asked = status.where("status = 'refresh'").select("folder")
    place = F.concat(F.lit(mirror.rstrip("/") + "/"), _below_mirror(F.col("folder"), dest_root))
    asked = asked.withColumn("path", F.when(F.length(place) > 1, F.rtrim(place, F.lit("/"))).otherwise(place))
    seen = stage(list_folders(asked).join(asked.select(F.col("path").alias("parent"), "folder"), "parent"), "listed")
    failed = seen.where("problem IS NOT NULL").select("folder", "problem")
    found = seen.where("problem IS NULL").select(
        "folder", "name", "is_collection", "length", "mtime_ms", F.lit(None).cast("string").alias("md5"), "path")
    taken = fetched_folders(asked.join(failed, "folder", "left_anti"), found, now_ms).select("folder", "taken_ms")
    kept = entries.join(usable.select("folder"), "folder", "left_semi")
    return status, usable.unionByName(taken), stage(kept.unionByName(found), "snapshot"), failed


def _looked_at(joined: DataFrame, entries: DataFrame, known: DataFrame, o: SyncOptions) -> DataFrame:
    """Hashes (folder, name, r_md5, hit, and the remote file's stamp) of the remote files that matter to a decision.

    One that the snapshot or the hash store knows is not read.
    """
    wanted = remote_hash_matters(joined).select("folder", "name").distinct()
    files = entries.where("NOT is_collection").join(wanted, ["folder", "name"], "left_semi")
    told = files.where("md5 IS NOT NULL").withColumn("sha256", F.lit(None).cast("string")).withColumn("hit", F.lit(True))
    untold = files.where("md5 IS NULL").drop("md5")
    return told.unionByName(hashed(untold, known, file_hasher(False, o.tasks)))


def _checked(sent: DataFrame, o: SyncOptions) -> DataFrame:
    """Adds the state of each copy: verified against a second reading, failed or superseded."""
    if o.verify:
        place = [F.lit("").alias("folder"), F.col("copied_to").alias("name")]
        server = hash_files(sent.where(F.col("error").isNull()).select(F.col("copied_to").alias("path"), "length"), tasks=o.tasks)
        proof = verify_outcomes(
            sent.select("path", "md5", *place),
            server.select(F.lit("").alias("folder"), F.col("path").alias("name"), "md5"))
        rated = sent.join(proof.select("path", "state", "verify_method", "last_error"), "path")
    else:
        rated = sent.select("*", F.lit(S.UPLOADED).alias("state"),
                            F.lit(VerifyMethod.NONE).alias("verify_method"),
                            F.lit(None).cast("string").alias("last_error"))
    broken = F.col("error").isNotNull()
    # The copying task has looked at the source when it was done; a source that is gone by then has changed too.
    same = stamp_matches(F.col("length"), F.col("mtime_ms"), F.col("length_after"), F.col("mtime_after"))
    stale = ~F.coalesce(same, F.lit(False))
    return rated.select(
        "path", "length", "mtime_ms", "destination", "folder", "name", "copied_to", "bytes", "md5", "sha256",
        (~broken & stale).alias("stale"),
        F.when(broken, S.FAILED).when(stale, S.SUPERSEDED).otherwise(F.col("state")).alias("state"),
        F.when(broken | stale, VerifyMethod.NONE).otherwise(F.col("verify_method"))
        .alias("verify_method"),
        F.when(broken, F.col("error")).when(stale, _SUPERSEDED).otherwise(F.col("last_error"))
        .alias("last_error"))


def _ledger_rows(done: DataFrame, ledger: DataFrame, now_ms: int) -> DataFrame:
    """Ledger rows of a pass; what a file's earlier row knew is carried on.

    ``started`` uploads count as an attempt. A conflict keeps the earlier standing.
    """
    old = keyed(ledger, "local_path").select(
        "path_key", F.col("md5").alias("o_md5"), F.col("sha256").alias("o_sha256"),
        F.col("attempts").alias("o_attempts"), F.col("verify_method").alias("o_method"),
        F.col("verified_utc").alias("o_utc"), F.col("is_dataset").alias("o_dataset"))
    highest = F.coalesce(ledger.agg(F.max("first_seen_seq")).scalar(), F.lit(0))
    state, method = F.col("state"), F.col("verify_method")
    proven = method == VerifyMethod.SERVER_MD5
    conflict = state == S.CONFLICT
    now = F.timestamp_millis(F.lit(now_ms))
    return keyed(done, "path").join(old, "path_key", "left").select(
        F.col("path").alias("local_path"), F.col("destination").alias("remote_path"),
        F.col("length").alias("size"), F.col("mtime_ms").alias("mtime_utc"),
        F.coalesce("md5", "o_md5").alias("md5"), F.coalesce("sha256", "o_sha256").alias("sha256"),
        state.cast("int").alias("state"),
        F.when(conflict, F.coalesce("o_method", F.lit(0))).otherwise(method).cast("int")
        .alias("verify_method"),
        F.when(conflict, F.col("o_utc")).when(proven, now).alias("verified_utc"),
        (F.coalesce("o_attempts", F.lit(0)) + F.col("started")).cast("int").alias("attempts"),
        "last_error", F.coalesce("o_dataset", F.lit(False)).alias("is_dataset"),
        (highest + 1 + F.monotonically_increasing_id()).alias("first_seen_seq"))


def _announced(work: DataFrame, ledger: DataFrame, now_ms: int) -> DataFrame:
    """Ledger rows that say an upload has begun, written before the first byte is copied."""
    nothing = F.lit(None).cast("string")
    begun = work.select(
        "path", "length", "mtime_ms", "destination", nothing.alias("md5"), nothing.alias("sha256"),
        F.lit(S.UPLOADING).alias("state"), F.lit(VerifyMethod.NONE).alias("verify_method"),
        nothing.alias("last_error"), F.lit(1).alias("started"))
    return _ledger_rows(begun, ledger, now_ms)


def _recovered(ledger: DataFrame, inventory: DataFrame) -> DataFrame:
    """What becomes of the rows that an earlier pass left unfinished: (local_path, action, last_error).

    A file outside the inventory is looked at before it is given up, since the inventory may be of other folders.
    """
    found = stage(recover_interrupted(ledger, inventory), "interrupted")
    lost = found.where("action = 'fail'")
    still = stat_files(lost, "local_path").select(F.col("path").alias("local_path"), F.lit(True).alias("there"))
    there = F.col("there").isNotNull()
    return found.where("action <> 'fail'").unionByName(lost.join(still, "local_path", "left").select(
        "local_path", F.when(there, "requeue").otherwise(F.col("action")).alias("action"),
        F.when(~there, F.col("last_error")).alias("last_error")))


def one_pass_sync(spark: SparkSession, store: LedgerStore, options: SyncOptions, now_ms: int,
                  elapsed_seconds: float = 0.0, paths: DataFrame | None = None, hashes: HashStore | None = None,
                  snapshots: SnapshotStore | None = None) -> SyncResult:
    """Runs a whole pass and commits the next version of the ledger.

    Without ``paths`` the root is walked, else only the named files are looked at. ``hashes`` and ``snapshots`` are kept
    beside the ledger if none are given. Every stage that is read twice or has side effects is written once
    and read back, so a lost executor repeats its own tasks only, and no file is copied twice for one
    decision. Before the copies a version of the ledger is committed that has them as begun.
    """
    o = options
    hashes = hashes or HashStore(spark, f"{store.path}/hashes")
    snapshots = snapshots or SnapshotStore(spark, f"{store.path}/remote")
    ledger, upto = store.snapshot()
    if paths is None:
        scanned = stage(scan_tree(spark, o.root, o.recursive), "scan")
    else:
        scanned = stage(stat_files(paths).withColumn("problem", F.lit(None).cast("string")), "scan")
    inventory = scanned.where(F.col("problem").isNull()).drop("problem")
    recovered = stage(_recovered(ledger, inventory), "recovered")
    swept = stage(sweep(inventory, ledger, o.root, o.dest_root, o.extensions, o.max_attempts),
                  "sweep")
    # What was interrupted is offered again, also where the filter or the walk would pass it over.
    again = recovered.where("action = 'requeue'").select(F.col("local_path").alias("path"))
    beside = stage(keyed(again, "path").join(keyed(swept, "path").select("path_key"), "path_key", "left_anti"), "beside")
    offered = swept.where(~F.col("accounted")).select("path", "length", "mtime_ms")
    if not beside.isEmpty():
        chosen = union_candidates(offered, beside)
        offered = stage(chosen.join(offered.unionByName(stat_files(beside)), "path"), "offered")

    known = hashes.read()
    files = stage(located(offered, o.root, o.dest_root), "located")
    status, folders, entries, failed = refreshed(files, snapshots, o.mirror, o.dest_root, now_ms, o.snapshot_ms)
    unlisted = files.join(failed, "folder")
    files = files.join(failed, "folder", "left_anti")
    listed = entries.select("folder", "name", "is_collection", F.col("length").alias("r_length"))
    joined = stage(with_ledger(files, ledger).join(listed, ["folder", "name"], "left"), "joined")
    theirs = stage(_looked_at(joined, entries, known, o), "theirs")
    classified = stage(stepped(joined.join(
        theirs.select("folder", "name", F.lower("md5").alias("r_md5")), ["folder", "name"], "left")), "classified")
    ours = stage(hashed(classified.where(F.col("step") == OPEN), known, file_hasher(o.sha256, o.tasks)), "ours")
    sizes = ours.select(F.col("length").alias("size")).distinct()
    policy = F.lit(o.policy)
    decisions = stage(cheap_decisions(classified, policy).unionByName(
        conclude(ours.drop("hit"), ledger.join(sizes, "size", "left_semi"), policy)), "decisions")
    cache = lambda rows: rows.select(F.col("path").alias("local_path"), F.col("length").alias("size"),
                                     F.col("mtime_ms").alias("mtime_utc"), "md5", "sha256")
    read = ours.select("path", "length", "mtime_ms", "md5", "sha256", "hit").unionByName(
        theirs.select("path", "length", "mtime_ms", "md5", "sha256", "hit"))
    learnt = cache(read.where(~F.col("hit")))

    work = decisions.where(F.col("action") == "Upload").join(
        classified.select("path", "folder", "name"), "path").withColumn("target", _below_mirror(F.col("destination"), o.dest_root))
    if not work.isEmpty():
        # A folder that is about to change is known again only when its copies are verified.
        snapshots.write(folders.join(work.select("folder"), "folder", "left_anti"),
                        entries.join(work.select("folder"), "folder", "left_anti"))
        store.commit(ledger_upsert(ledger, stage(_announced(work, ledger, now_ms), "announced")), upto)
    outcomes = stage(mirror_copy(work, o.mirror, o.sha256, o.tasks)
                     .withColumnRenamed("destination", "copied_to"), "outcomes")
    sent = work.select("path", "length", "mtime_ms", "destination", "folder", "name").join(outcomes, "path")
    final = stage(_checked(sent, o), "checked")

    # A copy's own pass has made its hash: good for the source, and for the copy once that was read back.
    whole = final.where("NOT stale AND md5 IS NOT NULL AND bytes = length")
    verified = final.where((F.col("state") == S.VERIFIED))
    hashes.feed(learnt.unionByName(cache(whole)).unionByName(cache(
        verified.select(F.col("copied_to").alias("path"), F.col("bytes").alias("length"), "mtime_ms", "md5", "sha256"))))
    settled = decisions.where(F.col("action") != "Upload").select(
        "path", "length", "mtime_ms", "destination", F.lit(0).cast("bigint").alias("bytes"),
        F.coalesce("md5", "remote_hash").alias("md5"), "sha256",
        F.when(F.col("action") == "Skip", S.SKIPPED).otherwise(S.CONFLICT).alias("state"),
        F.col("implied_verification").alias("verify_method"),
        F.when(F.col("action") == "Conflict", F.col("reason")).alias("last_error"))
    nothing = F.lit(None).cast("string")
    refused = unlisted.select(
        "path", "length", "mtime_ms", "destination", F.lit(0).cast("bigint").alias("bytes"), nothing.alias("md5"),
        nothing.alias("sha256"), F.lit(S.FAILED).alias("state"), F.lit(VerifyMethod.NONE).alias("verify_method"),
        F.col("problem").alias("last_error"))
    done = final.select(settled.columns).unionByName(settled).unionByName(refused)

    # The ledger may have had changes since; what was announced is in it, with its attempt counted.
    ledger, upto = store.snapshot()
    updates = stage(_ledger_rows(done.withColumn("started", F.lit(0)), ledger, now_ms), "rows")
    # A file without a destination is recorded too, so that it does not fail unseen.
    rejected = destination_plan(offered, o.root, o.dest_root).where(F.col("destination").isNull())
    unknown = ledger_fail_unknown(ledger, rejected.select(
        F.col("path").alias("local_path"), "length", "mtime_ms",
        F.col("message").alias("last_error"), F.lit(0).cast("bigint").alias("first_seen_seq")))
    numbers = ledger.select("first_seen_seq").unionByName(updates.select("first_seen_seq"))
    highest = F.coalesce(numbers.agg(F.max("first_seen_seq")).scalar(), F.lit(0))
    unknown = stage(unknown.withColumn(
        "first_seen_seq", highest + 1 + F.monotonically_increasing_id()), "unknown")
    gone = recovered.where("action = 'fail'").select("local_path", F.lit(S.FAILED).alias("state"), "last_error")
    store.commit(ledger_upsert(ledger_set_state(ledger, gone), updates.unionByName(unknown)), upto)

    sent = verified.select("folder", "name", F.col("bytes").alias("length"), "md5", "mtime_ms", F.col("copied_to").alias("path"))
    sidecars = None
    if o.sidecars:
        target = _below_mirror(F.col("destination"), o.dest_root)
        texts = stage(verified.select("folder", F.concat("name", F.lit(".md5")).alias("name"), F.concat(target, F.lit(".md5")).alias("target"),
                      sidecar_text(file_name(target), F.col("md5"), F.col("sha256"),
                                   F.col("bytes"), F.timestamp_millis("mtime_ms"),
                                   F.timestamp_millis(F.lit(now_ms)), F.lit(o.producer)).alias("text")), "texts")
        sidecars = stage(write_sidecars(texts.select("target", "text"), o.mirror), "sidecars")
        sent = sent.unionByName(texts.select(
            "folder", "name", F.octet_length("text").cast("bigint").alias("length"), F.md5(F.col("text").cast("binary")).alias("md5"),
            F.lit(None).cast("bigint").alias("mtime_ms"), F.lit(None).cast("string").alias("path")))
    # A folder with a copy that is not proven is asked for again.
    doubtful = final.where(F.col("state") != S.VERIFIED).select("folder").distinct()
    sure = folders.join(doubtful, "folder", "left_anti")
    snapshots.write(sure, snapshot_overlay(entries.join(doubtful, "folder", "left_anti"), sure, sent))

    found = sweep_summary(swept)
    summary = run_summary(
        done.select("state", "bytes").unionByName(unknown.select(
            "state", F.lit(0).cast("bigint").alias("bytes"))),
        elapsed_seconds, found.select("accounted").scalar())
    return SyncResult(swept, found, scan_problem(scanned, o.root), decisions, final, summary,
                      sidecars, recovered, status, read)
