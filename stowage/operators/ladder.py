"""The three-tier decision: ledger, remote listing, content hash.

The cheap tiers are one chain of left joins and CASE expressions. Only files that those leave open
reach the hasher, because a Python hash inside a CASE branch would run for every row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from stowage.functions.paths import path_key, with_destination
from stowage.functions.rules import implied_verification, is_settled_at
from stowage.operators.sweep import join_ledger
from stowage.plans.staging import stage
from stowage.schema import ConflictPolicy, DecisionTier, SETTLED_STATES, VerifyMethod

Hasher = Callable[[DataFrame], DataFrame]

_LEDGER_COLUMNS = ("remote_path", "size", "mtime_utc", "md5", "state", "verify_method")

# Reasons shown to the user.
SETTLED = "Already uploaded and verified; unchanged since."
ABSENT = "Not present on the server."
CHANGED = "The local file has changed since it was uploaded."
IDENTICAL = "An identical copy is already on the server."
NO_HASH = ("A file of the same size is already there, but the server did not report a hash for "
           "it, so it cannot be confirmed identical.")
DIFFERENT = ("A file with the same name and size but different content is already on the server.")

# What the first two tiers concluded.
BY_LEDGER, BY_ABSENCE, BY_FOLDER = "ledger", "absent", "folder"
BY_SIZE_OURS, BY_SIZE, BY_NO_HASH, OPEN = "size_ours", "size", "no_hash", "open"


def remote_snapshot(entries: DataFrame, hashes: DataFrame) -> DataFrame:
    """Listing rows with the hash of each name, one for each (folder, name).

    A name listed twice is a folder if either entry is one, and has no hash if two differ. The
    aggregates are on the keys of the join, so they add no exchange.
    """
    key = ["folder", "name"]
    listed = entries.groupBy(*key).agg(F.bool_or("is_collection").alias("is_collection"),
                                       F.max("length").alias("r_length"))
    known = hashes.groupBy(*key).agg(F.min(F.lower("md5")).alias("least"),
                                     F.max(F.lower("md5")).alias("most"))
    return listed.join(known.select(*key, F.when(F.col("least") == F.col("most"), F.col("most"))
                                    .alias("r_md5")), key, "left")


def remote_is_ours(ledger_remote: Column, ledger_md5: Column, destination: Column,
                   remote_md5: Column) -> Column:
    """The remote copy is the one this ledger recorded for that destination."""
    return F.coalesce((ledger_remote == destination)
                      & (F.lower(ledger_md5) == F.lower(remote_md5)), F.lit(False))


def conflict_policy(policy: Column) -> dict[str, Column]:
    """Action and reason suffix of a clash, and whether the remote hash is kept."""
    # The sentences are shown to the user.
    return {
        "action": F.when(policy == ConflictPolicy.SKIP, "Skip")
        .when(policy == ConflictPolicy.OVERWRITE, "Upload").otherwise("Conflict"),
        "suffix": F.when(policy == ConflictPolicy.SKIP, " Skipped by policy.")
        .when(policy == ConflictPolicy.OVERWRITE, " Overwriting by policy.")
        .when(policy == ConflictPolicy.RENAME, " A new name is needed.").otherwise(""),
        "keeps_hash": ~policy.isin(ConflictPolicy.SKIP, ConflictPolicy.OVERWRITE),
    }


def located(inventory: DataFrame, base: str, dest_root: str) -> DataFrame:
    """Files that have a destination; the rest belong to ``destination_plan``'s rejected side."""
    return (with_destination(inventory, base, dest_root, resolved_only=True)
            .drop("reason", "message"))


def with_ledger(files: DataFrame, ledger: DataFrame) -> DataFrame:
    joined = join_ledger(files, ledger, _LEDGER_COLUMNS)
    settled = is_settled_at(
        F.col("l_state"), F.col("l_verify_method"), F.col("l_size"), F.col("l_mtime_utc"),
        F.col("l_remote_path"), F.col("length"), F.col("mtime_ms"), F.col("destination"))
    return joined.withColumn("settled", settled)


def classify(files: DataFrame, ledger: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Tiers 0 and 1: adds ``step``, what they concluded, or ``open`` where a hash is needed.

    ``files`` has path, length, mtime_ms, destination, folder and name.
    """
    return stepped(with_ledger(files, ledger).join(snapshot, ["folder", "name"], "left"))


def remote_hash_matters(joined: DataFrame) -> DataFrame:
    """Of files with their ledger row and remote entry, those whose step depends on the remote file's hash.

    It is asked for if the sizes are equal, or if the ledger says that it wrote this very copy.
    """
    ours = (F.col("l_remote_path") == F.col("destination")) & F.col("l_md5").isNotNull()
    return joined.where(~F.col("settled") & ~F.col("is_collection")
                        & ((F.col("r_length") == F.col("length")) | F.coalesce(ours, F.lit(False))))


def stepped(joined: DataFrame) -> DataFrame:
    """``classify`` for files that already have their ledger row and remote entry (is_collection, r_length, r_md5)."""
    ours = remote_is_ours(F.col("l_remote_path"), F.col("l_md5"), F.col("destination"),
                          F.col("r_md5"))
    differs = F.col("r_length") != F.col("length")
    step = (F.when(F.col("settled"), BY_LEDGER)
            .when(F.col("is_collection").isNull(), BY_ABSENCE)
            .when(F.col("is_collection"), BY_FOLDER)
            .when(differs & ours, BY_SIZE_OURS)
            .when(differs, BY_SIZE)
            .when(F.col("r_md5").isNull(), BY_NO_HASH)
            .otherwise(OPEN))
    return joined.select(
        "path", "length", "mtime_ms", "destination", "folder", "name",
        "l_md5", "r_length", "r_md5", ours.alias("ours"), step.alias("step"))


def _outcome(action: Column, tier: Column, reason: Column, remote_hash: Column,
             md5: Column | None = None, sha256: Column | None = None,
             elsewhere: Column | None = None) -> list[Column]:
    nothing = F.lit(None).cast("string")
    return [
        F.col("path"), F.col("length"), F.col("mtime_ms"), F.col("destination"),
        action.alias("action"), tier.alias("tier"),
        reason.alias("reason"),
        (nothing if md5 is None else md5).alias("md5"),
        (nothing if sha256 is None else sha256).alias("sha256"),
        remote_hash.alias("remote_hash"),
        (nothing if elsewhere is None else elsewhere).alias("already_uploaded_as"),
        implied_verification(action, remote_hash).alias("implied_verification"),
    ]


def cheap_decisions(classified: DataFrame, policy: Column) -> DataFrame:
    """The decisions of the files that tiers 0 and 1 settle."""
    # The sentences are shown to the user.
    step = F.col("step")
    clash = conflict_policy(policy)
    action = (F.when(step == BY_LEDGER, "Skip")
              .when(step.isin(BY_ABSENCE, BY_SIZE_OURS), "Upload")
              .when(step == BY_FOLDER, "Conflict")
              .otherwise(clash["action"]))
    by_size = F.concat(
        F.lit("A different file is already there ("), F.format_number("r_length", 0),
        F.lit(" bytes on the server, "), F.format_number("length", 0), F.lit(" locally)."))
    reason = (F.when(step == BY_LEDGER, SETTLED)
              .when(step == BY_ABSENCE, ABSENT)
              .when(step == BY_FOLDER, F.concat(
                  F.lit("A folder named '"), F.col("name"),
                  F.lit("' already occupies the destination.")))
              .when(step == BY_SIZE_OURS, CHANGED)
              .when(step == BY_SIZE, F.concat(by_size, clash["suffix"]))
              .otherwise(F.concat(F.lit(NO_HASH), clash["suffix"])))
    tier = F.when(step == BY_LEDGER, DecisionTier.LEDGER).otherwise(DecisionTier.REMOTE_SNAPSHOT)
    remote_hash = F.when(step == BY_LEDGER, F.col("l_md5"))
    return (classified.where(step != OPEN)
            .select(*_outcome(action, tier, reason, remote_hash)))


def cached_hashes(files: DataFrame, hash_cache: DataFrame) -> DataFrame:
    """Adds md5, sha256 and ``hit``. A row without MD5 is a miss; a missing SHA-256 is not.

    The cache is folded to one row per key, on the keys of the join, so that a key it holds twice multiplies
    nothing. Of hashes that disagree none is believed: that file is a miss.
    """

    def agreed(name: str) -> Column:
        least, most = F.min(F.lower(name)), F.max(F.lower(name))
        return F.when(least == most, F.max(name)).alias(name)

    cache = hash_cache.where(F.col("md5").isNotNull()).select(
        path_key(F.col("local_path")).alias("path_key"), F.col("size").alias("length"),
        F.col("mtime_utc").alias("mtime_ms"), "md5", "sha256").groupBy(
        "path_key", "length", "mtime_ms").agg(agreed("md5"), agreed("sha256"))
    return (files.withColumn("path_key", path_key(F.col("path")))
            .join(cache, ["path_key", "length", "mtime_ms"], "left")
            .withColumn("hit", F.col("md5").isNotNull())
            .drop("path_key"))


def hashed(files: DataFrame, hash_cache: DataFrame | None, hasher: Hasher) -> DataFrame:
    """Adds md5, sha256 and ``hit`` to every file; the hasher is given only the cache misses.

    The hasher keeps the columns it is given and adds md5 and sha256.
    """
    if hash_cache is None:
        return hasher(files).withColumn("hit", F.lit(False))
    # Written once: hits, misses and their sizes are read from it, and the cache is joined once.
    looked_up = stage(cached_hashes(files, hash_cache), "looked-up")
    misses = looked_up.where(~F.col("hit")).drop("hit", "md5", "sha256")
    return looked_up.where("hit").unionByName(hasher(misses).withColumn("hit", F.lit(False)))


def settled_contents(ledger: DataFrame) -> DataFrame:
    """One settled row per (size, md5): the first inserted."""
    rows = ledger.where(F.col("state").isin(*SETTLED_STATES)
                        & (F.col("verify_method") == VerifyMethod.SERVER_MD5)
                        & F.col("md5").isNotNull())
    return (rows.groupBy(F.col("size").alias("length"), F.lower("md5").alias("md5"))
            .agg(F.min_by("local_path", "first_seen_seq").alias("already_uploaded_as")))


def find_by_content(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Adds the settled ledger path that holds the same bytes, NULL where there is none.

    Many files may share one content. The ledger side is cut to one row per content by a partial
    aggregate; a content that many of the files share is split by the adaptive skew join.
    """
    return (files.withColumn("md5", F.lower("md5"))
            .join(settled_contents(ledger), ["length", "md5"], "left"))


def conclude(files: DataFrame, ledger: DataFrame, policy: Column) -> DataFrame:
    """Tier 2: decisions of hashed files."""
    joined = find_by_content(files, ledger)
    clash = conflict_policy(policy)
    same = F.col("md5") == F.lower("r_md5")
    ours = F.col("ours")
    action = (F.when(same, "Skip").when(ours, "Upload").otherwise(clash["action"]))
    reason = (F.when(same, IDENTICAL).when(ours, CHANGED)
              .otherwise(F.concat(F.lit(DIFFERENT), clash["suffix"])))
    remote_hash = F.when(same | (~ours & clash["keeps_hash"]), F.col("r_md5"))
    elsewhere = F.when(~same & ~ours, F.col("already_uploaded_as"))
    return joined.select(*_outcome(action, F.lit(DecisionTier.LOCAL_HASH), reason, remote_hash,
                                   F.col("md5"), F.col("sha256"), elsewhere))


def decide_classified(classified: DataFrame, ledger: DataFrame, hash_cache: DataFrame | None,
                      hasher: Hasher, policy: Column | int = ConflictPolicy.ASK) -> DataFrame:
    policy = F.lit(policy) if isinstance(policy, int) else policy
    pending = classified.where(F.col("step") == OPEN)
    # Only ledger rows of a size that is still open can hold the same content.
    sizes = pending.select(F.col("length").alias("size")).distinct()
    return cheap_decisions(classified, policy).unionByName(conclude(
        hashed(pending, hash_cache, hasher), ledger.join(sizes, "size", "left_semi"), policy))


def decide(files: DataFrame, ledger: DataFrame, snapshot: DataFrame,
           hash_cache: DataFrame | None, hasher: Hasher,
           policy: Column | int = ConflictPolicy.ASK) -> DataFrame:
    """The whole ladder, one row per file of ``located``.

    What tiers 0 and 1 concluded is written once: both the cheap decisions and the residue read it.
    """
    classified = stage(classify(files, ledger, snapshot), "classified")
    return decide_classified(classified, ledger, hash_cache, hasher, policy)


def tier0_settled(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files the ledger alone settles."""
    return with_ledger(files, ledger).where("settled").select(
        "path", "destination", F.lit("Skip").alias("action"),
        F.lit(DecisionTier.LEDGER).alias("tier"), F.lit(SETTLED).alias("reason"),
        F.col("l_md5").alias("remote_hash"))


def tier1_remote(classified: DataFrame, policy: Column | int = ConflictPolicy.ASK) -> DataFrame:
    """Decisions that a look at the remote folder settles."""
    policy = F.lit(policy) if isinstance(policy, int) else policy
    return cheap_decisions(classified, policy).where(
        F.col("tier") == DecisionTier.REMOTE_SNAPSHOT)


def tier2_hash(classified: DataFrame, ledger: DataFrame, hash_cache: DataFrame | None,
               hasher: Hasher, policy: Column | int = ConflictPolicy.ASK) -> DataFrame:
    """Decisions that need the local content."""
    policy = F.lit(policy) if isinstance(policy, int) else policy
    pending = classified.where(F.col("step") == OPEN)
    return conclude(hashed(pending, hash_cache, hasher), ledger, policy)


def tier_counts(decisions: DataFrame) -> DataFrame:
    """What the decisions cost."""
    return decisions.groupBy("tier", "action").agg(F.count(F.lit(1)).alias("files"))
