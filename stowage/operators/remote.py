"""Remote folders: catalogues, snapshots, manifests and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stowage.functions.labels import format_bytes
from stowage.functions.paths import map_drive_path
from stowage.functions.rules import allows_method, atomic_publish, is_sidecar
from stowage.plans.staging import stage
from stowage.schema import SNAPSHOT_LIFETIME_MS, TransferState as S, VerifyMethod

# What a failed verification says.
NO_SERVER_HASH = ("The server did not report a hash for the uploaded file, so it could not be "
                  "verified.")


def remote_catalog(entries: DataFrame) -> DataFrame:
    """Listing rows with their verbs, writability and kind spelled out."""
    p = F.col("permissions")
    return entries.select(
        "folder", "name", "path", "is_collection", "length", "last_modified", "etag",
        "content_type", "created_by",
        p["can_read"].alias("can_read"), p["can_upload"].alias("can_upload"),
        p["can_edit"].alias("can_edit"), p["can_delete"].alias("can_delete"),
        p["can_rename"].alias("can_rename"),
        F.array_join(p["allowed_methods"], ", ").alias("methods"),
        allows_method(p["allowed_methods"], "PUT").alias("accepts_put"),
        atomic_publish(p).alias("atomic_publish"),
        is_sidecar(F.col("name")).alias("is_sidecar"))


def writable_folders(entries: DataFrame) -> DataFrame:
    """The folders a person may choose from, each with a hint on whether it takes uploads."""
    # The sentences are shown to the user.
    can = F.col("can_upload")
    # Written once: a sort reads its rows twice, and they may be parsed from listings.
    chosen = stage(entries.where(F.col("is_collection") & ~F.col("name").startswith("."))
                   .select("folder", "name", F.col("permissions.can_upload").alias("can_upload")), "folders")
    return (chosen.select("folder", "name", "can_upload",
                          F.when(can, "You can upload to this folder.").otherwise(
                              "Read-only. A server administrator would need to grant write access.")
                          .alias("hint"))
            .orderBy("folder", F.lower("name"), "name"))


def listing_order(entries: DataFrame) -> DataFrame:
    """Folders first, then by name, as a directory listing shows them."""
    # Written once, as above.
    listed = stage(entries.select("folder", "name", "is_collection", "length"), "listed")
    return (listed.select(
        "folder", F.when(F.col("is_collection"), "DIR").otherwise("FILE").alias("kind"),
        F.when(F.col("is_collection"), "").otherwise(format_bytes(F.col("length"))).alias("size"),
        "name", "is_collection")
        .orderBy("folder", F.desc("is_collection"), "name").drop("is_collection"))


def hash_listing(hashes: DataFrame) -> DataFrame:
    """``md5sum`` lines in name order."""
    return (hashes.where(F.col("md5").isNotNull()).orderBy("folder", "name")
            .select("folder", "name", F.concat("md5", F.lit("  "), "name").alias("line")))


def folder_hash_count(entries: DataFrame, hashes: DataFrame) -> DataFrame:
    """Files and reported hashes per folder; a folder without hashes is listed too."""
    files = entries.where(~F.col("is_collection")).select(
        "folder", F.lit(1).alias("files"), F.lit(0).alias("hashes"))
    known = hashes.where(F.col("md5").isNotNull()).select(
        "folder", F.lit(0).alias("files"), F.lit(1).alias("hashes"))
    return (files.unionByName(known).groupBy("folder")
            .agg(F.sum("files").alias("files"), F.sum("hashes").alias("hashes")))


def destination_writable(destinations: DataFrame, entries: DataFrame,
                         server_allows_put: bool = True) -> DataFrame:
    """Looks each destination (destination, parent, name) up in its parent's listing."""
    # The sentences are shown to the user.
    known = entries.where("is_collection").select(
        F.col("folder").alias("parent"), "name",
        F.col("permissions.can_upload").alias("can_upload"), F.lit(True).alias("found"))
    joined = destinations.join(known, ["parent", "name"], "left")
    found = F.col("found").isNotNull()
    writable = F.coalesce("can_upload", F.lit(server_allows_put))
    where = F.col("destination")
    return joined.select(
        "destination", found.alias("found"), writable.alias("writable"),
        F.when(~found, F.concat(where, F.lit(
            " does not exist yet; it will be created on the first upload.")))
        .when(writable, F.concat(F.lit("You can upload to "), where, F.lit(".")))
        .otherwise(F.concat(where, F.lit(
            " is read-only for this account. A server administrator needs to grant write "
            "access."))).alias("detail"))


def map_drives(inventory: DataFrame, mapping: DataFrame, path: str = "path") -> DataFrame:
    """Replaces mapped drive letters (drive ``X:``, share) by their network share.

    There are at most 26 drive letters; the mapping is cut to one row each, and only that bounded
    table is broadcast.
    """
    drive = F.upper(F.substr(F.col(path), F.lit(1), F.lit(2)))
    shares = (mapping.select(F.upper("drive").alias("drive"), "share")
              .where(F.col("drive").rlike("^[A-Z]:$"))
              .groupBy("drive").agg(F.min("share").alias("share")))
    return (inventory.withColumn("drive", drive).join(F.broadcast(shares), "drive", "left")
            .withColumn("mapped_path", map_drive_path(F.col(path), F.col("share")))
            .drop("drive", "share"))


def verify_outcomes(outcomes: DataFrame, remote_hashes: DataFrame) -> DataFrame:
    """Compares each copy's hash with the server's; outcomes carry folder, name and md5."""
    server = remote_hashes.select("folder", "name", F.col("md5").alias("server_md5"))
    joined = outcomes.join(server, ["folder", "name"], "left")
    equal = F.lower("server_md5") == F.lower("md5")
    return joined.select(
        "path",
        F.when(equal, S.VERIFIED).otherwise(S.FAILED).alias("state"),
        F.when(equal, VerifyMethod.SERVER_MD5).otherwise(VerifyMethod.NONE).alias("verify_method"),
        F.when(F.col("server_md5").isNull(), NO_SERVER_HASH)
        .when(~equal, F.concat(
            F.lit("The server stored different content than was sent (server "), F.col("server_md5"),
            F.lit(", local "), F.col("md5"), F.lit(")."))).alias("last_error"),
        "md5", "server_md5")


def manifest_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """missing, extra, changed or match per (folder, name); names compare case-sensitively."""
    left = expected.select("folder", "name", F.col("md5").alias("expected_md5"),
                           F.lit(True).alias("e"))
    right = actual.select("folder", "name", F.col("md5").alias("actual_md5"),
                          F.lit(True).alias("a"))
    status = (F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra")
              .when(F.lower("expected_md5").eqNullSafe(F.lower("actual_md5")), "match")
              .otherwise("changed"))
    return (left.join(right, ["folder", "name"], "full")
            .select("folder", "name", "expected_md5", "actual_md5", status.alias("status")))


def name_except(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected names that are not there."""
    return expected.select("folder", "name").exceptAll(actual.select("folder", "name"))


def snapshot_overlay(entries: DataFrame, folders: DataFrame, verified: DataFrame) -> DataFrame:
    """Folds verified uploads into cached snapshots without extending their age.

    ``entries``: folder, name, is_collection, length, md5, and perhaps mtime_ms and path; ``folders``: folder, taken_ms;
    ``verified``: the same without is_collection. An upload into a folder without a snapshot is
    ignored. Only verified outcomes belong here: a copy that failed its check must not vouch for
    itself.
    """
    kept = ["is_collection", "length", "md5", *[c for c in ("mtime_ms", "path") if c in entries.columns]]
    columns = ["folder", "name", *kept]
    ours = (verified.withColumn("is_collection", F.lit(False)).select(*columns)
            .join(folders.select("folder"), "folder", "left_semi"))
    both = (entries.select(*columns, F.lit(0).alias("rank"))
            .unionByName(ours.select(*columns, F.lit(1).alias("rank"))))
    merged = (both.groupBy("folder", "name")
              .agg(F.max_by(F.struct(*kept), "rank").alias("r"))
              .select("folder", "name", "r.*"))
    return merged.join(folders.select("folder", "taken_ms"), "folder")


def snapshot_fresh(needed: DataFrame, folders: DataFrame, now_ms: int | Column,
                   lifetime_ms: int = SNAPSHOT_LIFETIME_MS) -> DataFrame:
    """Which needed folders have a usable snapshot and which must be listed again."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    usable = folders.where(now - F.col("taken_ms") <= lifetime_ms).select(
        "folder", "taken_ms")
    joined = needed.select("folder").distinct().join(usable, "folder", "left")
    return joined.withColumn(
        "status", F.when(F.col("taken_ms").isNull(), "refresh").otherwise("fresh"))


def fetched_folders(requested: DataFrame, listed: DataFrame, taken_ms: int) -> DataFrame:
    """Folder rows after a refresh; a folder the server does not have is an empty snapshot."""
    files = (listed.groupBy("folder").agg(F.count(F.lit(1)).alias("entries")))
    return (requested.select("folder").distinct().join(files, "folder", "left")
            .select("folder", F.coalesce("entries", F.lit(0)).alias("entries"),
                    F.lit(taken_ms).cast("bigint").alias("taken_ms")))
