"""Reconciling a local inventory with the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stowage.functions.paths import (
    destination_of, path_key, relative_path, stored_name, with_destination)
from stowage.functions.rules import candidate_filter, is_accounted_for, stamp_matches
from stowage.plans.staging import stage
from stowage.schema import INTERRUPTED_STATES, MAX_UPLOAD_ATTEMPTS

#: Keys that a name's sources are spread over.
_SALTS = 16
_LEDGER_COLUMNS = ("remote_path", "size", "mtime_utc", "state", "verify_method", "attempts")


def keyed(df: DataFrame, path: str) -> DataFrame:
    """Adds the join key, unless the table already stores it (as a bucketed ledger does)."""
    return df if "path_key" in df.columns else df.withColumn("path_key", path_key(F.col(path)))


def candidates(inventory: DataFrame, extensions: list[str] | tuple[str, ...] = ()) -> DataFrame:
    return inventory.where(candidate_filter(F.col("path"), extensions))


def join_ledger(inventory: DataFrame, ledger: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Left join on the case-folded path; ledger columns get the prefix ``l_``.

    Both sides hold at most one row per path, so the key cannot be hot. A ledger bucketed by
    ``path_key`` is not shuffled again.
    """
    right = keyed(ledger, "local_path").select(
        "path_key", F.lit(True).alias("l_known"), *[F.col(c).alias(f"l_{c}") for c in columns])
    return (keyed(inventory, "path").join(right, "path_key", "left")
            .withColumn("l_known", F.coalesce("l_known", F.lit(False))))


def sweep(inventory: DataFrame, ledger: DataFrame, base: str, dest_root: str,
          extensions: list[str] | tuple[str, ...] = (),
          max_attempts: int = MAX_UPLOAD_ATTEMPTS) -> DataFrame:
    """Every candidate file with its destination and whether the ledger answers for it."""
    joined = join_ledger(candidates(inventory, extensions), ledger, _LEDGER_COLUMNS)
    # The relative path is a column of its own, so that it is worked out once.
    located = (joined.withColumn("_rel", relative_path(F.col("path"), base))
               .withColumn("destination", destination_of(F.col("_rel"), dest_root)))
    accounted = is_accounted_for(
        F.col("l_known"), F.col("l_state"), F.col("l_verify_method"), F.col("l_size"),
        F.col("l_mtime_utc"), F.col("l_remote_path"), F.col("l_attempts"),
        F.col("length"), F.col("mtime_ms"), F.col("destination"), max_attempts)
    return located.select(*inventory.columns, "destination", accounted.alias("accounted"))


def sweep_summary(swept: DataFrame) -> DataFrame:
    return swept.agg(
        F.count(F.lit(1)).alias("examined"),
        F.count_if(~F.col("accounted")).alias("offered"),
        F.count_if(F.col("accounted")).alias("accounted"))


def destination_plan(inventory: DataFrame, base: str, dest_root: str) -> DataFrame:
    """One row per file: where it goes, or why it cannot go anywhere."""
    return with_destination(inventory, base, dest_root)


def destination_folders(destinations: DataFrame, segments: str = "segments") -> DataFrame:
    """Every folder that must exist, once, with its depth so that parents sort first.

    ``segments`` holds the decoded segments of each file's destination.
    """
    # Distinct parents first: there are far fewer folders than files.
    parents = (destinations
               .select(F.slice(F.col(segments), F.lit(1), F.size(segments) - 1).alias("p"))
               .where(F.size("p") > 0).distinct())
    steps = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.slice(F.col("p"), 1, i))
    return (parents.select(F.explode(steps).alias("segments")).distinct()
            .select("segments", F.size("segments").alias("depth")))


def stored_name_collisions(destinations: DataFrame, segments: str = "segments") -> DataFrame:
    """Sources whose destinations fall on one stored name, one row per source.

    The names are written once and read from there. The counts are combined before the shuffle, and no group is
    gathered. Sources meet their counts by name and salt, so a name that a third of all files share is spread over
    ``_SALTS`` keys. ``decoded_collision`` marks sources that share the whole destination, which happens when
    a local name holds escapes.
    """
    sources = stage(destinations.select(
        F.array_join(stored_name(F.col(segments)), "/").alias("stored"),
        F.array_join(F.col(segments), "/").alias("destination_path"), "path"), "stored")
    exact = sources.groupBy("stored", "destination_path").agg(F.count(F.lit(1)).alias("same"))
    names = (exact.groupBy("stored").agg(F.sum("same").alias("sources"))
             .where(F.col("sources") > 1))
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    clashes = exact.join(names, "stored").withColumn("salt", salts)
    return (sources.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(_SALTS)).cast("int"))
            .join(clashes, ["stored", "destination_path", "salt"])
            .select("stored", "path", "destination_path", "sources",
                    (F.col("same") > 1).alias("decoded_collision")))


def ledger_lookup(ledger: DataFrame, paths: DataFrame, path: str = "path") -> DataFrame:
    """The ledger rows of a set of paths; a path without a row stays absent."""
    wanted = paths.select(path_key(F.col(path)).alias("path_key"))
    return keyed(ledger, "local_path").join(wanted, "path_key", "left_semi").drop("path_key")


def superseded(outcomes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Copied files whose stamp changed while they were being sent.

    ``outcomes`` carries the stamp taken before the copy (length, mtime_ms).
    """
    after = keyed(fresh, "path").select(
        "path_key", F.col("length").alias("length_after"), F.col("mtime_ms").alias("mtime_after"))
    return (keyed(outcomes, "path").join(after, "path_key")
            .where(~stamp_matches(F.col("length"), F.col("mtime_ms"),
                                  F.col("length_after"), F.col("mtime_after")))
            .drop("path_key"))


def recover_interrupted(ledger: DataFrame, inventory: DataFrame) -> DataFrame:
    """What to do with rows a previous run left mid-flight."""
    hanging = keyed(ledger, "local_path").where(F.col("state").isin(*INTERRUPTED_STATES))
    present = keyed(inventory, "path").select("path_key", F.lit(True).alias("present"))
    joined = hanging.join(present, "path_key", "left")
    return joined.select(
        "local_path",
        F.when(F.col("present"), "requeue").otherwise("fail").alias("action"),
        F.when(F.col("present").isNull(), "The local file no longer exists.").alias("last_error"))


def in_flight_gate(offered: DataFrame, in_flight: DataFrame) -> DataFrame:
    """Candidates not yet accepted in this run, each path once."""
    first = (keyed(offered, "path").groupBy("path_key").agg(F.min("path").alias("path")))
    busy = in_flight.select(path_key(F.col("path")).alias("path_key"))
    return first.join(busy, "path_key", "left_anti").select("path")


def union_candidates(swept: DataFrame, noticed: DataFrame) -> DataFrame:
    """Swept and noticed files, each path once; the swept spelling wins."""
    both = (swept.select("path", F.lit(0).alias("rank"))
            .unionByName(noticed.select("path", F.lit(1).alias("rank"))))
    return (keyed(both, "path").groupBy("path_key")
            .agg(F.min(F.struct("rank", "path"))["path"].alias("path")).select("path"))
