"""Ledger maintenance as keyed merges of DataFrames.

Each function returns the new ledger. ``sinks.ledger_store`` writes it as a new version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stowage.functions.paths import path_key
from stowage.operators.sweep import keyed
from stowage.schema import LEDGER, TransferState as S, VerifyMethod

_COLUMNS = [f.name for f in LEDGER.fields]
_PAYLOAD = [c for c in _COLUMNS if c not in ("local_path", "first_seen_seq")]


def ledger_upsert(ledger: DataFrame, updates: DataFrame) -> DataFrame:
    """Inserts or replaces whole rows by path in any case.

    An existing row keeps its spelling and its ``first_seen_seq``. Updates carry a
    ``first_seen_seq`` above all existing ones for the rows that are new. Of several updates whose
    paths fold to one key the one with the latest stamp counts, then the one numbered last.
    """
    old = keyed(ledger, "local_path").select("path_key", F.struct(*_COLUMNS).alias("old"))
    new = keyed(updates, "local_path").groupBy("path_key").agg(F.max_by(
        F.struct(*_COLUMNS), F.struct("mtime_utc", "first_seen_seq")).alias("new"))
    joined = old.join(new, "path_key", "full")
    replaced = F.col("new").isNotNull()
    return joined.select(
        F.coalesce(F.col("old.local_path"), F.col("new.local_path")).alias("local_path"),
        *[F.when(replaced, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
          for c in _PAYLOAD],
        F.coalesce(F.col("old.first_seen_seq"), F.col("new.first_seen_seq"))
        .alias("first_seen_seq"))


def ledger_set_state(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """Applies (local_path, state, last_error), one change per path; unknown paths are ignored.

    Attempts count uploads that started, so only a change to Uploading adds one.
    """
    new = changes.select(path_key(F.col("local_path")).alias("path_key"),
                         F.lit(True).alias("hit"), F.col("state").alias("new_state"),
                         F.col("last_error").alias("new_error"))
    hit = F.col("hit").isNotNull()
    joined = keyed(ledger, "local_path").join(new, "path_key", "left")
    started = F.when(hit & (F.col("new_state") == S.UPLOADING), 1).otherwise(0)
    values = {
        "state": F.when(hit, F.col("new_state")).otherwise(F.col("state")),
        "last_error": F.when(hit, F.col("new_error")).otherwise(F.col("last_error")),
        "attempts": F.col("attempts") + started,
    }
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in _COLUMNS])


def ledger_mark_verified(ledger: DataFrame, verified: DataFrame,
                         method: int = VerifyMethod.SERVER_MD5) -> DataFrame:
    """Marks (local_path, verified_utc) as verified; unknown paths are ignored."""
    new = verified.select(path_key(F.col("local_path")).alias("path_key"),
                          F.lit(True).alias("hit"), F.col("verified_utc").alias("new_utc"))
    hit = F.col("hit").isNotNull()
    joined = keyed(ledger, "local_path").join(new, "path_key", "left")
    values = {
        "state": F.when(hit, S.VERIFIED).otherwise(F.col("state")),
        "verify_method": F.when(hit, method).otherwise(F.col("verify_method")),
        "verified_utc": F.when(hit, F.col("new_utc")).otherwise(F.col("verified_utc")),
        "last_error": F.when(~hit, F.col("last_error")),
    }
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in _COLUMNS])


def ledger_fail_unknown(ledger: DataFrame, failures: DataFrame) -> DataFrame:
    """New rows for failures (local_path, length, mtime_ms, last_error, first_seen_seq) of
    files the ledger has never seen."""
    known = ledger.select(path_key(F.col("local_path")).alias("path_key"))
    rows = keyed(failures, "local_path").join(known, "path_key", "left_anti")
    nothing = F.lit(None).cast("string")
    return rows.select(
        "local_path", F.lit("").alias("remote_path"),
        F.coalesce("length", F.lit(0)).cast("bigint").alias("size"),
        F.coalesce("mtime_ms", F.lit(0)).cast("bigint").alias("mtime_utc"),
        nothing.alias("md5"), nothing.alias("sha256"),
        F.lit(S.FAILED).alias("state"), F.lit(VerifyMethod.NONE).alias("verify_method"),
        F.lit(None).cast("timestamp").alias("verified_utc"), F.lit(0).alias("attempts"),
        "last_error", F.lit(False).alias("is_dataset"), "first_seen_seq")


def hash_cache_upsert(cache: DataFrame, updates: DataFrame) -> DataFrame:
    """Inserts or replaces hashes by (path in any case, size, mtime); the update wins.

    One aggregation instead of a join: its partial step already drops replaced rows. An existing
    key keeps its path spelling.
    """
    columns = ["local_path", "size", "mtime_utc", "md5", "sha256"]
    both = (cache.select(*columns, F.lit(0).alias("rank"))
            .unionByName(updates.select(*columns, F.lit(1).alias("rank"))))
    return (keyed(both, "local_path").groupBy("path_key", "size", "mtime_utc")
            .agg(F.min_by("local_path", "rank").alias("local_path"),
                 F.max_by(F.struct("md5", "sha256"), "rank").alias("hashes"))
            .select("local_path", "size", "mtime_utc", "hashes.md5", "hashes.sha256"))


def ledger_fold(history: DataFrame) -> DataFrame:
    """State history (local_path, seq, state, last_error) to the current row per path."""
    return (keyed(history, "local_path").groupBy("path_key")
            .agg(F.max_by(F.struct("local_path", "state", "last_error"), "seq").alias("last"),
                 F.count_if(F.col("state") == S.UPLOADING).alias("attempts"),
                 F.max("seq").alias("seq"))
            .select("last.local_path", "last.state", "last.last_error", "attempts", "seq"))


def rows_by_state(ledger: DataFrame, states: list[int] | tuple[int, ...],
                  limit: int) -> DataFrame:
    """Rows in the given states, newest inserted first; no states give no rows."""
    rows = ledger.where(F.col("state").isin(*states) if states else F.lit(False))
    return rows.orderBy(F.desc("first_seen_seq")).limit(limit)


def count_by_state(ledger: DataFrame) -> DataFrame:
    return (ledger.groupBy("state").agg(F.count(F.lit(1)).alias("rows"))
            .orderBy(F.desc("rows"), "state"))
