"""Audit questions on the ledger, and log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stowage.functions.labels import format_bytes, state_label, verification_label
from stowage.functions.paths import file_name
from stowage.functions.rules import (
    failure_message, is_transient, needs_attention, redact_props, trustworthy)
from stowage.operators.ledger import rows_by_state
from stowage.schema import (
    ATTENTION_LIMIT, ATTENTION_STATES, LOG_TAIL_LIMIT, SETTLED_STATES,
    TransferState as S)

ALL, VERIFIED, NEEDS_ATTENTION = "All", "Verified", "NeedsAttention"
_FILTERS = {ALL: tuple(range(10)), VERIFIED: SETTLED_STATES, NEEDS_ATTENTION: ATTENTION_STATES}


def audit_view(ledger: DataFrame, filter: str = ALL, search: str = "",
               limit: int | None = None) -> DataFrame:
    """Rows of a filter whose file name holds the search text; all of them, or the newest ``limit``."""
    rows = ledger.where(F.col("state").isin(*_FILTERS[filter]))
    needle = search.strip().lower()
    if needle:
        rows = rows.where(F.lower(file_name(F.col("local_path"))).contains(needle))
    return rows if limit is None else rows.orderBy(F.desc("first_seen_seq")).limit(limit)


def attention_top(ledger: DataFrame, limit: int = ATTENTION_LIMIT) -> DataFrame:
    """The newest rows that need a person, with their error."""
    return rows_by_state(ledger, ATTENTION_STATES, limit).select(
        "first_seen_seq", "local_path", "state",
        file_name(F.col("local_path")).alias("file_name"), "last_error")


def audit_summary(ledger: DataFrame, view: DataFrame | None = None) -> DataFrame:
    """Counts for the line above the audit table; ``view`` holds the rows that are shown."""
    state = F.col("state")
    sums = ledger.agg(
        F.count_if(state.isin(*SETTLED_STATES)).alias("on_server"),
        F.count_if(state == S.VERIFIED).alias("hash_verified"),
        F.count_if(state.isin(*ATTENTION_STATES)).alias("attention"),
        F.count(F.lit(1)).alias("rows"))
    visible = F.col("rows") if view is None else view.select(F.count(F.lit(1))).scalar()

    def n(name: str):
        return F.format_number(F.col(name), 0)

    text = F.concat(
        n("on_server"), F.lit(" on the server"),
        F.when(F.col("hash_verified") > 0,
               F.concat(F.lit(" ("), n("hash_verified"), F.lit(" hash-verified)"))).otherwise(""),
        F.when(F.col("attention") > 0,
               F.concat(F.lit(", "), n("attention"), F.lit(" need attention"))).otherwise(""),
        F.lit(" - showing "), n("shown"))
    return (sums.withColumn("shown", visible.cast("bigint"))
            .withColumn("summary", F.when(F.col("rows") == 0, "Nothing recorded yet.")
                        .otherwise(text)))


def audit_report(rows: DataFrame) -> DataFrame:
    """The display columns of ledger rows."""
    return rows.select(
        "first_seen_seq", file_name(F.col("local_path")).alias("file_name"),
        "local_path", "remote_path",
        state_label(F.col("state")).alias("state"),
        verification_label(F.col("verify_method")).alias("verification"),
        trustworthy(F.col("verify_method")).alias("trustworthy"),
        needs_attention(F.col("state")).alias("needs_attention"),
        format_bytes(F.col("size")).alias("size"),
        F.coalesce(F.date_format("verified_utc", "yyyy-MM-dd HH:mm"), F.lit("")).alias("verified_at"),
        F.coalesce("last_error", F.lit("")).alias("detail"))


def audit_csv_columns(rows: DataFrame) -> DataFrame:
    """The exported columns of a filtered view, under their printed names."""
    return rows.select(
        F.col("local_path").alias("Local path"), F.col("remote_path").alias("Remote path"),
        state_label(F.col("state")).alias("State"),
        verification_label(F.col("verify_method")).alias("Verification"),
        F.col("size").alias("Size (bytes)"), F.col("md5").alias("MD5"),
        F.date_format("verified_utc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSS'+00:00'")
        .alias("Verified (UTC)"),
        F.col("last_error").alias("Detail"))


def classify_failure(failures: DataFrame) -> DataFrame:
    """Adds whether a failed request (status, method, name, phrase) is worth repeating, and the
    sentence to show for it."""
    return failures.withColumn("transient", is_transient(F.col("status"))).withColumn(
        "message", failure_message(F.col("status"), F.col("method"), F.col("name"),
                                   F.col("phrase")))


def redacted_logs(lines: DataFrame) -> DataFrame:
    return lines.withColumn("props", redact_props(F.col("props")))


def log_tail(lines: DataFrame, limit: int = LOG_TAIL_LIMIT) -> DataFrame:
    """The last lines, oldest first; ``seq`` breaks ties of one instant."""
    return (lines.orderBy(F.desc("ts"), F.desc("seq")).limit(limit).orderBy("ts", "seq"))
