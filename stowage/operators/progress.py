"""Transfer progress: the newest report per file, totals and the grid.

``seq`` orders the reports; arrival order never counts, so a late report cannot reopen a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stowage.functions.labels import (
    band_for, describe_progress, format_amount, format_eta, format_rate, progress_eta,
    progress_fraction, state_label, verification_label, waiting_state)
from stowage.functions.paths import file_name, path_key
from stowage.operators.longkeys import mark_runs, seq_chunk
from stowage.operators.sweep import keyed
from stowage.schema import (
    ATTENTION_STATES, GRID_LIMIT, Readiness as R, SETTLED_STATES, STALL_TIMEOUT_MS,
    TransferState as S, VerifyMethod)


def latest_progress(progress: DataFrame) -> DataFrame:
    """One row per path. The partial aggregate keeps one row per path and task, so a path with
    very many reports costs no more to shuffle than any other."""
    return (progress.groupBy(path_key(F.col("local_path")).alias("path_key"))
            .agg(F.max_by(F.struct(*progress.columns), "seq").alias("r")).select("r.*"))


def drain_changed(progress: DataFrame, last_drain: int) -> DataFrame:
    """The newest report of every path that changed since the last drain."""
    return latest_progress(progress.where(F.col("seq") > last_drain))


def clear_finished(latest: DataFrame) -> DataFrame:
    """Forgets what finished cleanly."""
    return latest.where(~F.col("state").isin(*SETTLED_STATES))


def transfer_totals(latest: DataFrame) -> DataFrame:
    state = F.col("state")
    active = state == S.UPLOADING
    queued = state.isin(S.DISCOVERED, S.QUEUED, S.LOCKED_RETRYING)

    def total(when: Column, column: str, zero: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(column))), zero)

    sums = latest.agg(
        F.count_if(active).alias("active"), F.count_if(queued).alias("queued"),
        F.count_if(state.isin(S.VERIFIED, S.SKIPPED, S.UPLOADED)).alias("finished"),
        F.count_if(state.isin(*ATTENTION_STATES)).alias("needs_attention"),
        total(active, "bytes", F.lit(0)).alias("bytes_sent"),
        total(active | queued, "total", F.lit(0)).alias("bytes_total"),
        F.round(total(active, "rate", F.lit(0.0)), 6).alias("rate"))
    sent, whole, rate = F.col("bytes_sent"), F.col("bytes_total"), F.col("rate")
    return (sums.withColumn("fraction", F.round(progress_fraction(sent, whole), 6))
            .withColumn("eta_seconds", F.round(progress_eta(sent, whole, rate), 6)))


def describe_totals(totals: DataFrame) -> DataFrame:
    """Adds the status bar text."""
    eta = format_eta(F.col("eta_seconds"), grid=False)
    busy = F.concat_ws(
        " - ",
        F.concat(F.col("active").cast("string"), F.lit(" active")),
        F.when(F.col("queued") > 0, F.concat(F.col("queued").cast("string"), F.lit(" queued"))),
        F.when(F.col("rate") > 0, F.concat(format_amount(F.col("rate")), F.lit("/s"))),
        F.when(eta.isNotNull(), F.concat(eta, F.lit(" left"))))
    idle = F.when(F.col("needs_attention") > 0, F.concat(
        F.lit("Idle - "), F.col("needs_attention").cast("string"), F.lit(" need attention"))
    ).otherwise("Idle")
    return totals.withColumn("summary", F.when(
        (F.col("active") == 0) & (F.col("queued") == 0), idle).otherwise(busy))


def run_summary(outcomes: DataFrame, elapsed_seconds: float,
                accounted: Column | int = 0) -> DataFrame:
    """Totals of a run over final rows (state, bytes sent).

    A manual scan passes what its sweep found settled, which counts as skipped.
    """
    state = F.col("state")
    sums = outcomes.agg(
        F.count_if(state.isin(S.UPLOADED, S.VERIFIED)).alias("uploaded"),
        F.count_if(state == S.SKIPPED).alias("skipped"),
        F.count_if(state == S.CONFLICT).alias("conflicts"),
        F.count_if(state == S.FAILED).alias("failed"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_sent"))
    extra = F.lit(accounted) if isinstance(accounted, int) else accounted
    done = sums.withColumn("skipped", F.col("skipped") + extra)
    total = F.col("uploaded") + F.col("skipped") + F.col("conflicts") + F.col("failed")
    rate = (F.round(F.col("bytes_sent") / F.lit(float(elapsed_seconds)), 6)
            if elapsed_seconds > 0 else F.lit(0.0))
    whole_seconds = int(elapsed_seconds + 0.5)
    # The sentences are shown to the user.
    text = F.concat_ws(", ", *[
        F.when(F.col(name) > 0, F.concat(F.col(name).cast("string"), F.lit(f" {words}")))
        for name, words in (("uploaded", "uploaded"), ("skipped", "already there"),
                            ("conflicts", "need a decision"), ("failed", "failed"))])
    return (done.withColumn("total", total).withColumn("rate", rate)
            .withColumn("summary", F.when(F.col("total") == 0, "Nothing needed transferring.")
                        .otherwise(F.concat(text, F.lit(f" in {whole_seconds}s.")))))


def phase_counts(progress: DataFrame) -> DataFrame:
    """Reports per phase, without those of moving bytes."""
    return (progress.where(F.col("state") != S.UPLOADING)
            .groupBy("phase").agg(F.count(F.lit(1)).alias("reports")))


def gate_progress(reports: DataFrame) -> DataFrame:
    """Gate reports (path, reason, length, detail, seq, ts_ms) as progress rows; files that are
    simply gone are left out."""
    state = waiting_state(F.col("reason"))
    nothing = F.lit(0)
    return reports.where(F.col("reason") != R.MISSING).select(
        F.col("path").alias("local_path"), F.lit("").alias("remote_path"),
        state.alias("state"),
        F.when(state == S.FAILED, "Cannot read").otherwise("Waiting").alias("phase"),
        nothing.cast("bigint").alias("bytes"), F.col("length").alias("total"),
        nothing.cast("double").alias("rate"), F.lit(VerifyMethod.NONE).alias("verification"),
        F.col("detail").alias("message"), "seq", "ts_ms")


def transfer_report(latest: DataFrame) -> DataFrame:
    """The grid's columns for the newest report of each file."""
    state, sent, total, rate = (F.col(c) for c in ("state", "bytes", "total", "rate"))
    uploading = state == S.UPLOADING
    fraction = progress_fraction(sent, total)
    finished = state.isin(S.VERIFIED, S.SKIPPED, S.UPLOADED)
    blank = F.lit("")
    return latest.select(
        "local_path", file_name(F.col("local_path")).alias("file_name"),
        band_for(state).alias("band"),
        F.when(F.trim(F.coalesce("phase", blank)) == "", state_label(state, audit=False))
        .otherwise(F.col("phase")).alias("status"),
        F.coalesce("message", blank).alias("detail"),
        (uploading & fraction.isNotNull()).alias("has_progress"),
        F.round(F.coalesce(fraction, finished.cast("double")) * 100, 6).alias("percent"),
        F.when(uploading & (rate > 0), format_rate(rate)).otherwise(blank).alias("speed"),
        F.coalesce(F.when(uploading, format_eta(progress_eta(sent, total, rate))), blank)
        .alias("eta"),
        F.when(finished, verification_label(F.col("verification"), audit=False))
        .otherwise(blank).alias("verification"),
        state.isin(*ATTENTION_STATES).alias("needs_attention"),
        describe_progress(state, F.col("phase"), sent, total, rate, F.col("message"))
        .alias("description"))


def grid_rows(progress: DataFrame) -> DataFrame:
    """Per path its newest report's state, band and the seq at which it entered that band."""
    runs = mark_runs(keyed(progress, "local_path").select("path_key", "local_path", "state", "seq"),
                     "path_key", ["seq"], seq_chunk("seq"), band_for(F.col("state")), F.col("seq"))
    newest = runs.groupBy("path_key").agg(
        F.max_by(F.struct("local_path", "state", F.col("run_start").alias("entered_seq")), "seq")
        .alias("r"))
    return newest.select("r.*").withColumn("band", band_for(F.col("state")))


def grid_order(progress: DataFrame) -> DataFrame:
    """Bands in order, the newest arrival of a band first."""
    return grid_rows(progress).orderBy("band", F.desc("entered_seq"))


def trim_finished(grid: DataFrame, limit: int = GRID_LIMIT) -> DataFrame:
    """Drops the oldest finished rows of a grid that is over its cap; nothing else is dropped.

    At most ``limit`` finished rows can stay, so only that many are ever ranked.
    """
    finished = F.col("state").isin(*SETTLED_STATES)
    others = grid.where(~finished)
    free = F.lit(limit) - others.agg(F.count(F.lit(1))).scalar()
    newest = grid.where(finished).orderBy(F.desc("entered_seq")).limit(limit)
    # A window over at most ``limit`` rows.
    ranked = newest.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("entered_seq"))))
    return others.unionByName(ranked.where(F.col("_rank") <= free).drop("_rank"))


def stalled(progress: DataFrame, now_ms: int, timeout_ms: int = STALL_TIMEOUT_MS) -> DataFrame:
    """Files still uploading whose byte count has not moved for longer than the timeout."""
    runs = mark_runs(keyed(progress, "local_path").select(
        "path_key", "local_path", "state", "bytes", "seq", "ts_ms"),
        "path_key", ["seq"], seq_chunk("seq"), F.struct("state", "bytes"), F.col("ts_ms"))
    newest = runs.groupBy("path_key").agg(
        F.max_by(F.struct("local_path", "state", F.col("run_start").alias("last_change_ms")), "seq")
        .alias("r"))
    return (newest.select("r.*").where(F.col("state") == S.UPLOADING)
            .withColumn("idle_ms", F.lit(now_ms) - F.col("last_change_ms"))
            .where(F.col("idle_ms") > timeout_ms).drop("state"))
