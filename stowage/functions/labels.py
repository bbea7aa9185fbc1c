"""Display text as native Column expressions.

Decimals are rounded half away from zero in whole-number arithmetic, so no formatter's own
rounding shows through.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stowage.functions.paths import file_name
from stowage.schema import Band, Readiness, TransferState as S, VerifyMethod as V

# Display words.
GRID_STATE = {
    S.DISCOVERED: "Waiting", S.QUEUED: "Queued", S.UPLOADING: "Uploading",
    S.UPLOADED: "Verifying", S.VERIFIED: "Verified", S.SKIPPED: "Already there",
    S.CONFLICT: "Needs a decision", S.LOCKED_RETRYING: "File in use",
    S.SUPERSEDED: "Changed", S.FAILED: "Failed",
}
AUDIT_STATE = {
    S.DISCOVERED: "Discovered", S.QUEUED: "Queued", S.UPLOADING: "Uploading",
    S.UPLOADED: "Uploaded", S.VERIFIED: "Verified", S.SKIPPED: "Already there",
    S.CONFLICT: "Needs a decision", S.LOCKED_RETRYING: "File in use",
    S.SUPERSEDED: "Changed", S.FAILED: "Failed",
}
STATE_NAME = {
    S.DISCOVERED: "Discovered", S.QUEUED: "Queued", S.UPLOADING: "Uploading",
    S.UPLOADED: "Uploaded", S.VERIFIED: "Verified", S.SKIPPED: "Skipped",
    S.CONFLICT: "Conflict", S.LOCKED_RETRYING: "LockedRetrying",
    S.SUPERSEDED: "Superseded", S.FAILED: "Failed",
}
AUDIT_VERIFICATION = {V.NONE: "Not verified", V.SIZE_ONLY: "Size only", V.SERVER_MD5: "Server MD5"}
PROGRESS_VERIFICATION = {
    V.NONE: "Uploaded - not verified", V.SIZE_ONLY: "Uploaded - size only",
    V.SERVER_MD5: "Verified (server MD5)",
}
_UNITS = ("B", "KB", "MB", "GB", "TB")


def lookup(code: Column, words: dict[int, str], default: str | None = None) -> Column:
    chain = None
    for key, word in words.items():
        chain = (F.when(code == key, word) if chain is None else chain.when(code == key, word))
    return chain.otherwise(F.lit(default))


def state_label(state: Column, audit: bool = True) -> Column:
    return lookup(state, AUDIT_STATE if audit else GRID_STATE)


def state_name(state: Column) -> Column:
    return lookup(state, STATE_NAME)


def verification_label(method: Column, audit: bool = True) -> Column:
    words = AUDIT_VERIFICATION if audit else PROGRESS_VERIFICATION
    return lookup(method, words, words[V.NONE])


def band_for(state: Column) -> Column:
    return (F.when(state.isin(S.QUEUED, S.UPLOADING, S.UPLOADED), Band.ACTIVE)
            .when(state.isin(S.FAILED, S.CONFLICT, S.SUPERSEDED), Band.NEEDS_ATTENTION)
            .when(state.isin(S.VERIFIED, S.SKIPPED), Band.FINISHED)
            .otherwise(Band.WAITING))


def _tenths(value: Column) -> Column:
    return F.concat(F.floor(value / 10).cast("string"), F.lit("."),
                    F.pmod(value, F.lit(10)).cast("string"))


def format_bytes(count: Column) -> Column:
    """Whole bytes in steps of 1024 up to TB, one decimal from KB on."""
    count = count.cast("bigint")
    chain = F.when(count < 1024, F.concat(count.cast("string"), F.lit(" B")))
    for power, unit in enumerate(_UNITS[1:], start=1):
        size = 1024 ** power
        rounded = F.call_function("div", count * 20 + size, F.lit(2 * size))
        text = F.concat(_tenths(rounded), F.lit(f" {unit}"))
        chain = chain.when(count < size * 1024, text) if power < 4 else chain.otherwise(text)
    return chain


def _scaled(value: Column, units: tuple[str, ...], decimals_for_bytes: bool) -> Column:
    whole = F.concat(F.floor(value + 0.5).cast("string"), F.lit(" B"))
    first = F.concat(_tenths(F.floor(value * 10 + 0.5)), F.lit(" B")) if decimals_for_bytes else whole
    chain = F.when(value < 1024, first)
    for power, unit in enumerate(units[1:], start=1):
        size = float(1024 ** power)
        text = F.concat(_tenths(F.floor(value / size * 10 + 0.5)), F.lit(f" {unit}"))
        last = power == len(units) - 1
        chain = chain.otherwise(text) if last else chain.when(value < size * 1024, text)
    return chain


def format_amount(value: Column) -> Column:
    """A byte figure held as a double: no decimals for B, one from KB on."""
    return _scaled(value.cast("double"), _UNITS, decimals_for_bytes=False)


def format_rate(rate: Column) -> Column:
    """One decimal always, up to GB."""
    return F.concat(_scaled(rate.cast("double"), _UNITS[:4], decimals_for_bytes=True), F.lit("/s"))


def format_eta(seconds: Column, grid: bool = True) -> Column:
    """``1h 5m``, ``3m 20s`` or ``9s``; the status form leaves the seconds out of the second."""
    whole = F.floor(seconds)
    hours, minutes = F.floor(seconds / 3600), F.floor(seconds / 60)
    in_minutes = F.concat(minutes.cast("string"), F.lit("m"))
    if grid:
        in_minutes = F.concat(in_minutes, F.lit(" "),
                              F.pmod(whole, F.lit(60)).cast("string"), F.lit("s"))
    return (F.when(seconds >= 3600, F.concat(
                hours.cast("string"), F.lit("h "), F.pmod(minutes, F.lit(60)).cast("string"),
                F.lit("m")))
            .when(seconds >= 60, in_minutes)
            .when(seconds.isNotNull(),
                  F.concat(F.greatest(whole, F.lit(1)).cast("string"), F.lit("s"))))


def progress_fraction(sent: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.greatest(sent.cast("double") / total, F.lit(0.0)), F.lit(1.0)))


def progress_eta(sent: Column, total: Column, rate: Column) -> Column:
    """Seconds left, or NULL when there is nothing to base them on."""
    return F.when((rate > 0) & (total > sent), (total - sent) / rate)


def describe_progress(state: Column, phase: Column, sent: Column, total: Column,
                      rate: Column, message: Column) -> Column:
    percent = F.floor(progress_fraction(sent, total) * 100 + 0.5).cast("string")
    speed = F.when(rate > 0, F.concat(F.lit(" - "), format_amount(rate), F.lit("/s"))).otherwise("")
    eta = format_eta(progress_eta(sent, total, rate), grid=False)
    left = F.when(eta.isNotNull(), F.concat(F.lit(" - "), eta, F.lit(" left"))).otherwise("")
    moving = F.concat(phase, F.lit(" "), percent, F.lit("% of "), format_amount(total), speed, left)
    return (F.when((state == S.UPLOADING) & (total > 0), moving)
            .when(F.length(F.coalesce(message, F.lit(""))) > 0,
                  F.concat(phase, F.lit(" - "), message))
            .otherwise(phase))


def readiness_detail(reason: Column, path: Column, length: Column, previous_length: Column,
                     quiet_ms: Column, required_ms: Column, error: Column) -> Column:
    """One sentence per readiness reason."""
    # The sentences are shown to the user.
    name = F.concat(F.lit("'"), file_name(path), F.lit("'"))

    def seconds(ms: Column) -> Column:
        return F.concat(F.floor(ms / 1000.0 + 0.5).cast("string"), F.lit("s"))

    return (
        F.when(reason == Readiness.READY, F.lit("Ready to upload."))
        .when(reason == Readiness.MISSING, F.concat(name, F.lit(" is no longer there.")))
        .when(reason == Readiness.LOCKED, F.concat(
            name, F.lit(" is open in another program. This is normal while an instrument is "
                        "acquiring or a copy is still running.")))
        .when(reason == Readiness.GROWING, F.concat(
            F.lit("Still being written ("), F.format_number(previous_length, 0), F.lit(" to "),
            F.format_number(length, 0), F.lit(" bytes since the last check).")))
        .when(reason == Readiness.SETTLING, F.concat(
            F.lit("Unchanged for "), seconds(quiet_ms), F.lit("; waiting for "),
            seconds(required_ms), F.lit(".")))
        .when(reason == Readiness.UNREADABLE, F.concat(
            F.lit("Cannot read "), name, F.lit(": "), F.coalesce(error, F.lit("")))))


def still_in_use_detail(path: Column, checks: Column) -> Column:
    # The sentences are shown to the user.
    return F.concat(
        F.lit("'"), file_name(path),
        F.lit("' has been open in another program for all of the last "), checks.cast("string"),
        F.lit(" checks. It will be picked up at the next folder check, or as soon as it changes."))


def waiting_state(reason: Column) -> Column:
    """The transfer state a waiting file is shown in."""
    return (F.when(reason == Readiness.LOCKED, S.LOCKED_RETRYING)
            .when(reason == Readiness.UNREADABLE, S.FAILED)
            .otherwise(S.DISCOVERED))
