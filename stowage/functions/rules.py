"""Yes-or-no rules over files, ledger rows and remote entries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stowage.functions.paths import extension, file_name
from stowage.schema import (
    ATTENTION_STATES, MAX_UPLOAD_ATTEMPTS, SETTLED_STATES, TransferState as S, VerifyMethod as V)

# Fixed values.
TRANSIENT_STATUSES = (408, 429, 500, 502, 503, 504)
SENSITIVE_NAMES = "password|passwd|apikey|api_key|secret|token|authorization|credential"
REDACTED = "[redacted]"
SIDECAR_EXTENSION = ".md5"


def candidate_filter(path: Column, extensions: list[str] | tuple[str, ...] = ()) -> Column:
    """A file worth transferring: not a working file, and of a wanted extension if any is given."""
    name = file_name(path)
    accepted = (name != "") & ~name.startswith(".") & ~name.startswith("~")
    wanted = sorted({e.lower() for e in extensions})
    return accepted & extension(name).isin(wanted) if wanted else accepted


def stamp_matches(size: Column, mtime_utc: Column, length: Column, mtime_ms: Column) -> Column:
    return (size == length) & (mtime_utc == mtime_ms)


def is_settled(state: Column, verify_method: Column, size: Column, mtime_utc: Column,
               length: Column, mtime_ms: Column) -> Column:
    return F.coalesce(
        state.isin(*SETTLED_STATES) & (verify_method == V.SERVER_MD5)
        & stamp_matches(size, mtime_utc, length, mtime_ms), F.lit(False))


def is_settled_at(state: Column, verify_method: Column, size: Column, mtime_utc: Column,
                  remote_path: Column, length: Column, mtime_ms: Column,
                  destination: Column) -> Column:
    return F.coalesce(
        is_settled(state, verify_method, size, mtime_utc, length, mtime_ms)
        & (remote_path == destination), F.lit(False))


def is_accounted_for(known: Column, state: Column, verify_method: Column, size: Column,
                     mtime_utc: Column, remote_path: Column, attempts: Column, length: Column,
                     mtime_ms: Column, destination: Column,
                     max_attempts: int = MAX_UPLOAD_ATTEMPTS) -> Column:
    """Whether the ledger alone answers for a file; anything unclear is offered again."""
    return (
        F.when(~known | destination.isNull(), False)
        .when(is_settled_at(state, verify_method, size, mtime_utc, remote_path, length, mtime_ms,
                            destination), True)
        .when(~stamp_matches(size, mtime_utc, length, mtime_ms), False)
        .when(state == S.CONFLICT, True)
        .when(state == S.FAILED, attempts >= max_attempts)
        .otherwise(False))


def trustworthy(verify_method: Column) -> Column:
    return verify_method == V.SERVER_MD5


def needs_attention(state: Column) -> Column:
    return state.isin(*ATTENTION_STATES)


def implied_verification(action: Column, remote_hash: Column) -> Column:
    """A skip backed by the server's own hash is as strong as a verified upload."""
    return F.when((action == "Skip") & remote_hash.isNotNull(), V.SERVER_MD5).otherwise(V.NONE)


def allows_method(methods: Column, verb: str) -> Column:
    return F.exists(methods, lambda m: F.upper(m) == verb.upper())


def atomic_publish(permissions: Column) -> Column:
    return permissions["can_upload"] & allows_method(permissions["allowed_methods"], "MOVE")


def is_sidecar(name: Column) -> Column:
    return F.lower(name).endswith(SIDECAR_EXTENSION)


def is_transient(status: Column) -> Column:
    return status.isin(*TRANSIENT_STATUSES)


def failure_message(status: Column, method: Column, name: Column, phrase: Column) -> Column:
    """The sentence shown for a failed request."""
    # The sentences are shown to the user.
    quoted = F.concat(F.lit("'"), name, F.lit("'"))
    code = status.cast("string")
    return (
        F.when(status == 401, F.lit(
            "The server rejected the credentials. Check the API key or password on the Remote "
            "Settings tab."))
        .when(status == 403, F.concat(
            F.lit("No permission to "), F.lower(method), F.lit(" "), quoted,
            F.lit(". A server administrator needs to grant write access to this folder.")))
        .when(status == 404, F.concat(quoted, F.lit(" was not found on the server.")))
        .when(status == 409, F.concat(
            F.lit("The parent folder of "), quoted, F.lit(" does not exist on the server.")))
        .when(status == 413, F.concat(
            F.lit("The server refused "), quoted, F.lit(" as too large.")))
        .when(status == 507, F.lit("The server is out of storage space."))
        .when(is_transient(status), F.concat(
            F.lit("The server is temporarily unavailable ("), code,
            F.lit("). This will be retried.")))
        .otherwise(F.concat(
            F.lit("The server returned "), code, F.lit(" "), F.coalesce(phrase, F.lit("")),
            F.lit(" for "), method, F.lit(" "), quoted, F.lit("."))))


def redact_props(props: Column) -> Column:
    """Hides the value of every property whose name looks like a credential."""
    return F.transform_values(
        props, lambda k, v: F.when(k.rlike(f"(?i){SENSITIVE_NAMES}"), F.lit(REDACTED)).otherwise(v))


def split_methods(options: Column) -> Column:
    """The verbs of a comma list, upper-cased."""
    verbs = F.transform(F.split(F.coalesce(options, F.lit("")), ","), lambda v: F.upper(F.trim(v)))
    return F.filter(verbs, lambda v: v != "")


_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?"
_OFFSET = r"(?:Z|[+-]\d{2}:?\d{2})$"
_RFC_1123 = r"^[A-Z][a-z]{2}, (\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}) GMT$"


def parse_server_time(text: Column) -> Column:
    """ISO 8601 or an RFC 1123 date, in UTC where it names no offset; NULL for anything else.

    Nothing depends on the session's zone or on today's date: a time of day alone is no time.
    """
    full = F.regexp_replace(text, r"^(.{16})(?!:)", "$1:00")
    iso = F.when(text.rlike(_ISO + _OFFSET), full).when(text.rlike(_ISO + "$"), F.concat(full, F.lit("Z")))
    day = F.concat(F.regexp_extract(text, _RFC_1123, 1), F.lit(" +00:00"))
    return F.coalesce(F.try_to_timestamp(iso), F.when(
        text.rlike(_RFC_1123), F.try_to_timestamp(day, F.lit("dd MMM yyyy HH:mm:ss XXX"))))
