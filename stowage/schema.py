"""Table schemas, enumerations and defaults shared by every job."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


INVENTORY = _struct(
    ("path", T.StringType()), ("length", T.LongType()), ("mtime_ms", T.LongType()))

# The directory walk yields inventory rows and fault rows in one scan.
INVENTORY_SCAN = _struct(
    ("path", T.StringType()), ("length", T.LongType()), ("mtime_ms", T.LongType()),
    ("problem", T.StringType()))

# ``first_seen_seq`` orders rows by first insertion; an upsert never changes it.
LEDGER = _struct(
    ("local_path", T.StringType()), ("remote_path", T.StringType()),
    ("size", T.LongType()), ("mtime_utc", T.LongType()),
    ("md5", T.StringType()), ("sha256", T.StringType()),
    ("state", T.IntegerType()), ("verify_method", T.IntegerType()),
    ("verified_utc", T.TimestampType()), ("attempts", T.IntegerType()),
    ("last_error", T.StringType()), ("is_dataset", T.BooleanType()),
    ("first_seen_seq", T.LongType()))

HASH_CACHE = _struct(
    ("local_path", T.StringType()), ("size", T.LongType()), ("mtime_utc", T.LongType()),
    ("md5", T.StringType()), ("sha256", T.StringType()))

PERMISSIONS = _struct(
    ("can_read", T.BooleanType()), ("can_upload", T.BooleanType()),
    ("can_edit", T.BooleanType()), ("can_delete", T.BooleanType()),
    ("can_rename", T.BooleanType()), ("allowed_methods", T.ArrayType(T.StringType())))

REMOTE_ENTRIES = _struct(
    ("folder", T.StringType()), ("name", T.StringType()), ("path", T.StringType()),
    ("is_collection", T.BooleanType()), ("length", T.LongType()),
    ("last_modified", T.TimestampType()), ("etag", T.StringType()),
    ("content_type", T.StringType()), ("created_by", T.StringType()),
    ("permissions", PERMISSIONS))

REMOTE_HASHES = _struct(
    ("folder", T.StringType()), ("name", T.StringType()), ("md5", T.StringType()))

PROGRESS = _struct(
    ("local_path", T.StringType()), ("remote_path", T.StringType()),
    ("state", T.IntegerType()), ("phase", T.StringType()),
    ("bytes", T.LongType()), ("total", T.LongType()), ("rate", T.DoubleType()),
    ("verification", T.IntegerType()), ("message", T.StringType()),
    ("seq", T.LongType()), ("ts_ms", T.LongType()))

OBSERVATIONS = _struct(
    ("path", T.StringType()), ("length", T.LongType()), ("probe", T.IntegerType()),
    ("observed_ms", T.LongType()), ("seq", T.LongType()))

NOTICES = _struct(
    ("path", T.StringType()), ("kind", T.StringType()), ("is_dir", T.BooleanType()),
    ("ts_ms", T.LongType()), ("seq", T.LongType()))

OUTCOMES = _struct(
    ("path", T.StringType()), ("destination", T.StringType()), ("bytes", T.LongType()),
    ("md5", T.StringType()), ("sha256", T.StringType()),
    ("elapsed_ms", T.LongType()), ("error", T.StringType()),
    # The source as it was when its copy was whole.
    ("length_after", T.LongType()), ("mtime_after", T.LongType()))


# Numeric codes as stored in the ledger and on the wire.
class TransferState:
    DISCOVERED, QUEUED, UPLOADING, UPLOADED, VERIFIED = 0, 1, 2, 3, 4
    SKIPPED, CONFLICT, LOCKED_RETRYING, SUPERSEDED, FAILED = 5, 6, 7, 8, 9


class VerifyMethod:
    NONE, SIZE_ONLY, SERVER_MD5 = 0, 1, 2


class Readiness:
    READY, MISSING, LOCKED, GROWING, SETTLING, UNREADABLE = 0, 1, 2, 3, 4, 5


class ConflictPolicy:
    ASK, SKIP, OVERWRITE, RENAME = 0, 1, 2, 3


class DecisionTier:
    LEDGER, REMOTE_SNAPSHOT, LOCAL_HASH = 0, 1, 2


class Band:
    ACTIVE, NEEDS_ATTENTION, FINISHED, WAITING = 0, 1, 2, 3


SETTLED_STATES = (TransferState.VERIFIED, TransferState.SKIPPED)
ATTENTION_STATES = (TransferState.FAILED, TransferState.CONFLICT, TransferState.SUPERSEDED)
INTERRUPTED_STATES = (TransferState.UPLOADING, TransferState.UPLOADED, TransferState.QUEUED)

# Defaults of the product being reproduced.
MAX_UPLOAD_ATTEMPTS = 5
MAX_LOCKED_CHECKS = 20
QUIET_PERIOD_MS = 10_000
SUPPRESSION_WINDOW_MS = 1_000
PROGRESS_INTERVAL_MS = 250
STALL_TIMEOUT_MS = 120_000
SNAPSHOT_LIFETIME_MS = 300_000
SWEEP_INTERVAL_MINUTES = 15
MAX_SEGMENT_LENGTH = 255
GRID_LIMIT = 5000
LOG_TAIL_LIMIT = 2000
ATTENTION_LIMIT = 20
