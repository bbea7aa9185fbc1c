"""Copying files as a distributed job, hashed in the same pass."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F

from stowage.schema import OUTCOMES
from stowage.sources.hashing import dealt_out, hash_stream, open_location
from stowage.sources.inventory import stamp

_ARROW = pa.schema([("path", pa.string()), ("destination", pa.string()), ("bytes", pa.int64()),
                    ("md5", pa.string()), ("sha256", pa.string()), ("elapsed_ms", pa.int64()),
                    ("error", pa.string()), ("length_after", pa.int64()), ("mtime_after", pa.int64())])


def _copy(source: str, target: str, mtime_ms: int | None, sha256: bool) -> tuple:
    from_fs, from_path = open_location(source)
    to_fs, to_path = open_location(target)
    to_fs.create_dir(os.path.dirname(to_path), recursive=True)
    # A second attempt of the same task must never meet half a file, so the copy is moved into
    # place only when it is whole.
    part = f"{to_path}.{uuid.uuid4().hex}.part"
    try:
        with from_fs.open_input_stream(from_path) as reader, to_fs.open_output_stream(part) as writer:
            count, md5, sha = hash_stream(reader, writer, sha256)
        if mtime_ms is not None and isinstance(to_fs, pafs.LocalFileSystem):
            os.utime(part, ns=(mtime_ms * 1_000_000, mtime_ms * 1_000_000))
        to_fs.move(part, to_path)
    except BaseException:
        try:
            to_fs.delete_file(part)
        except OSError:
            pass
        raise
    after = stamp(source)
    return count, md5, sha, *(after or (None, None))


def _copied(batches: Iterator[pa.RecordBatch], root: str, sha256: bool) -> Iterator[pa.RecordBatch]:
    """The outcomes of a batch of copies, as one batch: one for each file would cost more than a small file's copy."""
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            begun = time.monotonic()
            target = f"{root}/{row['target'].lstrip('/')}"
            count, md5, sha, length, mtime, problem = 0, None, None, None, None, None
            try:
                count, md5, sha, length, mtime = _copy(row["path"], target, row["mtime_ms"], sha256)
            except Exception as error:  # One bad file must not stop the rest.
                problem = str(error)
            spent = int((time.monotonic() - begun) * 1000)
            done.append(dict(
                path=row["path"], destination=target, bytes=count, md5=md5, sha256=sha,
                elapsed_ms=spent, error=problem, length_after=length, mtime_after=mtime))
        yield pa.RecordBatch.from_pylist(done, schema=_ARROW)


def mirror_copy(worklist: DataFrame, dest_root: str, sha256: bool = False,
                parallelism: int | None = None) -> DataFrame:
    """Copies (path, target, mtime_ms, and length where it is known) below ``dest_root``; one outcome per file.

    Failures become rows. The stamp of the source goes onto the copy, and the copying task looks at the source
    once more when it is done. Slots of the cluster bound how many copies run at once; ``parallelism`` sets the
    number of tasks the list is dealt into, by bytes. The result must be written once and read from
    there: evaluating it again copies again.
    """
    size = F.col("length") if "length" in worklist.columns else F.lit(0)
    listed = worklist.select("path", "target", F.col("mtime_ms").cast("bigint").alias("mtime_ms"),
                             size.cast("bigint").alias("length"))
    root = dest_root.rstrip("/")
    return dealt_out(listed, parallelism, "length").mapInArrow(lambda batches: _copied(batches, root, sha256), OUTCOMES)
