"""Checksum sidecars beside verified files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stowage.functions.rules import SIDECAR_EXTENSION
from stowage.sources.hashing import open_location

# Fixed value: the time format of a sidecar, in UTC.
STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def sidecar_text(name: Column, md5: Column, sha256: Column, length: Column, acquired: Column,
                 uploaded: Column, producer: Column) -> Column:
    """A line for ``md5sum -c``, then comments; the times are timestamps."""
    sha_line = F.when(F.length(F.coalesce(sha256, F.lit(""))) > 0,
                      F.concat(F.lit("# sha256    "), sha256))
    return F.concat(F.concat_ws(
        "\n",
        F.concat(md5, F.lit("  "), name),
        F.concat(F.lit("# file      "), name),
        F.concat(F.lit("# bytes     "), length.cast("string")),
        F.concat(F.lit("# md5       "), md5),
        sha_line,
        F.concat(F.lit("# acquired  "), F.date_format(acquired, STAMP)),
        F.concat(F.lit("# uploaded  "), F.date_format(uploaded, STAMP)),
        F.concat(F.lit("# by        "), producer)), F.lit("\n"))


def render_sidecar(verified: DataFrame, producer: str) -> DataFrame:
    """(folder, name, md5, sha256, length, mtime_ms, uploaded) to sidecar path and text."""
    return verified.select(
        "folder", F.concat("name", F.lit(SIDECAR_EXTENSION)).alias("name"),
        sidecar_text(F.col("name"), F.col("md5"), F.col("sha256"), F.col("length"),
                     F.timestamp_millis(F.col("mtime_ms")), F.col("uploaded"),
                     F.lit(producer)).alias("text"))


def write_sidecars(rendered: DataFrame, dest_root: str) -> DataFrame:
    """Writes (target, text, mtime_ms) one file per row; yields target and error.

    A sidecar that cannot be written is reported and fails nothing.
    """
    root = dest_root.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                problem = None
                try:
                    system, where = open_location(f"{root}/{row['target'].lstrip('/')}")
                    part = f"{where}.{uuid.uuid4().hex}.part"
                    system.create_dir(os.path.dirname(where), recursive=True)
                    with system.open_output_stream(part) as out:
                        out.write(row["text"].encode())
                    system.move(part, where)
                except Exception as error:
                    problem = str(error)
                done.append((row["target"], problem))
            columns = list(zip(*done)) or [(), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string()) for c in columns], names=["target", "error"])

    return rendered.select("target", "text").mapInArrow(run, "target string, error string")
