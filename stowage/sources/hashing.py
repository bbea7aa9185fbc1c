"""Content hashes: MD5 always, SHA-256 on request, in one pass."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

BLOCK = 1 << 20


def content_hashes(df: DataFrame, content: Column, sha256: bool = False) -> DataFrame:
    """Hashes of content that is already a column; stays on the JVM."""
    second = F.sha2(content, 256) if sha256 else F.lit(None).cast("string")
    return df.withColumn("md5", F.md5(content)).withColumn("sha256", second)


def open_location(location: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path behind a plain path or a URI."""
    if "://" in location or location.startswith("file:"):
        return pafs.FileSystem.from_uri(location)
    return pafs.LocalFileSystem(), location


def hash_stream(source, sink, sha256: bool) -> tuple[int, str, str | None]:
    """Reads ``source`` to its end in blocks, writing them to ``sink`` if there is one."""
    md5, sha, count = hashlib.md5(), hashlib.sha256() if sha256 else None, 0
    while block := source.read(BLOCK):
        md5.update(block)
        if sha is not None:
            sha.update(block)
        if sink is not None:
            sink.write(block)
        count += len(block)
    return count, md5.hexdigest(), sha.hexdigest() if sha is not None else None


#: Bytes that a file counts for beside its own, since opening one takes time too.
OPENING = 1 << 16
#: Groups in which a list is summed up before it is dealt out.
GROUPS = 1024


def dealt_out(df: DataFrame, tasks: int | None, weight: str | None = None, path: str = "path") -> DataFrame:
    """Rows spread over several tasks per slot, because what follows reads whole files: a folder's worth of
    names in one task would be a straggler.

    With a column of sizes the bytes are dealt, not the rows: the files stand in a fixed order, the sum of the sizes
    before a file says which task's share it begins in, and so no task has more than its share and one file.
    The sums are taken in ``GROUPS`` groups of paths, and over the groups. In a task the largest file comes first.
    """
    tasks = tasks or 4 * df.sparkSession.sparkContext.defaultParallelism
    if weight is None:
        return df.repartition(tasks)
    cost = F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0)) + OPENING
    weighed = df.withColumn("_cost", cost).withColumn("_group", F.pmod(F.xxhash64(path), F.lit(GROUPS)))
    sums = weighed.groupBy("_group").agg(F.sum("_cost").alias("_sum"))
    # At most GROUPS rows.
    before = F.broadcast(sums.select("_group", (F.sum("_sum").over(Window.orderBy("_group")) - F.col("_sum")).alias("_before"),
                                     F.sum("_sum").over(Window.partitionBy(F.lit(0))).alias("_total")))
    within = F.sum("_cost").over(Window.partitionBy("_group").orderBy(path).rowsBetween(Window.unboundedPreceding, -1))
    starts = F.col("_before") + F.coalesce(within, F.lit(0))
    task = F.floor(starts.cast("double") * tasks / F.col("_total")).cast("int")
    return (weighed.join(before, "_group").withColumn("_task", F.least(task, F.lit(tasks - 1)))
            .repartitionById(tasks, "_task").sortWithinPartitions(F.desc("_cost")).drop("_cost", "_group", "_before", "_total", "_task"))


def hash_files(files: DataFrame, sha256: bool = False, tasks: int | None = None,
               path: str = "path") -> DataFrame:
    """Adds md5, sha256 and error by reading each file once, whatever its size.

    Every other column passes through untouched; ``length``, if there is one, deals the files by bytes.
    """
    schema = T.StructType(files.schema.fields + [
        T.StructField(name, T.StringType()) for name in ("md5", "sha256", "error")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for location in batch.column(path).to_pylist():
                try:
                    system, where = open_location(location)
                    with system.open_input_stream(where) as source:
                        _, md5, sha = hash_stream(source, None, sha256)
                    found.append((md5, sha, None))
                except Exception as error:  # One bad file must not stop the rest.
                    found.append((None, None, str(error)))
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                batch.columns + [pa.array(c, pa.string()) for c in columns],
                names=batch.schema.names + ["md5", "sha256", "error"])

    return dealt_out(files, tasks, "length" if "length" in files.columns else None, path).mapInArrow(run, schema)


def file_hasher(sha256: bool = False, tasks: int | None = None):
    """A hasher for the ladder; a file that cannot be read has no hash."""
    return lambda files: hash_files(files, sha256, tasks).drop("error")
