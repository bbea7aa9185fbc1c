"""Walking a directory tree in rounds of Spark jobs.

Each round lists folders in tasks. A task walks on below its folders until it has seen ``BUDGET``
entries and hands the rest to the next round, which deals them out anew: a deep chain is one
task's work, a wide or lopsided tree spreads out, and the driver never lists a folder. Length and time come
from the directory entry, so no file is opened.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from stowage.schema import INVENTORY_SCAN
from stowage.session import shared_dir

#: Entries that a task lists before it leaves the other folders to the next round, and rows of a batch.
BUDGET = 20_000
_BATCH = 10_000
#: Folders of one round go to at most so many tasks for each core.
_TASKS_PER_CORE = 4

_FOUND = pa.schema([("path", pa.string()), ("length", pa.int64()), ("mtime_ms", pa.int64()), ("problem", pa.string()),
                    ("folder", pa.string())])


def _local(folder: str) -> Iterator[tuple[str, bool, int, int]]:
    with os.scandir(folder) as entries:
        for entry in entries:
            # Links are left out, so one cannot send the walk round in a loop.
            if entry.name.startswith(".") or entry.is_symlink():
                continue
            if entry.is_dir(follow_symlinks=False):
                yield entry.path, True, 0, 0
            elif entry.is_file(follow_symlinks=False):
                try:
                    seen = entry.stat(follow_symlinks=False)
                except FileNotFoundError:
                    continue
                yield entry.path, False, seen.st_size, seen.st_mtime_ns // 1_000_000


def _remote(folder: str) -> Iterator[tuple[str, bool, int, int]]:
    system, inner = fs.FileSystem.from_uri(folder)
    before = folder[:len(folder) - len(inner)] if folder.endswith(inner) else ""
    for entry in system.get_file_info(fs.FileSelector(inner)):
        if entry.base_name.startswith("."):
            continue
        if entry.type == fs.FileType.Directory:
            yield before + entry.path, True, 0, 0
        elif entry.type == fs.FileType.File:
            yield before + entry.path, False, entry.size, (entry.mtime_ns or 0) // 1_000_000


def _walk(folders: list[str], root: str, recursive: bool, budget: int) -> Iterator[tuple]:
    """Files below the folders, and the folders that are left once the budget is spent.

    A folder that cannot be read is passed over unless it is the root.
    """
    pending, seen = list(folders), 0
    while pending and seen < budget:
        current = pending.pop()
        try:
            for path, is_folder, length, mtime in (_remote if "://" in current else _local)(current):
                seen += 1
                if not is_folder:
                    yield path, length, mtime, None, None
                elif recursive:
                    pending.append(path)
        except PermissionError as error:
            if current == root:
                yield None, None, None, str(error), None
        except OSError as error:
            yield None, None, None, str(error), None
        seen += 1
    for folder in pending:
        yield None, None, None, None, folder


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)


def scan_tree(spark: SparkSession, root: str, recursive: bool = True, budget: int = BUDGET) -> DataFrame:
    """Inventory rows and, for what could not be read, rows with ``problem``.

    ``root`` is a folder that every worker sees, or a URI of any store that ``pyarrow.fs`` knows.
    """
    root = root if "://" in root else os.path.abspath(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders = [f for batch in batches for f in batch.column("folder").to_pylist()]
        rows: list[tuple] = []
        for row in _walk(folders, root, recursive, budget):
            rows.append(row)
            if len(rows) == _BATCH:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in INVENTORY_SCAN)
    base, rounds = shared_dir(spark, "walk"), []
    frontier, n = spark.createDataFrame([(root,)], "folder string"), 1
    cores = spark.sparkContext.defaultParallelism
    while n:
        rounds.append(f"{base}/round-{len(rounds)}")
        dealt = frontier.repartition(min(n, _TASKS_PER_CORE * cores))
        dealt.mapInArrow(run, f"{columns}, folder string").write.mode("overwrite").parquet(rounds[-1])
        frontier = spark.read.schema(f"{columns}, folder string").parquet(rounds[-1]).where(
            F.col("folder").isNotNull()).select("folder")
        n = frontier.count()
    found = spark.read.schema(f"{columns}, folder string").parquet(*rounds)
    return found.where(F.col("folder").isNull()).drop("folder")


_ENTRY = pa.schema([("parent", pa.string()), ("path", pa.string()), ("name", pa.string()), ("is_collection", pa.bool_()),
                    ("length", pa.int64()), ("mtime_ms", pa.int64()), ("problem", pa.string())])


def list_folders(folders: DataFrame, folder: str = "path") -> DataFrame:
    """The entries (parent, path, name, is_collection, length, mtime_ms, problem) of each folder, not of those below.

    A folder that is not there has none; one that can't be read is one row with ``problem``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parent in batch.column("folder").to_pylist():
                rows: list[tuple] = []
                try:
                    for path, is_folder, length, mtime in (_remote if "://" in parent else _local)(parent):
                        rows.append((parent, path, path.rstrip("/").rsplit("/", 1)[-1], is_folder, length, mtime, None))
                        if len(rows) == _BATCH:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ENTRY)], schema=_ENTRY)
                            rows = []
                except FileNotFoundError:
                    pass
                except OSError as error:
                    rows.append((parent, None, None, None, None, None, str(error)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ENTRY)], schema=_ENTRY)

    cores = folders.sparkSession.sparkContext.defaultParallelism
    return folders.select(F.col(folder).alias("folder")).repartition(_TASKS_PER_CORE * cores).mapInArrow(
        run, "parent string, path string, name string, is_collection boolean, length bigint, mtime_ms bigint, problem string")


def stamp(path: str) -> tuple[int, int] | None:
    """Length and modification time of a file in milliseconds, or nothing where there is no file."""
    if "://" not in path:
        try:
            seen = os.stat(path)
        except OSError:
            return None
        return (seen.st_size, seen.st_mtime_ns // 1_000_000) if os.path.isfile(path) else None
    system, inner = fs.FileSystem.from_uri(path)
    seen = system.get_file_info(inner)
    return (seen.size, (seen.mtime_ns or 0) // 1_000_000) if seen.type == fs.FileType.File else None


def stat_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, length, mtime_ms) of those of the named files that are there, each looked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.column("path").to_pylist()
            seen = [(p, *s) for p, s in ((p, stamp(p)) for p in named) if s]
            columns = zip(*seen, strict=True) if seen else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))],
                                             ["path", "length", "mtime_ms"])

    cores = paths.sparkSession.sparkContext.defaultParallelism
    return paths.select(F.col(path).alias("path")).where("path IS NOT NULL").distinct().repartition(
        _TASKS_PER_CORE * cores).mapInArrow(run, "path string, length bigint, mtime_ms bigint")


def scan_inventory(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, length, mtime_ms) of every visible file; never fails on an unreadable folder."""
    return scan_tree(spark, root, recursive).where(F.col("problem").isNull()).drop("problem")


def scan_problem(scanned: DataFrame, root: str) -> DataFrame:
    """One row: what kept the walk from being complete, or NULL."""
    first = F.min(F.col("problem"))
    return scanned.agg(F.when(first.isNotNull(), F.concat(
        F.lit(f"Could not read the monitored folder {root}: "), first,
        F.lit(" Transfers resume by themselves once it is reachable again."))).alias("problem"))
