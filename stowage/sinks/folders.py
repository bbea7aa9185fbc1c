"""Folders that Spark has finished writing."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def finished(spark: SparkSession, folder: str, pattern: str) -> list[tuple[list[int], str]]:
    """Numbers in the name and path of each folder below ``folder`` that fits ``pattern`` and holds ``_SUCCESS``."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    found = []
    for status in system.listStatus(where):
        match = re.fullmatch(pattern, status.getPath().getName())
        if match and system.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(([int(g) for g in match.groups()], status.getPath().toString()))
    return sorted(found)


def retire(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders that nothing reads any more."""
    jvm = spark._jvm
    for folder in folders:
        where = jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
