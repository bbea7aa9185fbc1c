"""Change notices landed as files by a watcher."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stowage.functions.rules import candidate_filter
from stowage.schema import NOTICES

# Kinds of notice.
CHANGES = ("created", "changed", "renamed")
OVERFLOW = "overflow"


def source_notices(notices: DataFrame, extensions: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Created, changed and renamed files that pass the filter; folders are left out."""
    return notices.where(F.col("kind").isin(*CHANGES) & ~F.col("is_dir")
                         & candidate_filter(F.col("path"), extensions))


def lost_events(notices: DataFrame) -> DataFrame:
    """Notices that say events were lost, so the whole tree must be swept."""
    return notices.where(F.col("kind") == OVERFLOW)


def read_notice_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(NOTICES)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)
