"""Reading ledger tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stowage.schema import HASH_CACHE, LEDGER


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A typed read without schema inference."""
    return spark.read.schema(LEDGER).parquet(path)


def read_hash_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HASH_CACHE).parquet(path)
