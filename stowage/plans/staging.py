"""Writing a stage once, where every executor can read it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stowage.session import shared_dir


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` below the shared folder and reads it back.

    Needed where a plan is read more than once, or has side effects that must happen once: what
    follows starts from files that outlive any executor.
    """
    spark = df.sparkSession
    where = shared_dir(spark, label)
    df.write.mode("overwrite").parquet(where)
    return spark.read.schema(df.schema).parquet(where)
