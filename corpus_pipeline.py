"""Documents to training sequences in five stages, each one of the corpus operators.

Every stage takes the table that the one before wrote and works on all of it. All but the last return the
columns of ``documents``; rows without a ``doc_id`` can't be named by a decision and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stowage.llm.contamination import contaminated
from stowage.llm.language import identify_documents
from stowage.llm.near import near_duplicates
from stowage.llm.packing import pack_documents
from stowage.llm.personal import redact
from stowage.plans.staging import stage
from stowage.session import tune


#: The near-duplicate stage drops from this similarity on, in percent: the one that its test holds it to.
NEAR_PERCENT = 85


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    return docs.join(stage(dropped.select("doc_id").distinct(), "dropped"), "doc_id", "left_anti").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a wanted language."""
    tune(spark)
    return _without(docs, identify_documents(docs).where("NOT kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    tune(spark)
    return _without(docs, near_duplicates(docs, percent=NEAR_PERCENT).where("NOT kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    tune(spark)
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks."""
    tune(spark)
    return redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    tune(spark)
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("personal_data", personal_data), ("packing", packed)]

# The first stage fits a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each on the stored result of the one before."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
