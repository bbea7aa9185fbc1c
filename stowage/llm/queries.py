"""Imports every module of this subpackage that registers queries, and registers the pipeline."""

import corpus_pipeline
from stowage.llm import (  # noqa: F401
    contamination,
    language,
    licenses,
    near,
    negatives,
    packing,
    personal,
    prefixes,
    quality,
    sharding,
    substring,
    urls,
    vectors,
)
from stowage.llm.registry import ORACLES, QUERIES, query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["ORACLES", "QUERIES"]
