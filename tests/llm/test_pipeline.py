"""The pipeline's stages against what each has to keep."""

from __future__ import annotations

import corpus_pipeline
from stowage.plans.staging import stage
from tests.conftest import SMALL
from tests.llm import plain


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    now = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in now.collect()}
        now = stage(step(spark, now, SMALL), name)
        assert now.columns == docs.columns
        after = {r.doc_id: r.text for r in now.collect()}
        if name == "language_id":
            assert after == before
        elif name == "near_dedup":
            assert set(after) == {i for i, (_, _, kept) in plain.near(list(before.items())).items() if kept}
        elif name == "decontaminate":
            held = [plain.shingles(t) for t in items]
            assert set(after) == {i for i, t in before.items() if not any(
                s and 10 * len(s & plain.shingles(t)) >= 8 * len(s) for s in held)}
        else:
            assert set(after) == set(before)
            assert not any(plain.base_spans(t) for t in after.values())
            assert all(after[i] == t for i, t in before.items() if not plain.base_spans(t))
    last = corpus_pipeline.STAGES[-1][1](spark, now, SMALL)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == set(after)


def test_run_and_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "text without an id", "en", "a", 18), (None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [r.doc_id for r in got] == [None, None]
