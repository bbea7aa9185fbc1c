"""Outcomes of copies travel in batches."""

from __future__ import annotations

import pyarrow as pa

from stowage.sinks.mirror import _copied


def test_outcomes_of_a_batch_are_one_batch(tmp_path):
    (tmp_path / "a").write_text("text")
    work = pa.RecordBatch.from_pylist([
        {"path": str(tmp_path / name), "target": f"/t/{name}", "mtime_ms": 1_000, "length": 4} for name in ("a", "gone", "a")])
    done = list(_copied(iter([work, work.slice(0, 0)]), str(tmp_path / "to"), False))
    assert [batch.num_rows for batch in done] == [3, 0]
    assert [(r["bytes"], r["error"] is None) for r in done[0].to_pylist()] == [(4, True), (0, False), (4, True)]
    assert (tmp_path / "to/t/a").read_text() == "text"
