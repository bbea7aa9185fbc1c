"""Hard negatives against a plain loop: many leaves, ties, copies, odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.llm import negatives
from stowage.llm.negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, leaf string, n int"


def by_hand(rows, every=10, positives=5, negs=5, low=80, high=100):
    whole = []
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [math.floor(256 * float(np.float32(c))) for c in v]
        if sum(c * c for c in x) < 2**62:
            whole.append((i, x, label))
    score = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for k, (i, x, label) in enumerate(whole):
        if i % every:
            continue
        own = sorted((-score(x, y), j) for m, (j, y, other) in enumerate(whole) if m != k and other == label)[:positives]
        others = sorted((-score(x, y), j) for j, y, other in whole if other != label)
        for s, j in own:
            within = [(t, m) for t, m in others if low * -s <= 100 * -t <= high * -s][:negs]
            out += [(i, j, r, m, -s, -t) for r, (t, m) in enumerate(within, 1)]
    return sorted(out)


def found(spark, rows, every=10, **options):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives(frame, F.col("vec_id") % every == 0, **options).collect())


@pytest.fixture
def many_leaves(monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 24)
    monkeypatch.setattr(negatives, "ROWS_BLOCK", 16)
    monkeypatch.setattr(negatives, "QUERIES_BLOCK", 4)


def clustered(rng, n, dims, spread):
    centres = rng.normal(size=(9, dims)) / dims**0.5
    return [(i, (centres[i % 9] + rng.normal(size=dims) * spread).tolist(), int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("dims, spread", [(2, 0.3), (8, 0.05), (24, 0.1)])
def test_against_all_rows(spark, many_leaves, dims, spread):
    rows = clustered(np.random.default_rng(dims), 700, dims, spread)
    want = by_hand(rows)
    assert len(want) > 200 and found(spark, rows) == want


def test_other_windows(spark, many_leaves):
    rows = clustered(np.random.default_rng(1), 300, 6, 0.2)
    options = {"positives": 2, "negatives": 3, "low": 40, "high": 75}
    assert found(spark, rows, **options) == by_hand(rows, positives=2, negs=3, low=40, high=75)


def test_leaves_are_left_out(spark):
    """Ranges keep queries from most leaves of clustered rows, and never from one that holds a wanted row."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * np.array([v for _, v, _ in clustered(rng, 4000, 6, 0.01)])).astype(np.int64)
    norms = (x**2).sum(axis=1)
    tree = negatives.build(x, norms, 200_000, int(norms.max()))
    leaf = tree.routed(x, norms, ranges=True)
    assert tree.leaves > 30 and len(set(leaf.tolist())) == tree.leaves
    far = np.sqrt(np.maximum(tree.norm + norms[:50, None] - 2 * x[:50] @ x.T, 0))
    near = np.sort(far, axis=1)[:, 20]
    met = tree.met(x[:50], norms[:50], near * 0.9, near)
    assert met.mean() < 0.5
    for q, r in np.argwhere((far >= near[:, None] * 0.9) & (far <= near[:, None])):
        assert met[q, leaf[r]]


def test_copies_and_ties(spark, many_leaves):
    """One vector holds most rows; scores tie and the smaller id counts."""
    rng = np.random.default_rng(5)
    some = rng.normal(size=(6, 4)).tolist()
    rows = [(i, some[0] if i % 3 else some[i % 6], i % 4) for i in range(400)]
    assert found(spark, rows, 20) == by_hand(rows, 20)


ODD = [(0, [1.0, 2.0, 3.0], 1), (10, [1.0, 2.0], 1), (20, [], 1), (30, None, 1), (40, [1.0, None, 1.0], 1), (50, [float("nan")] * 3, 1),
       (60, [float("inf"), 1.0, 1.0], 2), (70, [0.0] * 3, 2), (80, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (1, [1.0, 2.0, 2.5], 2),
       (2, [1.0, 2.0, 2.9], 1), (3, [-1.0, -2.0, 1.0], 2), (4, [1.0, 2.0, 2.9, 7.0], 1), (5, [0.5] * 6, 3), (90, [-1.0, 0.5, 0.25], 1),
       (90, [1.0, 2.0, 2.8], 2), (6, [1e30] * 3, 1), (7, [1e6, 2e6, 1e6], 1), (8, [1e6, 2e6, 0.9e6], 2), (100, [1e6, 2e6, 1.1e6], 1)]


def test_odd_rows(spark):
    assert found(spark, ODD) == by_hand(ODD)
    small = [r for r in ODD if not r[1] or max((abs(x) for x in r[1] if x is not None), default=0) < 9]
    assert found(spark, small) == by_hand(small)
    assert found(spark, []) == [] and found(spark, ODD[2:3]) == []
