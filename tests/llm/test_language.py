"""Language identification against plain loops: trigrams, counts, witnesses and posteriors."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from stowage.llm import language
from stowage.llm.language import CLASSES, LANGUAGES
from stowage.plans.staging import stage
from tests.llm.test_operators import prose


def grams(text):
    """Buckets of the trigrams of a text: letters in lower case, everything else one blank."""
    folded = [c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in f" {text or ''} ".encode()]
    short = [c for i, c in enumerate(folded) if c != 32 or i == 0 or folded[i - 1] != 32]
    return [((a << 16 | b << 8 | c) * 0x9E3779B1 % 2**32) >> 17 for a, b, c in zip(short, short[1:], short[2:], strict=False)]


def posteriors(rows, model):
    """{key: (language, probability)} of (key, text, declared, host, suffix)."""
    told = {k: [sum(float(model[g, c]) for g in grams(t)) / 3 for c in range(5)] for k, t, *_ in rows}
    n = {k: len(grams(t)) for k, t, *_ in rows}
    guess = {k: max(range(5), key=lambda c: (told[k][c], -c)) for k in told if n[k]}
    total = [sum(g == c for g in guess.values()) for c in range(5)]
    share = [(total[c] + 1) / (sum(total[:4]) + 4) * 0.99 for c in range(4)] + [0.01]
    domain = lambda h: h and ".".join(h.split(".")[-2:])

    def counts(of, value, least):
        own = [guess[r[0]] for r in rows if r[0] in guess and of(r) == value and n[r[0]] >= least]
        return [own.count(c) for c in range(5)] if value is not None else [0] * 5

    def named(suffix):
        parts = (suffix or "").split("/")
        return next((p for p in (parts[-1], parts[0]) if p in LANGUAGES), None)

    out = {}
    for row in rows:
        key, _, declared, host, suffix = row
        if not n[key]:
            out[key] = ("und", 0.0)
            continue
        prior = share
        for of, value in ((lambda r: domain(r[3]), domain(host)), (lambda r: r[3], host)):
            c = counts(of, value, 1)
            prior = [(c[i] + 20 * prior[i]) / (sum(c) + 20) for i in range(5)]
        logs = [told[key][i] + math.log(prior[i]) for i in range(5)]
        for of, value, name in ((lambda r: r[2], declared, declared if declared in LANGUAGES else None),
                                (lambda r: r[4], suffix, named(suffix))):
            if value is None:
                continue
            c = counts(of, value, language.SURE)
            for i, cls in enumerate(CLASSES):
                before = share[i] if name is None else 0.95 if cls == name else 0.05 * share[i] / (1 - share[CLASSES.index(name)])
                logs[i] += math.log((c[i] + 5 * before) / (sum(c) + 5) / share[i])
        top = max(range(5), key=lambda i: (logs[i], -i))
        out[key] = (CLASSES[top], 1 / sum(math.exp(x - logs[top]) for x in logs))
    return out


def test_trigrams():
    texts = [None, "", " \t", "e", "É", "a b", "  Ab..c9d ", "x" * 500, "漢字 😀", "tion\n\nde la"] + [prose(i, 40) for i in range(5)]
    code, row = language.trigrams(pa.array(texts))
    got = [code[row == i].tolist() for i in range(len(texts))]
    assert got == [grams(t) for t in texts] and [len(g) for g in got[:5]] == [0, 0, 0, 1, 2]


@pytest.mark.parametrize("seed", [1, 2])
def test_posteriors(spark, seed):
    """Fifty rows with nulls, single letters, ties and repeats."""
    rng = random.Random(seed)
    model = np.log(np.random.default_rng(seed).dirichlet(np.ones(8), size=(language.BUCKETS, 1))[:, 0, :5]).astype(np.float32)
    model[:, 1] = model[:, 0] if seed == 2 else model[:, 1]
    texts = [None, "", ".", "e", "q", "la", "tion", "die und", prose(3, 30), prose(4, 90), prose(4, 90)]
    rows = [(i, rng.choice(texts), rng.choice(["de", "fr", "xx", None, "en"]), rng.choice(["a.example.net", "b.example.net", "c.org", None]),
             rng.choice(["net/fr", "net/xx", "de", "org", "fr/es", None])) for i in range(50)]
    frame = spark.createDataFrame(rows, "key long, text string, declared string, host string, suffix string")
    fused = language.fuse(stage(language.text_evidence(frame.fillna("", ["text"]), model), "evidence"))
    want = posteriors(rows, model)
    got = {r.key: (r.language, r.probability) for r in fused.collect()}
    assert set(got) == set(want)
    for key, (name, p) in want.items():
        assert got[key][1] == pytest.approx(p, abs=1e-6)
        assert got[key][0] == name or seed == 2


def test_address_suffixes(spark):
    from pyspark.sql import functions as F

    urls = ["http://a.b.net/fr/x", "https://x.de/", "http://x.org/english", "ftp://h.es:80/DE?q", None, "no address", "://q"]
    rows = spark.createDataFrame(list(enumerate(urls)), "i long, url string").select("i", language.address_suffix(F.col("url")).alias("s"))
    got = [tuple(r) for r in rows.select("i", "s", language.named_language(F.col("s"))).orderBy("i").collect()]
    assert got == [(0, "net/fr", "fr"), (1, "de/", "de"), (2, "org/", None), (3, "es/de", "de"), (4, None, None), (5, None, None), (6, "q/", None)]
