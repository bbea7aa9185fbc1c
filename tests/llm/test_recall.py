"""Nothing is lost near the threshold: mutated licenses and items, and a large group of near copies."""

from __future__ import annotations

import random

import regex

from stowage.llm import contamination, licenses
from stowage.llm.near import near_duplicates
from tests.llm import plain
from tests.llm.test_operators import prose


def mutated(words, rng, changed):
    """The words with runs of up to ``changed`` words in all replaced, dropped or added, at one or two places."""
    words = list(words)
    for _ in range(rng.choice((1, 2))):
        at, n = rng.randrange(len(words)), rng.randint(0, changed // 2)
        words[at:at + n] = prose(rng.random(), rng.choice((0, n))).split()
    return words


def marked(text):
    words = regex.findall(r"[\p{L}\p{N}]+", (text or "").translate(plain.LOWER))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def test_mutated_licenses(spark):
    rng, texts = random.Random(1), []
    for name, text in licenses.TEMPLATES.items():
        for _ in range(12):
            own = text.split()
            body = mutated(own, rng, max(1, len(own) // 6))
            texts.append(" ".join([*prose(rng.random(), rng.randint(0, 200)).split(), *body, *prose(rng.random(), rng.randint(0, 90)).split()]))
    held = {name: marked(t) for name, t in licenses.TEMPLATES.items()}
    want = set()
    for i, t in enumerate(texts):
        own = marked(t)
        want |= {(i, name, len(sh), len(own & sh)) for name, sh in held.items() if 10 * len(own & sh) >= 8 * len(sh)}
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {tuple(r) for r in licenses.licenses(rows).collect()}
    assert got == want and len(want) > 200
    assert len({(n, f) for _, _, n, f in want if f < n}) > 30


def test_mutated_items(spark):
    rng, items, texts = random.Random(2), [], []
    for i in range(250):
        item = prose(500 + i, rng.choice((12, 30, 60, 140, 400))).split()
        items.append((i, " ".join(item)))
        texts.append((i, " ".join([*prose(rng.random(), rng.randint(0, 900)).split(), *mutated(item, rng, len(item) // 5),
                                   *prose(rng.random(), rng.randint(0, 300)).split()])))
    sets, want = {i: plain.shingles(t) for i, t in items}, set()
    for i, t in texts:
        own = plain.shingles(t)
        n = len(own & sets[i])
        if 10 * n >= 8 * len(sets[i]):
            want.add((i, i, len(sets[i]), n))
    found = contamination.contaminated(spark.createDataFrame(texts, "doc_id long, text string").repartition(4),
                                       spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in found.collect()} == want and 120 < len(want) < 250


def test_a_large_group_around_the_threshold(spark):
    """Near copies of one text: most pairs are a little under the threshold, some reach it."""
    rng, base, rows = random.Random(3), prose(77, 160).split(), []
    for i in range(700):
        words = list(base)
        for _ in range(rng.choice((1, 2, 3))):
            words[rng.randrange(len(words))] = f"own{rng.randrange(60)}"
        rows.append((i, " ".join(words)))
    sets = {i: plain.shingles(t) for i, t in rows}
    links, under = [], 0
    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            union = len(sets[i]) + len(sets[j]) - both
            if 100 * both >= 85 * union:
                links.append((i, j))
            elif 100 * both >= 75 * union:
                under += 1
    part = plain.components(sets, links)
    assert under > 50_000 and len(set(part.values())) > 5
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == part
