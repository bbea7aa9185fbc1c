"""The prefix trie against a plain loop: many ranges, long and equal conversations, odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from stowage.llm import prefixes
from stowage.llm.prefixes import Skeleton, conversations_of, prefix_trie, splitters, with_heads

SCHEMA = "conv_id long, turn long, role string, text string, key string, turns int"


def histories(rows):
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [t[1:] for t in sorted(turns)] for c, turns in out.items()}


def with_heads_by_hand(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c / 5) * 5
        out[c] = own.get(c - base, [])[:h] + turns[h:]
    return out


def by_hand(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, total = {}, {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = []
    for node in sorted(members, key=len, reverse=True):
        own = children.get(node, [])
        saved = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        total[node] = (sum(total[k][0] for k in own) or 1, saved + sum(total[k][1] for k in own))
        ends = ",".join(map(str, sorted(c for c in members[node] if len(convs[c]) == len(node))))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(own),
                    *total[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def told(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def tree(seed, n, depth, ways, longest=0):
    """Conversations that branch a little at each turn; some are equal, some prefixes of others, one in a while is long."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        length = rng.randint(1, depth) if not longest or c % 97 else longest
        state = 0
        for t in range(length):
            state = state * ways + rng.choice([0] * 5 + list(range(ways)))
            rows.append((c, t, ("user", "assistant")[t % 2], f"said {t} {state % 1_000_003} é" * (1 + state % 3)))
    rng.shuffle(rows)
    return rows


@pytest.fixture(params=[1, 25])
def ranges(request, monkeypatch):
    monkeypatch.setattr(prefixes, "PATHS", 1 if request.param > 1 else 20_000)
    monkeypatch.setattr(prefixes, "RANGES", request.param)
    monkeypatch.setattr(prefixes, "IDS", 3)
    return request.param


@pytest.mark.parametrize("shape", [(1, 300, 6, 3, 0), (2, 150, 5, 2, 120), (3, 400, 3, 12, 0)])
def test_tries(spark, ranges, shape):
    rows = tree(*shape)
    own = conversations_of(frame(spark, rows))
    assert told(prefix_trie(own)) == by_hand(histories(rows))


def test_rebuilt(spark, ranges):
    rows = [(c - 90, *r) for c, *r in tree(4, 300, 12, 3) if c % 7]
    got = prefix_trie(with_heads(conversations_of(frame(spark, rows)), F.col("key") - F.col("key") % 5,
                                 F.crc32(F.col("key").cast("string").cast("binary")) % 9, 8))
    assert told(got) == by_hand(with_heads_by_hand(histories(rows)))


def test_odd_rows(spark, ranges):
    rows = [(1, None, "user", "first"), (1, 0, "user", "next"), (2, None, "user", "first"), (2, 5, None, None), (3, 1, "", ""), (3, 9, "user", None),
            (4, 2, None, "x" * 200_000), (5, 1, "user", "first"), (5, 1, "user", "first"), (None, 1, "user", "none"), (6, -3, "é", "漢 😀"),
            (2**62, 1, "", ""), (-7, 1, "user", "first"), (8, 3, "ab", "c"), (9, 3, "a", "bc")]
    assert told(prefix_trie(conversations_of(frame(spark, rows)))) == by_hand(histories(rows))
    assert told(prefix_trie(conversations_of(frame(spark, [])))) == []


def test_one_path_holds_most(spark, ranges):
    """A thousand equal conversations are one path, and their ids are hashed in order, in parts."""
    rows = [(c, t, "user", f"same {t}") for c in range(1000) for t in range(3)] + [(2000 + c, 0, "user", f"own {c % 50}") for c in range(200)]
    assert told(prefix_trie(conversations_of(frame(spark, rows)))) == by_hand(histories(rows))


def test_splitters_are_short_and_in_order():
    rng = random.Random(8)
    turn = [bytes([i]) * 16 for i in range(4)]
    paths = sorted({b"".join(rng.choice(turn) for _ in range(rng.randint(0, 9))) for _ in range(500)})
    cuts = splitters(paths, 20)
    assert cuts == sorted(set(cuts)) and 10 < len(cuts) < 20 and all(len(c) % 16 == 0 and c for c in cuts)
    skeleton = Skeleton(cuts)
    assert all(a < b for b, a in enumerate(skeleton.parent)) and max(skeleton.depth) * 16 == max(map(len, cuts))
    assert splitters([b""], 5) == [] == splitters([], 5)
