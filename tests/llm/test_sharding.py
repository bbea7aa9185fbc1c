"""Shards of a hash tree: against a plain loop, under growth and changed weights, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stowage.llm.sharding import TREE, Tree, descend, sharded
from stowage.llm.slots import with_slots

KEYS = 4000


def draw(key, name, weight):
    u = (int(hashlib.md5(f"{key}/{name}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
    return -math.log(u) / weight if weight > 0 else math.inf


def clocks(key, count, tree):
    """The clock of every shard: at each node the earliest child has the node's, the others lag."""
    out = {}
    for r in range(-(-count // tree.region)):
        racks = tree.rack_weights(r)
        top, own = draw(key, r, sum(racks)), [draw(key, f"{r}.{k}", w) for k, w in enumerate(racks)]
        for k in range(tree.racks):
            leaves = [draw(key, f"{r}.{k}.{s}", w) for s, w in enumerate(tree.shard_weights(r * tree.racks + k))]
            for s, c in enumerate(leaves):
                shard = r * tree.region + k * tree.shards + s
                if shard < count and c < math.inf:
                    out[shard] = top + (own[k] - min(own)) + (c - min(leaves))
    return out


def placed(spark, count, tree):
    keys = spark.range(KEYS).withColumn("k", F.col("id").cast("string"))
    return {r.id: r.shard.shard for r in descend(keys, F.col("k"), count, tree).select("id", "shard").collect()}


@pytest.mark.parametrize("tree, counts", [(TREE, (1, 24, 25, 30)), (Tree(2, 3, (1, 2, 0.5, 4, 0, 1, 3)), (2, 6, 7, 10))])
def test_places_by_hand(spark, tree, counts):
    for count in counts:
        got = placed(spark, count, tree)
        for key in range(0, KEYS, 7):
            times = clocks(key, count, tree)
            assert got[key] == min(times, key=times.get)


def test_growth_moves_rows_into_the_new_shard_only(spark):
    tree = Tree(2, 3)
    before = placed(spark, 1, tree)
    for count in range(2, 16):
        now = placed(spark, count, tree)
        moved = [i for i in now if now[i] != before[i]]
        assert {now[i] for i in moved} == {count - 1}
        assert abs(len(moved) - KEYS / count) < 5 * (KEYS / count) ** 0.5
        before = now


def test_shares_follow_weights(spark):
    tree = Tree(2, 2, (1, 2, 3, 2, 0, 4, 4, 0))
    got = Counter(placed(spark, 8, tree).values())
    for shard, w in enumerate(tree.weights):
        assert abs(got[shard] - KEYS * w / 16) < 5 * (KEYS * w / 16) ** 0.5 + 1


def test_a_changed_weight_moves_rows_on_its_path_only(spark):
    old, new = Tree(2, 2, (1,) * 8), Tree(2, 2, (1, 1, 1, 3, 1, 1, 1, 1))
    a, b = placed(spark, 8, old), placed(spark, 8, new)
    moves = {(a[i], b[i]) for i in a if a[i] != b[i]}
    # Shard 3 is in region 0, rack 1: none leaves that region, and within it none leaves that rack, or that shard.
    assert moves and all(y < 4 for _, y in moves)
    assert {(x, y) for x, y in moves if x < 4} <= {(0, 2), (0, 3), (1, 2), (1, 3), (2, 3)}


def test_bad_trees(spark):
    rows = spark.range(1)
    for count, tree in ((0, TREE), (2, Tree(1, 2, (0, 0))), (2, Tree(1, 2, (1, -1)))):
        with pytest.raises(ValueError):
            descend(rows, F.col("id").cast("string"), count, tree)


ODD = [(5, "one", 1), (5, "one", 2), (5, "two", 3), (None, None, 4), (None, "", 5), (None, "x", 6), (7, None, 7), (8, "", 8),
       (9, "Ünïcode 😀", 9), (10, "long " * 50_000, 10), (-3, "minus", 11)]


def test_odd_rows(spark):
    rows = spark.createDataFrame([(*r, "clash", 0) for r in ODD], "doc_id long, text string, slot int, shard string, grown_shard int")
    got = sharded(rows).collect()
    assert len(got) == len(ODD)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in ODD)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert len({r.shard for r in got if r.doc_id is None}) == 1 == len({r.shard for r in got if r.doc_id == 5})
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24) and r.law == "key" and 0 <= r.shard < 24
        assert (r.rack, r.region) == (r.shard // 4, r.shard // 12)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharded(rows.limit(0)).count() == 0


def test_slots_of_a_hot_group(spark):
    """One group and one row hold most of the table: each row has a place, in order, over many tasks."""
    rows = spark.range(6000).select(F.when(F.col("id") % 7 == 0, F.col("id") % 5).otherwise(2).alias("g"),
                                    F.when(F.col("id") % 3 == 0, F.lit(8)).otherwise(F.col("id") % 50).alias("v"))
    got = with_slots(rows, "g", ["v"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.slot, r.v))
    assert sum(map(len, by.values())) == 6000
    for places in by.values():
        places.sort()
        assert [s for s, _ in places] == list(range(len(places)))
        assert [v for _, v in places] == sorted(v for _, v in places)
