"""Shards by a hierarchical weighted hash tree: region, rack, shard.

A row draws a clock for each subtree of a node, an exponential with the subtree's weight as rate, from a hash of its
key and the subtree's name; the earliest wins, and the row goes down to it. A change of weight alters the clocks
of the subtrees above that shard only: a higher one draws rows from their siblings, a lower one gives rows to them, and
siblings exchange none.

The tree has room beyond its shards: regions are of one shape, and the last may be filled in part. There a clock
is passed on: the earliest of a node's racks has the node's clock, the others theirs plus their lag, and so down to
the shards, which makes the clocks of the shards independent. So a further shard competes with a clock of its own, and
rows move into it and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.registry import query, table
from stowage.llm.slots import with_slots
from stowage.llm.sqltext import sql_crc32

SHARDS = 24
#: Bytes that a row takes beside its text.
ROW_BYTES = 8
#: A draw is this many hexadecimal digits of a hash.
DIGITS = 13


@dataclass(frozen=True)
class Tree:
    """Racks of a region, shards of a rack, and the weights of shards 0, 1, ... (1 for those beyond)."""

    racks: int = 3
    shards: int = 4
    weights: tuple[float, ...] = ()

    @property
    def region(self) -> int:
        return self.racks * self.shards

    def shard_weights(self, rack: int) -> list[float]:
        """Weights of the shards of a rack; racks are counted through all regions."""
        own = [float(w) for w in self.weights[rack * self.shards:(rack + 1) * self.shards]]
        return own + [1.0] * (self.shards - len(own))

    def rack_weights(self, region: int) -> list[float]:
        return [sum(self.shard_weights(region * self.racks + k)) for k in range(self.racks)]


TREE = Tree()


def clock(key: Column, name: Column, weight: Column) -> Column:
    """An exponential draw of this rate; never, for a weight of 0."""
    digits = F.substring(F.md5(F.concat_ws("/", key, name).cast("binary")), 1, DIGITS)
    u = (F.conv(digits, 16, 10).cast("long") + 0.5) / float(16**DIGITS)
    return F.when(weight > 0, -F.ln(u) / F.when(weight > 0, weight)).otherwise(float("inf"))


def _clocks(key: Column, above: Column | None, weights: Column) -> Column:
    """(clock, child) for each weight of an array."""
    name = (lambda i: F.concat_ws(".", above, i)) if above is not None else (lambda i: i.cast("string"))
    return F.transform(weights, lambda w, i: F.struct(clock(key, name(i), w).alias("clock"), i.alias("child")))


def _place(clock_of: Column, region: Column, rack: Column, shard: Column) -> Column:
    return F.struct(clock_of.alias("clock"), region.cast("int").alias("region"), rack.cast("int").alias("rack"),
                    shard.cast("int").alias("shard"))


def _running(key: Column, count: int, tree: Tree) -> Column:
    """The subtrees that compete at the top: whole regions, and whole racks and single shards of the one filled in part."""
    whole, rest = divmod(count, tree.region)
    racks, shards = divmod(rest, tree.shards)
    parts = []
    if whole:
        rates = F.array(*[F.lit(float(sum(tree.rack_weights(r)))) for r in range(whole)])
        parts.append(F.transform(_clocks(key, None, rates), lambda c: _place(c.clock, c.child, F.lit(-1), F.lit(-1))))
    if rest:
        top = clock(key, F.lit(str(whole)), F.lit(float(sum(tree.rack_weights(whole)))))
        own = [clock(key, F.lit(f"{whole}.{k}"), F.lit(w)) for k, w in enumerate(tree.rack_weights(whole))]
        lag = [top + (c - F.array_min(F.array(*own))) for c in own]
        parts += [F.array(_place(lag[k], F.lit(whole), F.lit(k), F.lit(-1))) for k in range(racks)]
        if shards:
            weights = tree.shard_weights(whole * tree.racks + racks)
            own = [clock(key, F.lit(f"{whole}.{racks}.{s}"), F.lit(w)) for s, w in enumerate(weights)]
            parts += [F.array(_place(lag[racks] + (own[s] - F.array_min(F.array(*own))), F.lit(whole), F.lit(racks), F.lit(s)))
                      for s in range(shards)]
    return F.concat(*parts)


def descend(rows: DataFrame, key: Column, count: int, tree: Tree, name: str = "shard") -> DataFrame:
    """``rows`` with a struct column ``name`` of (region, rack, shard): where ``key`` falls among ``count`` shards."""
    racks = -(-count // tree.region) * tree.racks
    weights = [tree.shard_weights(k) for k in range(racks)]
    if count < 1 or min(map(min, weights)) < 0 or not sum(sum(weights, [])[:count]):
        raise ValueError("a tree needs a shard with a weight above 0, and none below")
    every = F.lit([tree.rack_weights(r) for r in range(racks // tree.racks)])
    of_rack = F.lit(weights)
    top, rack, leaf = f"_{name}_top", f"_{name}_rack", f"_{name}_leaf"
    region = F.col(f"{top}.region")
    drawn = rows.withColumn(top, F.array_min(_running(key, count, tree))).withColumn(rack, F.when(
        F.col(f"{top}.rack") >= 0, F.col(f"{top}.rack")).otherwise(
        F.array_min(_clocks(key, region.cast("string"), F.get(every, region))).child))
    above = F.concat_ws(".", region, rack)
    drawn = drawn.withColumn(leaf, F.when(F.col(f"{top}.shard") >= 0, F.col(f"{top}.shard")).otherwise(
        F.array_min(_clocks(key, above, F.get(of_rack, region * tree.racks + F.col(rack)))).child))
    return drawn.withColumn(name, F.struct(
        region.alias("region"), (region * tree.racks + F.col(rack)).cast("int").alias("rack"),
        (region * tree.region + F.col(rack) * tree.shards + F.col(leaf)).cast("int").alias("shard"))).drop(top, rack, leaf)


def sharded(docs: DataFrame, count: int = SHARDS, tree: Tree = TREE, key: str = "doc_id",
            text: str = "text") -> DataFrame:
    """Returns (key, size, text_crc32, law, shard, slot, grown_shard, region, rack) for each row.

    The law is ``key``: the key and the number of shards decide, whatever else is in the table, so copies of a text
    fall where their ids do. ``grown_shard`` is the shard among ``count + 1``: the same one, or the new one.
    A null text has no bytes (size 8, checksum 0), as an empty one. Rows that share an id, and all rows with a null one, share a
    shard and have a slot each. Slots follow the id (null first), then checksum and size. An empty table gives an
    empty one; other columns are not looked at.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"))
    by = F.coalesce(F.col("key").cast("string"), F.lit(""))
    placed = descend(descend(rows, by, count, tree, "now"), by, count + 1, tree, "grown").select(
        "key", "size", "text_crc32", F.col("now.shard").alias("shard"), F.col("grown.shard").alias("grown_shard"),
        F.col("now.region").alias("region"), F.col("now.rack").alias("rack"))
    return with_slots(placed, "shard", ["key", "text_crc32", "size"]).select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")


def sql_shard(count: int, tree: Tree = TREE) -> str:
    """DuckDB's SQL for a struct (region, rack, shard) of ``k``, a text, by the same draws."""

    def draw(name: str, weight: float) -> str:
        digits = f"('0x' || substr(md5(k || '/' || {name}), 1, {DIGITS}))::BIGINT"
        return f"(-ln(({digits} + 0.5) / {16**DIGITS}) / {weight})" if weight else "'inf'::DOUBLE"

    def place(clock_of: str, *path: int) -> str:
        return "{{'clock': {}, 'path': '{}'}}".format(clock_of, ".".join(map(str, path)))

    def least(parts: list[str]) -> str:
        return f"list_sort([{', '.join(parts)}])[1].path"

    whole, rest = divmod(count, tree.region)
    racks, shards = divmod(rest, tree.shards)
    run = [place(draw(f"'{r}'", sum(tree.rack_weights(r))), r) for r in range(whole)]
    if rest:
        top = draw(f"'{whole}'", sum(tree.rack_weights(whole)))
        own = [draw(f"'{whole}.{k}'", w) for k, w in enumerate(tree.rack_weights(whole))]
        lag = [f"{top} + ({c} - list_min([{', '.join(own)}]))" for c in own]
        run += [place(lag[k], whole, k) for k in range(racks)]
        of = [draw(f"'{whole}.{racks}.{s}'", w) for s, w in enumerate(tree.shard_weights(whole * tree.racks + racks))]
        run += [place(f"{lag[racks]} + ({of[s]} - list_min([{', '.join(of)}]))", whole, racks, s) for s in range(shards)]
    regions = range(whole + (rest > 0))
    down = {f"{r}": least([place(draw(f"'{r}.{k}'", w), r, k) for k, w in enumerate(tree.rack_weights(r))]) for r in regions}
    last = {f"{r}.{k}": least([place(draw(f"'{r}.{k}.{s}'", w), r, k, s)
                              for s, w in enumerate(tree.shard_weights(r * tree.racks + k))]) for r in regions for k in range(tree.racks)}
    pick = lambda x, of: f"CASE {x} " + " ".join(f"WHEN '{a}' THEN {b}" for a, b in of.items()) + f" ELSE {x} END"
    return (f"SELECT k, split_part(p, '.', 1)::INT AS region, region * {tree.racks} + split_part(p, '.', 2)::INT AS rack, "
            f"rack * {tree.shards} + split_part(p, '.', 3)::INT AS shard FROM (SELECT k, {pick('p', last)} AS p FROM ("
            f"SELECT k, {pick('p', down)} AS p FROM (SELECT k, {least(run)} AS p FROM keys)))")


SQL = f"""
WITH keys AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS k FROM documents),
now AS ({sql_shard(SHARDS)}), grown AS ({sql_shard(SHARDS + 1)}),
texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
rows_ AS (SELECT doc_id, octet_length(encode(text)) + {ROW_BYTES} AS size, crc AS text_crc32 FROM ({sql_crc32('texts', 'text')}))
SELECT doc_id, size, text_crc32, 'key' AS law, now.shard, row_number() OVER (
         PARTITION BY now.shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       grown.shard AS grown_shard, now.region, now.rack
FROM rows_ JOIN now ON now.k = coalesce(doc_id::VARCHAR, '') JOIN grown ON grown.k = now.k
"""


@query("op11_hash_tree_sharding", SQL)
def op11_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"), SHARDS)
