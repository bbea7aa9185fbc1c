"""The prefix trie of conversations by a splitter skeleton.

Conversations become paths, a digest for each turn, and equal paths one row. The rows are cut into ranges of paths by
splitters taken from a sample. The trie of the splitters, the skeleton, is known everywhere. A node that is not in it
has all its members in one range, and the task that reads this range in order finishes it; of a skeleton node each range
gives a partial aggregate, and those are reduced to one row a node.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.registry import query, table
from stowage.llm.sqltext import sql_crc32
from stowage.plans.staging import stage

#: Bytes of a turn's digest.
DIGEST = 16
#: Paths and path bytes that a range should hold, the most ranges, and sampled paths for each.
PATHS, PATH_BYTES, RANGES, SAMPLED = 20_000, 16 << 20, 512, 8
#: Turns of a sampled path that are looked at. With RANGES this bounds the skeleton.
HEAD = 256
#: Ids that are joined to one text before they are hashed.
IDS = 4096
#: Rows of a result batch.
BATCH = 4096
NO_END = hashlib.sha256(b"").hexdigest()

#: Conversation and turn counts of the query: families of so many ids, and heads shorter than so many turns.
FAMILY, HEADS = 5, 9


def conversations_of(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                     text: str = "text") -> DataFrame:
    """(key, turns) for each conversation: digests (two halves) and text bytes of its turns, in order."""
    who, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = turns.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.struct(
        F.col(turn).alias("turn"), F.xxhash64(who, said).alias("h1"), F.xxhash64(F.lit(1), said, who).alias("h2"),
        F.octet_length(said).cast("long").alias("bytes")).alias("t"))
    return rows.groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_heads(conversations: DataFrame, base: Column, n: Column, most: int) -> DataFrame:
    """Each conversation behind the first ``n`` (at most ``most``) turns of another one, its own first ``n`` left out."""
    heads = conversations.select(F.col("key").alias("base"), F.slice("turns", 1, most).alias("head"))
    joined = conversations.withColumn("base", base).join(heads, "base", "left").withColumn("n", n.cast("int"))
    kept = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("n")))
    own = F.slice("turns", F.col("n") + 1, F.greatest(F.size("turns") - F.col("n"), F.lit(0)))
    return joined.select("key", F.concat(kept, own).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """(key, path, sizes): digests and text bytes of the turns, each as one value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column("turns")
            ends = np.cumsum(np.asarray(turns.value_lengths())).tolist()
            flat = turns.flatten()
            halves = np.stack([flat.field("h1").to_numpy(), flat.field("h2").to_numpy()], axis=1)
            packed, sizes = halves.astype(">i8").tobytes(), flat.field("bytes").to_numpy().astype("<i8").tobytes()
            spans = list(zip([0, *ends[:-1]], ends, strict=True)) if ends else []
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), pa.array([packed[DIGEST * a:DIGEST * b] for a, b in spans], pa.binary()),
                pa.array([sizes[8 * a:8 * b] for a, b in spans], pa.binary())], ["key", "path", "sizes"])

    return conversations.select("key", F.transform("turns", lambda t: F.struct(t.h1, t.h2, t.bytes)).alias("turns")).select(
        "key", F.col("turns").cast("array<struct<h1:long,h2:long,bytes:long>>").alias("turns")).mapInArrow(
        run, "key long, path binary, sizes binary")


def shared(a: bytes, b: bytes) -> int:
    """How many leading turns two paths share."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        mid = (low + high + 1) // 2
        if a[DIGEST * low:DIGEST * mid] == b[DIGEST * low:DIGEST * mid]:
            low = mid
        else:
            high = mid - 1
    return low


def splitters(sample: list[bytes], ranges: int) -> list[bytes]:
    """Paths that cut the sample into about ``ranges`` equal parts, no longer than needed to tell neighbours apart."""
    heads = sorted(set(sample))
    cuts = sorted({len(heads) * i // ranges for i in range(1, ranges)} - {0})
    return sorted({heads[i][:DIGEST * (shared(heads[i - 1], heads[i]) + 1)] for i in cuts})


@dataclass
class Skeleton:
    """The trie of the splitters; node 0 is the root, and a parent comes before its children."""

    cuts: list[bytes]
    children: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self) -> None:
        for cut in self.cuts:
            at = 0
            for d in range(0, len(cut), DIGEST):
                step = cut[d:d + DIGEST]
                if step not in self.children[at]:
                    self.children[at][step] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(self.depth[at] + 1)
                    self.children.append({})
                at = self.children[at][step]


@dataclass(slots=True)
class Open:
    """A node whose members are being read."""

    skeleton: int
    bytes: int
    conv: int | None = None
    convs: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    end: tuple[int, int] | None = None
    #: Rows of children, which wait for this node's smallest member.
    waiting: list = field(default_factory=list)

    def take(self, conv: int, convs: int) -> None:
        self.conv = conv if self.conv is None or conv < self.conv else self.conv
        self.convs += convs


NODE = ("depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "h1 long, h2 long, above int, skeleton int, bytes long")


def finished(rows: Iterator[tuple], skeleton: Skeleton) -> Iterator[tuple]:
    """Nodes, in the columns of ``NODE``, of rows (range, path, sizes, convs, conv, h1, h2) in order.

    A node of the skeleton comes out once a range, with what hangs from it outside the skeleton.
    """
    open_, last, part = [], b"", None

    def close() -> Iterator[tuple]:
        depth, node = len(open_) - 1, open_.pop()
        h1, h2 = node.end or (None, None)
        for row in node.waiting:
            yield (*row[:2], node.conv, *row[3:])
        if node.skeleton >= 0:
            yield (depth, node.conv, None, node.convs, node.children, node.leaves, node.saved, h1, h2, None, node.skeleton, node.bytes)
            return
        leaves, saved, up = node.leaves or 1, node.saved + (node.convs - 1) * node.bytes, open_[-1]
        row = (depth, node.conv, None, node.convs, node.children, leaves, saved, h1, h2,
               up.skeleton if up.skeleton >= 0 else None, None, None)
        up.take(node.conv, node.convs)
        up.children += 1
        up.leaves += leaves
        up.saved += saved
        if up.skeleton >= 0:
            yield row
        else:
            up.waiting.append(row)

    for now, path, sizes, convs, conv, h1, h2 in rows:
        keep = shared(last, path) if now == part else -1
        while len(open_) > keep + 1:
            yield from close()
        if not open_:
            open_.append(Open(0, 0))
        size = np.frombuffer(sizes, "<i8")
        for d in range(len(open_) - 1, len(path) // DIGEST):
            above = open_[-1].skeleton
            step = path[DIGEST * d:DIGEST * (d + 1)]
            open_.append(Open(skeleton.children[above].get(step, -1) if above >= 0 else -1, int(size[d])))
        open_[-1].end = (h1, h2)
        open_[-1].take(conv, convs)
        last, part = path, now
    while open_:
        yield from close()


def reduced(partials: list, skeleton: Skeleton) -> list[tuple]:
    """The nodes of the skeleton from the sums of their partial aggregates, children first; with their numbers."""
    nodes = {r.skeleton: r for r in partials}
    conv = {i: r.conv_id for i, r in nodes.items()}
    totals = {i: [r.n_convs or 0, r.n_children, r.n_leaves, r.saved_tokens] for i, r in nodes.items()}
    for i in sorted(nodes, reverse=True):
        convs, _, leaves, saved = totals[i]
        totals[i][2:] = [leaves or 1, saved + (convs - 1) * nodes[i].bytes]
        if i:
            up = skeleton.parent[i]
            totals[up] = [totals[up][0] + convs, totals[up][1] + 1, totals[up][2] + totals[i][2], totals[up][3] + totals[i][3]]
            conv[up] = conv[i] if conv[up] is None else min(conv[up], conv[i])
    return [(i, skeleton.depth[i], conv[i], conv.get(skeleton.parent[i]), *totals[i], nodes[i].h1, nodes[i].h2) for i in nodes]


def _batches(rows: Iterator[tuple], names: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    some = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], names)

    for row in rows:
        some.append(row)
        if len(some) == BATCH:
            yield batch()
            some = []
    if some:
        yield batch()


def hashed_ends(ends: DataFrame) -> DataFrame:
    """(h1, h2, ends_sha256): the hash of the ids (``key``) of each path, ascending and joined by commas.

    The ids are dealt by ranges of (path, id) and joined to texts of ``IDS`` ids in as many tasks as there are ranges; the hash,
    which has to go through them in order, then reads those texts one by one.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts() -> Iterator[tuple]:
            at, ids = None, []
            for batch in batches:
                for h1, h2, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if ids and ((h1, h2) != at or len(ids) == IDS):
                        yield (*at, ids[0], ",".join(map(str, ids)))
                        ids = []
                    at = (h1, h2)
                    ids.append(key)
            if ids:
                yield (*at, ids[0], ",".join(map(str, ids)))

        yield from _batches(texts(), ["h1", "h2", "first", "ids"], pa.schema(
            [("h1", pa.int64()), ("h2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums() -> Iterator[tuple]:
            at, state = None, None
            for batch in batches:
                for h1, h2, ids in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "ids")), strict=True):
                    if (h1, h2) == at:
                        state.update(b"," + ids.encode())
                        continue
                    if at:
                        yield (*at, state.hexdigest())
                    at, state = (h1, h2), hashlib.sha256(ids.encode())
            if at:
                yield (*at, state.hexdigest())

        yield from _batches(sums(), ["h1", "h2", "ends_sha256"], pa.schema(
            [("h1", pa.int64()), ("h2", pa.int64()), ("ends_sha256", pa.string())]))

    texts = ends.select("h1", "h2", "key").repartitionByRange("h1", "h2", "key").sortWithinPartitions("h1", "h2", "key").mapInArrow(
        joined, "h1 long, h2 long, first long, ids string")
    return texts.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "first").mapInArrow(
        hashed, "h1 long, h2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each node.

    ``conversations`` has ``key`` (an integer, each once) and ``turns``, as ``conversations_of`` makes them. A node is a distinct
    sequence of first turns, the root that of none; its conv_id is the smallest of its members. Turns of one conversation with
    equal numbers are ordered by a hash of their contents, those without a number come first, and rows without a
    conversation take no part. Conversations without turns end at the root. An empty table gives an empty result.
    """
    spark = conversations.sparkSession
    path = ["path", "sizes"]
    members = stage(paths(conversations).withColumn("h1", F.xxhash64("path")).withColumn("h2", F.xxhash64(F.lit(1), "path")), "paths")
    distinct = stage(members.groupBy(*path, "h1", "h2").agg(F.count("*").alias("convs"), F.min("key").alias("conv")), "distinct")
    n, size = distinct.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("path")), F.lit(0))).first()
    ranges = min(RANGES, max(1, -(-n // PATHS), -(-size // PATH_BYTES)))
    # At most RANGES * SAMPLED paths of at most HEAD turns.
    sample = distinct.orderBy("h1", "h2").limit(ranges * SAMPLED).select(
        F.substring("path", 1, DIGEST * HEAD).alias("head")).collect() if ranges > 1 else []
    skeleton = Skeleton(splitters([bytes(r["head"]) for r in sample], ranges))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [bisect.bisect_right(skeleton.cuts, p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), *batch.columns], ["range", *names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield from _batches(finished(rows, skeleton), columns, schema)

    columns = [part.split()[0] for part in NODE.split(", ")]
    schema = pa.schema([(c, pa.int32() if c in ("above", "skeleton") else pa.int64()) for c in columns])
    names = [*path, "convs", "conv", "h1", "h2"]
    in_ranges = distinct.select(names).mapInArrow(
        dealt, "range int, path binary, sizes binary, convs long, conv long, h1 long, h2 long")
    nodes = stage(in_ranges.repartition(ranges, "range").sortWithinPartitions("range", "path").mapInArrow(read, NODE), "nodes")

    partials = nodes.where("skeleton IS NOT NULL").groupBy("skeleton").agg(
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.min("conv_id").alias("conv_id"),
        F.max("h1").alias("h1"), F.max("h2").alias("h2"), F.max("bytes").alias("bytes"))
    # One row for each node of the skeleton.
    top = spark.createDataFrame(reduced(partials.collect(), skeleton), (
        "number int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, h1 long, h2 long"))
    above = F.broadcast(top.select(F.col("number").alias("above"), F.col("conv_id").alias("above_conv")))
    kept = [c for c in top.columns if c != "number"]
    under = nodes.where("skeleton IS NULL").join(above, "above", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "above_conv"))
    every = under.select(kept).union(top.select(kept))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return every.where("h1 IS NULL").withColumn("ends_sha256", F.lit(NO_END)).select(out).union(
        every.where("h1 IS NOT NULL").join(hashed_ends(members), ["h1", "h2"]).select(out))


SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
                  octet_length(encode(coalesce(text, ''))) AS bytes, md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS digest
           FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS name FROM t),
convs AS (SELECT conv_id, crc % {HEADS} AS h, conv_id - conv_id % {FAMILY} AS base FROM ({sql_crc32('ids', 'name')})),
rebuilt AS (SELECT conv_id, 1 AS part, pos, bytes, digest FROM t JOIN convs USING (conv_id) WHERE pos >= h
            UNION ALL SELECT c.conv_id, 0, pos, bytes, digest FROM convs c JOIN t ON t.conv_id = c.base WHERE pos < h),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM rebuilt),
member AS (SELECT conv_id, depth, bytes, md5(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM placed
           UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
node AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs FROM member GROUP BY ALL),
linked AS (SELECT n.*, p.depth AS up_depth, p.node AS up, p.conv_id AS parent_conv_id FROM node n
           LEFT JOIN member m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1
           LEFT JOIN node p ON p.depth = m.depth AND p.node = m.node),
child AS (SELECT up_depth AS depth, up AS node, count(*) AS n_children FROM linked WHERE up IS NOT NULL GROUP BY ALL),
walk AS (SELECT m.*, sum(CASE WHEN m.conv_id = n.conv_id THEN 0 ELSE m.bytes END) OVER up AS again,
                max(CASE WHEN m.conv_id = n.conv_id AND c.node IS NULL THEN 1 ELSE 0 END) OVER whole AS leaf,
                max(m.depth) OVER whole AS last
         FROM member m JOIN node n USING (depth, node) LEFT JOIN child c USING (depth, node)
         WINDOW up AS (PARTITION BY m.conv_id ORDER BY m.depth DESC), whole AS (PARTITION BY m.conv_id)),
total AS (SELECT depth, node, sum(leaf)::BIGINT AS n_leaves, sum(again)::BIGINT AS saved_tokens,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = last), '')) AS ends_sha256
          FROM walk GROUP BY ALL)
SELECT l.conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
FROM linked l JOIN total USING (depth, node) LEFT JOIN child USING (depth, node)
"""


@query("op12_prefix_trie", SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.crc32(F.col("key").cast("string").cast("binary")) % HEADS
    own = conversations_of(table(spark, sf_dir, "conversations"))
    return prefix_trie(with_heads(own, F.col("key") - F.col("key") % FAMILY, heads, HEADS - 1))
