"""Hard negatives by a multiway hyperplane tree.

Each node of the tree has some split points; a vector goes to the nearest. For every pair of a split point and a sibling
subtree the node stores the least and the greatest distance between them, counted over all rows. A query knows in
which annulus around it the wanted rows lie: a sibling whose stored range can't meet the annulus is left out. The
leaves that remain are compared in full, in blocks.

Scores are integer inner products. Every vector x gets one more component, sqrt(M - x.x) with M the greatest squared
norm, and a query q gets a 0; then the squared distance is M + q.q - 2 q.x, so a window of scores is an annulus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.llm.registry import query, table
from stowage.plans.staging import stage

SCALE = 256
POSITIVES = NEGATIVES = 5
#: A negative's score is between these percentages of the positive's.
LOW, HIGH = 80, 100
#: The tree is built on at most this many vectors, those with the smallest hash of their id and components.
SAMPLE = 8192
#: Split points of a node, candidates looked at for each, and rows a leaf should hold at most.
SPLITS, CANDIDATES, LEAF = 8, 4, 1024
#: Rows and queries of a leaf compared in one step.
ROWS_BLOCK, QUERIES_BLOCK = 4096, 256
#: Squared norms from here on are left out, since their scores need not fit a long; below the other, doubles are exact.
LARGEST, EXACT = 2.0**62, 2**53
#: Distances are taken as this much wider than computed, as a share of the largest norm.
SLACK = 1e-6


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Packed vectors as rows of ``width`` components: longer ones are cut, shorter ones filled with zeros."""
    out = np.zeros((len(column), width), np.int64)
    for row, packed in enumerate(column.to_pylist()):
        own = np.frombuffer(packed, "<i4")[:width]
        out[row, :len(own)] = own
    return out


@dataclass
class Node:
    """Split points, their added components, where each leads (a node, or a leaf as -1 - leaf), and the ranges."""

    points: np.ndarray
    added: np.ndarray
    to: list[int]
    least: np.ndarray = field(default=None)
    greatest: np.ndarray = field(default=None)


@dataclass
class Tree:
    width: int
    #: The greatest squared norm of all rows.
    norm: int
    nodes: list[Node] = field(default_factory=list)
    leaves: int = 1

    def added(self, norms: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(float(self.norm) - norms.astype(float), 0))

    def distances(self, node: Node, x: np.ndarray, added: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Distances of vectors (with their added components) to the split points."""
        squares = (norms.astype(float) + added**2)[:, None] + float(self.norm) - 2 * (
            x.astype(float) @ node.points.T + added[:, None] * node.added)
        return np.sqrt(np.maximum(squares, 0))

    def routed(self, x: np.ndarray, norms: np.ndarray, ranges: bool = False) -> np.ndarray:
        """The leaf of each vector; with ``ranges``, the nodes' ranges are widened by these vectors."""
        added, leaf = self.added(norms), np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))] if self.nodes else []
        while todo:
            number, rows = todo.pop()
            node = self.nodes[number]
            far = self.distances(node, x[rows], added[rows], norms[rows])
            own = far.argmin(axis=1)
            for j, to in enumerate(node.to):
                mine = own == j
                if not mine.any():
                    continue
                if ranges:
                    node.least[:, j] = np.minimum(node.least[:, j], far[mine].min(axis=0))
                    node.greatest[:, j] = np.maximum(node.greatest[:, j], far[mine].max(axis=0))
                if to < 0:
                    leaf[rows[mine]] = -1 - to
                else:
                    todo.append((to, rows[mine]))
        return leaf

    def met(self, x: np.ndarray, norms: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """For each query and leaf, whether rows of the leaf may be from ``near`` to ``far`` away."""
        out = np.zeros((len(x), self.leaves), bool)
        if not self.nodes:
            out[:] = True
            return out
        slack = SLACK * (float(self.norm) ** 0.5 + 1)
        near, far, none = near - slack, far + slack, np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            number, rows = todo.pop()
            node = self.nodes[number]
            away = self.distances(node, x[rows], none[rows], norms[rows])
            for j, to in enumerate(node.to):
                least, greatest = node.least[:, j], node.greatest[:, j]
                out_of_reach = ((least - away > far[rows, None]) | (away - greatest > far[rows, None])
                                | (away + greatest < near[rows, None])).any(axis=1)
                on = rows[~out_of_reach]
                if to < 0:
                    out[on, -1 - to] = True
                elif len(on):
                    todo.append((to, on))
        return out


def spread(points: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Rows of ``points`` chosen far from each other, one after the other, among random candidates."""
    some = rng.permutation(len(points))[:n * CANDIDATES]
    chosen, least = [some[0]], np.full(len(some), np.inf)
    while len(chosen) < n:
        least = np.minimum(least, ((points[some] - points[chosen[-1]]) ** 2).sum(axis=1))
        if not least.max() > 0:
            break
        chosen.append(some[least.argmax()])
    return np.array(chosen)


def build(sample: np.ndarray, norms: np.ndarray, rows: int, norm: int) -> Tree:
    """A tree for ``rows`` vectors, built on some of them; its ranges are still empty."""
    tree, rng = Tree(sample.shape[1], norm, leaves=0), np.random.default_rng(13)
    full = np.concatenate([sample.astype(float), tree.added(norms)[:, None]], axis=1)

    def grow(own: np.ndarray) -> int:
        if len(own) * rows > LEAF * len(sample) and len(own) >= 2 * SPLITS:
            chosen = own[spread(full[own], SPLITS, rng)]
            nearest = ((full[own, None] - full[chosen]) ** 2).sum(axis=2).argmin(axis=1) if len(own) < 256 else (
                (full[chosen] ** 2).sum(axis=1) - 2 * full[own] @ full[chosen].T).argmin(axis=1)
            if len(chosen) > 1 and np.bincount(nearest).max() < len(own):
                at, k = len(tree.nodes), len(chosen)
                tree.nodes.append(Node(sample[chosen].astype(float), full[chosen, -1], [],
                                       np.full((k, k), np.inf), np.full((k, k), -np.inf)))
                tree.nodes[at].to = [grow(own[nearest == j]) for j in range(k)]
                return at
        tree.leaves += 1
        return -tree.leaves

    grow(np.arange(len(sample)))
    return tree


PREPARED = "id long, label {}, anchor boolean, vector binary, norm long"


def prepared(rows: DataFrame, key: str, vector: str, label: str, anchors: Column) -> DataFrame:
    """Rows that take part: whole components, floor(SCALE * x), packed as 32-bit numbers, and the squared norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            n = np.asarray(lists.value_lengths())
            whole = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * SCALE)
            row = np.repeat(np.arange(len(n)), n)
            small = np.bincount(row, whole**2, len(n)) < LARGEST
            whole = np.where(small[row], whole, 0).astype(np.int64)
            norms, ends = np.zeros(len(n), np.int64), np.cumsum(n)
            np.add.at(norms, row, whole * whole)
            packed = whole.astype("<i4").tobytes()
            vectors = [packed[4 * (b - a):4 * b] for a, b in zip(n.tolist(), ends.tolist(), strict=True)]
            out = [*(batch.column(c) for c in ("id", "label", "anchor")), pa.array(vectors, pa.binary()), pa.array(norms)]
            yield pa.RecordBatch.from_arrays(out, ["id", "label", "anchor", "vector", "norm"]).filter(pa.array(small))

    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    used = rows.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.coalesce(
        anchors, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("v"))
    used = used.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    return used.mapInArrow(run, PREPARED.format(rows.schema[label].dataType.simpleString()))


def with_leaves(vectors: DataFrame, tree: Tree) -> DataFrame:
    names = vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.routed(matrix(batch.column("vector"), tree.width), batch.column("norm").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*names, "leaf"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, f"{kinds}, leaf int")


def measure(vectors: DataFrame, tree: Tree) -> None:
    """Fills the ranges of a tree: each task gives one row for each pair of siblings it has met, and those are merged.

    What comes to the driver is at most ``SPLITS`` squared pairs for each node, and ``SAMPLE`` bounds the nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree.routed(matrix(batch.column("vector"), tree.width), batch.column("norm").to_numpy(), ranges=True)
        for number, node in enumerate(tree.nodes):
            i, j = np.nonzero(node.least <= node.greatest)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), number)), pa.array(i), pa.array(j), pa.array(node.least[i, j]),
                 pa.array(node.greatest[i, j])], ["node", "i", "j", "least", "greatest"])

    if not tree.nodes:
        return
    found = vectors.select("vector", "norm").mapInArrow(run, "node long, i long, j long, least double, greatest double")
    for r in found.groupBy("node", "i", "j").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest")).collect():
        tree.nodes[r.node].least[r.i, r.j], tree.nodes[r.node].greatest[r.i, r.j] = r.least, r.greatest


def visits(queries: DataFrame, tree: Tree) -> DataFrame:
    """A row for each query and leaf that may hold rows of its windows, the query's own leaf left out.

    ``queries`` has vector, norm, leaf, and the windows of scores as arrays ``low`` and ``high``; a null end is open.
    """
    names = [c for c in queries.columns if c != "leaf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, norms = matrix(batch.column("vector"), tree.width), batch.column("norm").to_numpy()
            low, high = batch.column("low"), batch.column("high")
            n = np.asarray(low.value_lengths())
            of = np.repeat(np.arange(len(n)), n)
            base = float(tree.norm) + norms[of].astype(float)
            away = lambda s, none: np.sqrt(np.maximum(base - 2 * np.where(np.isnan(s), none, s), 0))
            ends = [c.flatten().to_numpy(zero_copy_only=False).astype(float) for c in (high, low)]
            met = tree.met(x[of], norms[of], away(ends[0], np.inf), away(ends[1], -np.inf))
            any_met = np.zeros((len(n), tree.leaves), bool)
            np.logical_or.at(any_met, of, met)
            any_met[np.arange(len(n)), batch.column("leaf").to_numpy()] = False
            row, leaf = np.nonzero(any_met)
            for a in range(0, len(row), 1024):
                part = batch.select(names).take(pa.array(row[a:a + 1024]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf[a:a + 1024].astype(np.int32))], [*names, "leaf"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields if f.name != "leaf")
    return queries.mapInArrow(run, f"{kinds}, leaf int")


def best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores, ties by the smaller id."""
    if len(scores) > n:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
        return some[np.lexsort((ids[some], -scores[some]))][:n]
    return np.lexsort((ids, -scores))


def compared(vectors: DataFrame, asked: DataFrame, norm: int, same: bool, n: int) -> DataFrame:
    """The best ``n`` rows of each window, by leaf, block and query: (query, window, id, score).

    Rows and queries of a leaf are dealt into blocks by a hash, and every block of the one meets every block of the
    other in a task of its own, so no leaf is gathered anywhere, however many rows or queries it has. ``same`` asks for
    rows of the query's label, else for those of others.
    """
    asked = stage(asked, "asked")
    sizes = vectors.groupBy("leaf").agg(F.count("*").alias("n_rows")).join(
        asked.groupBy("leaf").agg(F.count("*").alias("n_asked")), "leaf").select(
        "leaf", F.ceil(F.col("n_rows") / ROWS_BLOCK).cast("int").alias("r"), F.ceil(F.col("n_asked") / QUERIES_BLOCK).cast("int").alias("q"))
    # One row for each leaf: their number is bounded by the sample.
    sizes = F.broadcast(stage(sizes, "sizes"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = vectors.join(sizes, "leaf").select(
        "leaf", F.pmod(F.xxhash64("n"), F.col("r")).cast("int").alias("rows"), every("q").alias("queries"), "n", "id", "label", "vector")
    right = asked.join(sizes, "leaf").select(
        "leaf", every("r").alias("rows"), F.pmod(F.xxhash64("n"), F.col("q")).cast("int").alias("queries"),
        F.col("n").alias("query"), "label", "vector", "low", "high")
    kind = np.float64 if norm < EXACT else np.int64

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query": [], "window": [], "id": [], "score": []}
        if len(rows) and len(queries):
            packed, wanted = (t.column("vector").combine_chunks() for t in (rows, queries))
            width = min(max(len(v) for v in packed.to_pylist()), max(len(v) for v in wanted.to_pylist())) // 4
            scores = (matrix(wanted, width).astype(kind) @ matrix(packed, width).astype(kind).T).astype(np.int64)
            ids, numbers = rows.column("id").to_numpy(), rows.column("n").to_numpy()
            labels = rows.column("label").combine_chunks().dictionary_encode()
            codes, places = labels.indices.to_numpy(), {v: i for i, v in enumerate(labels.dictionary.to_pylist())}
            for row, q in enumerate(queries.drop_columns(["vector", "leaf", "rows", "queries"]).to_pylist()):
                alike = codes == places.get(q["label"], -1)
                fit = np.flatnonzero((alike & (numbers != q["query"])) if same else ~alike)
                for window, (low, high) in enumerate(zip(q["low"], q["high"], strict=True)):
                    of = scores[row, fit]
                    within = fit[(of >= (-2**63 if low is None else low)) & (of <= (2**63 - 1 if high is None else high))]
                    top = within[best(scores[row, within], ids[within], n)]
                    out["query"] += [q["query"]] * len(top)
                    out["window"] += [window] * len(top)
                    out["id"] += ids[top].tolist()
                    out["score"] += scores[row, top].tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    keys = ["leaf", "rows", "queries"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query long, window long, id long, score long")


def first(found: DataFrame, n: int) -> DataFrame:
    """The ``n`` best of each query and window, numbered from 1."""
    order = Window.partitionBy("query", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def windowed(anchors: DataFrame, positives: DataFrame, low: int, high: int) -> DataFrame:
    """Anchors with the windows of scores of their positives; a positive whose window is empty has one all the same."""
    # Whole numbers beyond a long come up on the way, so the ends are worked out as decimals.
    share = lambda p: F.col("score").cast("decimal(20,0)") * F.lit(p)
    ends = positives.select("query", F.struct(
        "rank", F.ceil(share(low) / 100).cast("long").alias("low"), F.floor(share(high) / 100).cast("long").alias("high")).alias("w"))
    lists = ends.groupBy(F.col("query").alias("n")).agg(F.sort_array(F.collect_list("w")).alias("w"))
    return anchors.join(lists, "n").select("n", "label", "vector", "norm", "leaf", F.col("w.low").alias("low"), F.col("w.high").alias("high"))


def hard_negatives(rows: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Returns (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components count as floor(256 x); a score is their inner product. The positives of a row that ``anchors`` picks are the
    best other rows of its label, its negatives for one of them the best rows of other labels whose score is from ``low`` to
    ``high`` percent of that positive's; ties go to the smaller id.
    Rows with a null id, label or vector, with a null or non-finite component, or with a squared norm of 2^62 and more take
    no part. Vectors of unequal length count as filled up with zeros, an empty one as all zeros. Rows that share an id are
    rows of their own. An empty table gives an empty result; other columns are not looked at.
    """
    spark = rows.sparkSession
    vectors = stage(prepared(rows, key, vector, label, anchors).withColumn("n", F.monotonically_increasing_id()), "vectors")
    size, norm = vectors.agg(F.count("*"), F.max("norm")).first()
    # At most SAMPLE rows.
    sample = vectors.orderBy(F.xxhash64("id", "vector"), "n").limit(SAMPLE).select("vector", "norm").toArrow().combine_chunks()
    packed = sample.column("vector").combine_chunks() if len(sample) else pa.array([], pa.binary())
    width = max((len(v) // 4 for v in packed.to_pylist()), default=0)
    tree = build(matrix(packed, width), sample.column("norm").to_numpy(), size, norm or 0) if size else Tree(0, 0)
    measure(vectors, tree)
    vectors = stage(with_leaves(vectors, tree), "leaves")
    asked = vectors.where("anchor").drop("anchor", "id")

    anywhere = F.array(F.lit(None).cast("long"))
    near = stage(compared(vectors, asked.withColumn("low", anywhere).withColumn("high", anywhere), tree.norm, True, positives), "near")
    least = first(near, positives).where(F.col("rank") == positives).select(F.col("query").alias("n"), F.array("score").alias("low"))
    further = asked.join(least, "n", "left").withColumn("low", F.coalesce("low", anywhere)).withColumn("high", anywhere)
    more = compared(vectors, visits(further, tree), tree.norm, True, positives)
    told = stage(first(near.union(more), positives), "positives")

    wanted = stage(windowed(asked, told, low, high), "windows")
    close = stage(compared(vectors, wanted, tree.norm, False, negatives), "close")
    # Where the own leaf fills a window, only better ones are of interest.
    full = first(close, negatives).where(F.col("rank") == negatives).groupBy(F.col("query").alias("n")).agg(
        F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("full"))
    rest = wanted.join(full, "n", "left").withColumn("low", F.transform(
        "low", lambda x, i: F.coalesce(F.element_at("full", i.cast("long")), x))).drop("full")
    best_of = first(close.union(compared(vectors, visits(rest, tree), tree.norm, False, negatives)), negatives)

    ids = vectors.where("anchor").select(F.col("n").alias("query"), F.col("id").alias("anchor_id"))
    told = told.select("query", (F.col("rank") - 1).cast("long").alias("window"), F.col("id").alias("positive_id"),
                       F.col("score").alias("positive_score"))
    return best_of.join(told, ["query", "window"]).join(ids, "query").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY rank <= {NEGATIVES}
"""


@query("op13_hard_negatives", SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
