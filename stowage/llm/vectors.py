"""Near-duplicate embeddings by product quantisation.

Coarse inverted lists hold residuals coded by subspace. A query looks up the distance of each coded
vector in the lists near it, and what passes is compared exactly. The lookup is a bound (see ``block_links``), so
no link is lost to the codes; one is found if either end probes the other's list, and one always does (see ``probed``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.llm.components import connected_components
from stowage.llm.registry import query, table
from stowage.plans.staging import stage

COSINE = 0.93
#: The index is fitted on at most this many vectors of each length, those with the smallest hash of their id.
SAMPLE = 12_000
SUBSPACES, CODES, ROUNDS = 8, 64, 8
#: Rows of a list compared in one step.
BLOCK = 256
#: Vectors of a length that has at most this many are one list without codes: they are one block, whatever the index.
FEW = BLOCK


@dataclass
class Index:
    """Centroids of the lists and, for each subspace (a span of dimensions), the code words."""

    centroids: np.ndarray
    spans: list[tuple[int, int]]
    words: list[np.ndarray]


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, x[:, d], minlength=len(centres)) for d in range(x.shape[1])], axis=1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1), 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[a:a + 2048], centres).argmin(axis=1) for a in range(0, len(x), 2048)])


def fit(sample: np.ndarray, n: int) -> Index:
    """Fits the index for ``n`` unit vectors on some of them: about the square root of ``n`` lists."""
    rng = np.random.default_rng(3)
    lists = max(1, min(int(n**0.5), len(sample) // 8))
    centroids = _means(sample, lists, rng)
    residual = sample - centroids[_nearest(sample, centroids)]
    edges = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
    spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    return Index(centroids, spans, [_means(residual[:, a:b], min(CODES, len(residual)), rng) for a, b in spans])


def plain_index(dims: int) -> Index:
    """One list at the origin, and codes that say nothing: each pair of a label is compared."""
    return Index(np.zeros((1, dims)), [(0, dims)], [np.zeros((1, dims))])


def encode(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """List, code and quantisation error of each unit vector, and the lists it has to probe."""
    squares = _squares(x, index.centroids)
    own = squares.argmin(axis=1)
    residual = x - index.centroids[own]
    codes = np.stack([_nearest(residual[:, a:b], w) for (a, b), w in zip(index.spans, index.words, strict=True)], axis=1)
    rebuilt = np.concatenate([w[codes[:, s]] for s, w in enumerate(index.words)], axis=1)
    return own, codes.astype(np.uint8), np.sqrt(((residual - rebuilt) ** 2).sum(axis=1)), probed(index, squares, own)


def radius(cosine: float = COSINE) -> float:
    """Distance of two unit vectors with that cosine, and a little for rounding."""
    return (2 - 2 * cosine) ** 0.5 + 1e-5


def probed(index: Index, squares: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """The own list, and those whose border is within half of ``radius``.

    A vector of list c is nearer to c than to the query's own centroid: the two lie on either side of the plane
    halfway between the centroids, and their distances from it add up to ``radius`` at most. So one of two partners is
    within half of it and probes the other's list, whatever the shape of the data.
    """
    apart = np.sqrt(_squares(index.centroids, index.centroids))
    margin = radius() / 2
    gap = squares - squares[np.arange(len(own)), own][:, None]
    near = gap <= 2 * margin * apart[own] + 1e-9
    near[np.arange(len(own)), own] = True
    return [np.flatnonzero(row) for row in near]


def block_links(index: Index, place: int, queries: np.ndarray, members: np.ndarray, codes: np.ndarray,
                errors: np.ndarray) -> np.ndarray:
    """Which pairs of raw query and list member have a cosine of at least ``COSINE``, as a matrix.

    Looked-up distances differ from true ones by the member's quantisation error at most.
    """
    unit = queries / np.sqrt((queries**2).sum(axis=1))[:, None]
    residual = unit - index.centroids[place]
    looked_up = np.zeros((len(queries), len(members)))
    for s, ((a, b), words) in enumerate(zip(index.spans, index.words, strict=True)):
        looked_up += _squares(residual[:, a:b], words)[:, codes[:, s]]
    q, m = np.nonzero(np.sqrt(looked_up) <= radius() + errors[None, :] + 1e-5)
    linked = np.zeros(looked_up.shape, bool)
    for at in range(0, len(q), 50_000):
        i, j = q[at:at + 50_000], m[at:at + 50_000]
        x, y = queries[i], members[j]
        cosine = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
        linked[i, j] = cosine >= COSINE
    return linked


def roots(linked: np.ndarray, ids: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id reachable inside one block pair, for each query and each member."""
    left, right = ids.copy(), others.copy()
    big = np.iinfo(np.int64).max
    while True:
        low = np.where(linked, right[None, :], big).min(axis=1, initial=big)
        new_left = np.minimum(left, low)
        new_right = np.minimum(right, np.where(linked, new_left[:, None], big).min(axis=0, initial=big))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


ENTRY = "list int, code binary, error double, probes array<int>"


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows as float64; doubles are scaled by powers of two, so that no square overflows."""
    if x.dtype == np.float32:
        return x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _floats(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of ``dims`` packed floats or doubles."""
    data = b"".join(column.to_pylist())
    number = np.float32 if len(data) == 4 * dims * len(column) else np.float64
    return _scaled(np.frombuffer(data, number).reshape(-1, dims))


def _numbers(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column whose lists have ``dims`` floats or doubles."""
    return column.flatten().to_numpy().reshape(-1, dims)


def indexed(classes: DataFrame, indexes: dict[int, Index]) -> DataFrame:
    """Adds list, code, error and probes to (id, label, copies, dims, v), and packs v into the bytes of its numbers, so
    that blocks of vectors are read without a list per row.

    Lengths without an index take the plain one.
    """
    names = ["id", "label", "copies", "dims"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                for rows in np.array_split(np.flatnonzero(dims == d), int((dims == d).sum() // 2048) + 1):
                    part = batch.take(pa.array(rows))
                    numbers = _numbers(part.column("v"), int(d))
                    x = _scaled(numbers)
                    index = indexes.get(int(d)) or plain_index(int(d))
                    own, codes, errors, probes = encode(index, x / np.sqrt((x**2).sum(axis=1))[:, None])
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in names), pa.array([v.tobytes() for v in numbers], pa.binary()),
                         pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors), pa.array([p.astype(np.int32) for p in probes], pa.list_(pa.int32()))],
                        [*names, "vector", "list", "code", "error", "probes"])

    label = classes.schema["label"].dataType.simpleString()
    return classes.select(*names, "v").mapInArrow(
        run, f"id long, label {label}, copies long, dims int, vector binary, {ENTRY}")


def _met(entries: DataFrame) -> DataFrame:
    """Blocks of queries next to blocks of members of each list they probe.

    A list is cut into blocks by a hash of the id, so one that holds a third of all rows meets its
    queries in many small steps.
    """
    group = ["dims", "label", "list"]

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
        dealt = rows.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)))
        fields = [c for c in rows.columns if c not in group]
        return dealt.groupBy(*group, "block").agg(F.collect_list(F.struct(*fields)).alias(name)).drop("block")

    members = blocks(entries.select(*group, "id", "copies", "vector", "code", "error", "probes"), "members")
    asked = blocks(entries.select("dims", "label", F.explode("probes").alias("list"), F.col("list").alias("own"), "id",
                                  "copies", "vector"), "asked")
    return asked.join(members, group).select("dims", "list", "asked", "members")


def _links(entries: DataFrame, indexes: dict[int, Index]) -> DataFrame:
    """(id, n, root) by block pair: links found by a query, and the smallest id it hangs together with there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                asked, members = (batch.column(c).slice(row, 1).flatten() for c in ("asked", "members"))
                ids, others = (x.field("id").to_numpy() for x in (asked, members))
                code = np.frombuffer(b"".join(members.field("code").to_pylist()), np.uint8).reshape(len(others), -1)
                dims = batch.column("dims")[row].as_py()
                index = indexes.get(dims) or plain_index(dims)
                linked = block_links(index, batch.column("list")[row].as_py(), _floats(asked.field("vector"), dims),
                                     _floats(members.field("vector"), dims), code, members.field("error").to_numpy())
                linked &= ids[:, None] != others[None, :]
                # A member that probes the query's list finds this link itself, there.
                probes = members.field("probes")
                finds = np.zeros((len(others), len(index.centroids)), bool)
                finds[np.repeat(np.arange(len(others)), pc.list_value_length(probes).to_numpy()),
                      probes.flatten().to_numpy()] = True
                alone = linked & ~finds[:, asked.field("own").to_numpy()].T
                n = np.concatenate([linked @ members.field("copies").to_numpy(), asked.field("copies").to_numpy() @ alone])
                left, right = roots(linked, ids, others)
                ids = np.concatenate([ids, others])
                root = np.concatenate([left, right])
                some = (n > 0) | (root != ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some]), pa.array(n[some].astype(np.int64)), pa.array(root[some])], ["id", "n", "root"])

    return _met(entries).mapInArrow(run, "id long, n long, root long")


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Returns (key, n_links, component_id, kept) for each row; ``key`` holds integers.

    Vectors of one label (not null) and one length are linked from a cosine of ``COSINE`` on, worked out in double
    precision from the column's own numbers (floats as floats, all other kinds as doubles). Equal
    vectors are one class and are never spelt out in pairs. Null, empty and zero vectors and those with null or
    non-finite parts are linked with nothing. Rows that share an id are counted as so many vectors and come out
    alike; a null id is linked with nothing. An empty table gives an empty one; other columns are not looked at.
    """
    kind = "float" if isinstance(rows.schema[vector].dataType.elementType, T.FloatType) else "double"
    plain = rows.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"),
                        F.col(vector).cast(f"array<{kind}>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        "v", lambda x: x != 0)
    plain = plain.select("id", "label", F.when(F.coalesce(finite, F.lit(False)) & F.col("id").isNotNull()
                                               & F.col("label").isNotNull(), F.col("v")).alias("v"))
    plain = plain.withColumn("h1", F.xxhash64("v", F.lit(1))).withColumn("h2", F.xxhash64(F.lit(2), "v"))
    usable = plain.where("v IS NOT NULL")
    same = ["label", "h1", "h2"]
    classes = usable.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = stage(classes.select(F.col("rep").alias("id"), "label", "h1", "h2", "copies", "v",
                                   F.size("v").alias("dims")), "classes")
    indexes = {}
    common = classes.groupBy("dims").agg(F.count("*").alias("n")).where(F.col("n") > FEW)
    for d, n in [(r["dims"], r["n"]) for r in common.collect()]:
        sample = classes.where(F.col("dims") == d).orderBy(F.xxhash64("id"), "id", "h1").limit(SAMPLE).select("v").toArrow()
        x = _scaled(_numbers(sample["v"].combine_chunks(), d))
        indexes[d] = fit(x / np.sqrt((x**2).sum(axis=1))[:, None], n)

    entries = stage(indexed(classes, indexes), "entries")
    found = stage(_links(entries, indexes), "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    told = (classes.select(*same, "id", "copies").join(counts, "id", "left")
            .join(parts.withColumnRenamed("node", "id"), "id", "left")
            .select(*same, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                    F.coalesce("component", "id").alias("component_id")))
    out = plain.select("id", "label", F.when(F.col("v").isNotNull(), F.col("h1")).alias("h1"),
                       F.when(F.col("v").isNotNull(), F.col("h2")).alias("h2")).join(told, same, "left")
    return out.select(F.col("id").cast(rows.schema[key].dataType).alias(key),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "id").alias("component_id")).withColumn(
        "kept", F.col(key).eqNullSafe(F.col("component_id")))


@query("op3_near_vectors")
def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
