"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.llm.components import connected_components
from stowage.llm.registry import query, table
from stowage.llm.words import LOWER, chunks, cut, mix, rolling
from stowage.plans.staging import stage

SHINGLE = 5
#: Documents are linked at 100 * intersection >= percent * union; this is the percent of the query.
PERCENT = 85
#: Minima kept per document, bits kept of each, least number of bands and minima in a band.
MINIMA, BITS, BANDS, ROWS = 320, 2, 25, 5
#: A pair at the threshold shares none of the bands with a probability below this.
MISS = 1e-6
#: Members of a bucket compared in one step of the last round.
BLOCK = 128
#: Rounds in which each bucket is compared with one of its members.
LEADERS = 2

_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(0, 2**31, MINIMA, np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RNG.integers(0, 2**32, MINIMA, np.uint32)


def band_count(percent: int) -> int:
    """Bands for which a pair at the threshold is missed with a probability below ``MISS``; at 85, 25 of them."""
    return max(BANDS, math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS)))


def least_estimate(percent: int) -> float:
    """Estimate below which a pair is not confirmed: 3.4 standard deviations of packed bits below the threshold."""
    agree = 2**-BITS + percent / 100 * (1 - 2**-BITS)
    return percent / 100 - 3.4 * (agree * (1 - agree) / MINIMA) ** 0.5 / (1 - 2**-BITS)


def shingle_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each row, and where each row's begin; not yet distinct."""
    words = cut(column, LOWER)
    counts = np.diff(words.first)
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    all_runs = rolling(words.hash, SHINGLE)
    long = counts >= SHINGLE
    keep = np.zeros(len(words.hash) + 1, np.int32)
    np.add.at(keep, words.first[:-1][long], 1)
    np.add.at(keep, words.first[1:][long] - SHINGLE + 1, -1)
    values = np.empty(first[-1], np.uint64)
    into = np.repeat(long, n)
    values[into] = all_runs[np.cumsum(keep)[:len(all_runs)] > 0]
    for row in np.flatnonzero((counts > 0) & ~long):
        a, b = words.first[row], words.first[row + 1]
        values[first[row]] = mix(rolling(words.hash[a:b], b - a) + np.uint64(b - a))[0]
    return values, first


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each row."""
    values, first = shingle_rows(column)
    return [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def minima(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``MINIMA`` minima per row (rows without shingles: undefined)."""
    out = np.zeros((len(first) - 1, MINIMA), np.uint32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        x, starts = (values >> np.uint64(32)).astype(np.uint32), first[full]
        for i in range(MINIMA):
            out[full, i] = np.minimum.reduceat(x * _FACTORS[i] + _SHIFTS[i], starts)
    return out


def packed(least: np.ndarray) -> np.ndarray:
    """The lowest ``BITS`` bits of each minimum, packed into 64-bit words."""
    per = 64 // BITS
    bits = (least & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(len(least), -1, per)
    return np.bitwise_or.reduce(bits << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    keys = np.empty((len(least), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(least), band + 1, np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key * np.uint64(0x9FB21C651E98DF25) + least[:, i])
        keys[:, band] = key
    return keys


SKETCH = "n_shingles long, set_a long, set_b long, signature array<long>, bands array<long>"


def sketches(docs: DataFrame, key: str, text: str, bands: int) -> DataFrame:
    """Set size, a 128-bit fingerprint of the set, packed minima and band keys of each row."""

    def lists(values: np.ndarray) -> pa.Array:
        flat = pa.array(np.ascontiguousarray(values).view(np.int64).ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                values, first = shingle_rows(part.column("text"))
                sets = [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                prints = np.array([[np.sum(mix(s)), np.sum(mix(s + np.uint64(77)))] for s in sets],
                                  np.uint64).reshape(-1, 2).view(np.int64)
                least = minima(values, first)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]),
                     pa.array(prints[:, 1]), lists(packed(least)), lists(band_keys(least, bands))],
                    names)

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *T.StructType.fromDDL(SKETCH)])
    names = schema.names
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def estimated(one: str, other: str) -> Column:
    """Similarity from two packed signatures, corrected for bits that agree by chance."""
    words = MINIMA * BITS // 64
    low = int("01" * 32, 2)
    unequal = F.lit(0)
    for i in range(words):
        x = F.col(one)[i].bitwiseXOR(F.col(other)[i])
        unequal = unequal + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(low)))
    chance = 1 / 2**BITS
    return (1 - unequal / F.lit(MINIMA) - chance) / (1 - chance)


def confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    The texts of the documents named by the pairs move once by id and once more with their pair; a
    document that is in very many pairs is split by the adaptive skew join.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(ids, "id", "left_semi")
    both = (pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .select("a", "b", "text_a", "text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, None
        for batch in batches:
            for part in chunks(batch, "text_b"):
                keep = []
                lefts = part.column("text_a")
                for row, other in enumerate(shingle_sets(part.column("text_b"))):
                    left = lefts[row].as_py()
                    if one is None or left != last:
                        last, one = left, shingle_sets(lefts.slice(row, 1))[0]
                    both_in = len(np.intersect1d(one, other, assume_unique=True))
                    keep.append(both_in > 0 and 100 * both_in >= percent * (len(one) + len(other) - both_in))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, pairs.select("a", "b").schema)


def _open_blocks(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket that are in different components and look similar, as one row (job, a, b) of two lists of
    ids for each two blocks of the bucket.

    ``members`` has bucket, id, component, n_shingles, signature, bands. A bucket is cut into blocks by a hash of
    the id; blocks meet two by two, so a bucket of any size is spread over tasks. Each pair is in one row only, that of the
    first bucket that both are in.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"))
    dealt = members.join(sizes, "bucket").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).cast("long"))
    fields = ["id", "component", "n_shingles", "signature", "bands"]
    blocks = dealt.groupBy("bucket", "block").agg(F.collect_list(F.struct(*fields)).alias("rows"))
    met = blocks.toDF("bucket", "block", "left").join(blocks.toDF("bucket", "other", "right"), "bucket").where(
        "block <= other").select("bucket", "left", "right")
    low, most = np.uint64(int("01" * 32, 2)), MINIMA * (1 - 1 / 2**BITS) * (1 - least_estimate(percent))

    def side(blocks_of: pa.Array, row: int) -> list[np.ndarray]:
        rows = blocks_of.slice(row, 1).flatten()
        ids, parts, sizes_of = (rows.field(f).to_numpy() for f in fields[:3])
        bits, keys = (rows.field(f).flatten().to_numpy().reshape(len(rows), -1) for f in fields[3:])
        return [ids, parts, sizes_of, bits.view(np.uint64), keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row, bucket in enumerate(batch.column("bucket").to_pylist()):
                ids, parts, n, bits, keys = side(batch.column("left"), row)
                ids2, parts2, m, bits2, keys2 = side(batch.column("right"), row)
                near = (parts[:, None] != parts2) & (100 * np.minimum(n[:, None], m) >= percent * np.maximum(n[:, None], m))
                i, j = np.nonzero(near)
                x = bits[i] ^ bits2[j]
                unequal = np.bitwise_count((x | x >> np.uint64(1)) & low).sum(axis=1)
                same = keys[i] == keys2[j]
                once = (unequal <= most) & (keys[i, same.argmax(axis=1)] == bucket)
                # Within one block both orders of a pair come up.
                once &= (ids[i] < ids2[j]) | (not np.array_equal(ids, ids2))
                i, j = i[once], j[once]
                likely = np.argsort(unequal[once], kind="stable")
                if len(i):
                    found.append((ids[i][likely], ids2[j][likely]))
            lists = [pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *(len(f[k]) for f in found)]), pa.int32()),
                pa.array(np.concatenate([np.empty(0, np.int64), *(f[k] for f in found)]))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(lists, ["a", "b"])

    return met.mapInArrow(run, "a array<long>, b array<long>").withColumn("job", F.monotonically_increasing_id())


def _linked_in_blocks(jobs: DataFrame, docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """Links (a, b) that connect what the pairs of stored jobs connect.

    A document's set moves once for each job that names it, not once for each pair. The likeliest pairs are compared first, and
    a pair that is connected by then is not compared.
    """
    named = jobs.select("job", F.explode(F.array_distinct(F.concat("a", "b"))).alias("id"))
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(
        named.select("id").distinct(), "id", "left_semi")

    def packed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = [s.tobytes() for s in shingle_sets(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], ["id", "set"])

    sets = texts.mapInArrow(packed_sets, "id long, set binary")
    rows = jobs.select("job", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("set"), "a", "b").union(
        named.join(sets, "id").select("job", "id", "set", F.lit(None), F.lit(None)))

    def linked(pairs: tuple, held: dict) -> Iterator[tuple]:
        up = {}

        def top(x: int) -> int:
            while up.get(x, x) != x:
                x = up[x]
            return x

        for a, b in zip(*pairs, strict=True):
            one, other = top(a), top(b)
            if one != other and any(alike(x, y) for x in held.get(a, ()) for y in held.get(b, ())):
                up[max(one, other)] = min(one, other)
                yield a, b

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, pairs, held = None, ((), ()), {}
        for batch in batches:
            found = []
            packed_column = batch.column("set")
            for row, (now, id_) in enumerate(zip(batch.column("job").to_pylist(), batch.column("id").to_pylist(), strict=True)):
                if now != job:
                    found += linked(pairs, held)
                    job, held = now, {}
                if id_ is None:
                    pairs = batch.column("a")[row].as_py(), batch.column("b")[row].as_py()
                else:
                    # Rows that share an id are one document, alike if any of its texts is.
                    held.setdefault(id_, []).append(np.frombuffer(packed_column[row].as_py(), np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        found = list(linked(pairs, held))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.repartition("job").sortWithinPartitions("job", F.asc_nulls_first("id")).mapInArrow(run, "a long, b long")


def _placed(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    return buckets.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id"))


def _mixed(placed: DataFrame) -> DataFrame:
    """Buckets that hold members of several components."""
    return placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where(
        "x < y").select("bucket")


def _linked_by_leaders(buckets: DataFrame, signatures: DataFrame, docs: DataFrame, key: str,
                       text: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """Confirmed links of each bucket's members with a leader, and the components they make.

    Every round another member leads each bucket that still holds several components, and meets those outside
    its own. A large group meets many leaders, so what is left after some rounds is little; the
    rounds end when one finds nothing. ``LEADERS`` bounds the rounds, not the result: what they leave is compared in full.
    """
    links = parts = None
    for number in range(LEADERS):
        placed = buckets.withColumn("component", F.col("id")) if parts is None else _placed(buckets, parts)
        # At first the buckets of a cluster should agree on one leader, so that a document meets few of them.
        by = F.xxhash64(F.lit(number), "id") if number == 0 else F.xxhash64(F.lit(number), "bucket", "id")
        led = placed.groupBy("bucket").agg(
            F.min_by(F.struct("id", "component"), by).alias("leader"),
            F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket", "leader.*")
        led = led.toDF("bucket", "leader", "of_leader")
        pairs = placed.join(led, "bucket").where("component <> of_leader").select(
            F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
        pairs = (pairs.join(signatures.select(F.col("id").alias("a"), F.col("n_shingles").alias("n"), F.col("signature").alias("one")), "a")
                 .join(signatures.select(F.col("id").alias("b"), F.col("n_shingles").alias("m"), F.col("signature").alias("other")), "b")
                 .where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
                 .where(estimated("one", "other") >= least_estimate(percent)).select("a", "b"))
        new = stage(confirmed(stage(pairs, "pairs"), docs, key, text, percent), "confirmed")
        if number and new.isEmpty():
            break
        links = new if parts is None else parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(new)
        parts = connected_components(links)
    return links, parts


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Returns (key, n_shingles, component_id, kept) for each row; ``key`` holds integers.

    Documents are linked if their sets share at least ``percent`` of their union.
    Documents with equal sets are one class, stood for by its smallest id. Classes that share a band are
    first compared with one leader of their bucket; classes of one bucket that those links leave in
    different components are then compared with each other, so that no confirmed link is lost and no
    large bucket is spelt out in pairs. Null, empty and blank texts have no shingles and are linked with
    nothing. Rows that share an id are one document, linked if any of its texts is; a null id is linked
    with nothing and kept. An empty table gives an empty one; other columns are not looked at.
    """
    whole = stage(sketches(docs, key, text, band_count(percent)), "sketches")
    classes = (whole.where("n_shingles > 0 AND key IS NOT NULL").groupBy("n_shingles", "set_a", "set_b")
               .agg(F.min("key").cast("long").alias("id")))
    member = whole.select(F.col("key").cast("long").alias("key"), "n_shingles", "set_a", "set_b")
    same = stage(member.where("n_shingles > 0").join(classes, ["n_shingles", "set_a", "set_b"])
                 .where("key <> id").select(F.col("key").alias("a"), F.col("id").alias("b")).distinct(), "same")
    signed = whole.where("n_shingles > 0").select(
        F.col("key").cast("long").alias("id"), "n_shingles", "signature", "bands").join(
        same.select(F.col("a").alias("id")).distinct(), "id", "left_anti")
    buckets = stage(signed.select("id", F.explode("bands").alias("bucket")), "buckets")
    signatures = stage(signed.select("id", "n_shingles", "signature", "bands"), "signatures")

    links, parts = _linked_by_leaders(buckets, signatures, docs, key, text, percent)
    placed = _placed(buckets, parts)
    jobs = stage(_open_blocks(placed.join(_mixed(placed), "bucket").join(signatures, "id"), percent), "open")
    more = stage(_linked_in_blocks(jobs, docs, key, text, percent), "confirmed")

    found = connected_components(links.union(more).union(same))
    return (whole.select("key", "n_shingles").join(found.withColumnRenamed("node", "key"), "key", "left")
            .select(F.col("key").alias(key), "n_shingles", F.coalesce("component", "key").alias("component_id"))
            .withColumn("kept", F.col(key).eqNullSafe(F.col("component_id"))))


@query("op8_near_duplicates")
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=PERCENT)
