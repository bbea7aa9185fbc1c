"""Quality classifier: a factorisation machine over hashed words, structure statistics and length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.llm.registry import query, table
from stowage.llm.words import chunks, cut, text_bytes

#: Word buckets, and the statistics that follow them (see ``features``).
BUCKETS, STATISTICS = 2048, 12
WIDTH = BUCKETS + STATISTICS
FACTORS = 8
#: The model is fitted on at most this many labelled rows of each class, those with the smallest hash of their id.
SAMPLE = 4000
STEPS, BATCH, RATE, DECAY = 1200, 64, 0.1, 1e-5
THRESHOLD = 0.3


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray


@dataclass
class Rows:
    """Sparse features of some rows: row numbers ascending, columns and values."""

    n: int
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.searchsorted(self.row, np.arange(self.n + 1))


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)


def features(column: pa.Array) -> Rows:
    """Word buckets by damped frequency (unit length per row) and bounded statistics of each whole text.

    Statistics: shares of capitals, digits, blanks, line ends, ASCII marks, words ending in a mark, words
    in capitals and words equal to the one before; distinct words per word; word length; and the
    logarithms of the text's bytes and words. Empty texts have only zeros.
    """
    words = cut(column)
    data, offsets = text_bytes(column)
    n = len(column)
    size = np.diff(offsets).astype(float)
    count = np.diff(words.first).astype(float)
    row = words.row
    key = row * np.int64(BUCKETS) + (words.hash & np.uint64(BUCKETS - 1)).astype(np.int64)
    cell, times = np.unique(key, return_counts=True)
    damped = 1 + np.log(times)
    at = cell // BUCKETS
    norm = np.sqrt(np.bincount(at, damped**2, minlength=n))
    damped /= norm[at]

    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    mark = (data > 32) & (data < 127) & ~upper & ~digit & ~((data >= 97) & (data <= 122))
    sums = np.concatenate([[0], np.cumsum(upper)])
    capitals = sums[words.end] - sums[words.start]
    same = np.zeros(len(row), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (row[1:] == row[:-1])
    distinct = np.bincount(np.unique(np.stack([row, words.hash.view(np.int64)]), axis=1)[0], minlength=n)[:n]
    by_word = words.first
    safe, some = np.maximum(size, 1), np.maximum(count, 1)
    stats = np.stack([
        _per_row(upper, offsets) / safe, _per_row(digit, offsets) / safe, _per_row(data == 32, offsets) / safe,
        _per_row(data == 10, offsets) / some, _per_row(mark, offsets) / safe,
        _per_row(mark[words.end - 1], by_word) / some, _per_row(capitals > 1, by_word) / some,
        _per_row(same, by_word) / some, distinct / some,
        np.minimum(_per_row(words.end - words.start, by_word) / some, 20) / 20,
        np.log1p(size) / 12, np.log1p(count) / 10], axis=1)
    stats[size == 0] = 0
    rows = np.concatenate([at, np.repeat(np.arange(n), STATISTICS)])
    columns = np.concatenate([cell % BUCKETS, np.tile(np.arange(BUCKETS, WIDTH), n)])
    values = np.concatenate([damped, stats.ravel()])
    order = np.argsort(rows, kind="stable")
    return Rows(n, rows[order], columns[order], values[order])


def decision(model: Model, x: Rows) -> np.ndarray:
    """The machine's output in time linear in the features: pairs by half of (square of sums - sum of squares)."""
    part = np.zeros((x.n, FACTORS))
    squares = np.zeros(x.n)
    linear = np.bincount(x.row, model.linear[x.column] * x.value, minlength=x.n)
    terms = model.factors[x.column] * x.value[:, None]
    for f in range(FACTORS):
        part[:, f] = np.bincount(x.row, terms[:, f], minlength=x.n)
        squares += np.bincount(x.row, terms[:, f] ** 2, minlength=x.n)
    return model.bias + linear + 0.5 * ((part**2).sum(axis=1) - squares)


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: Rows, label: np.ndarray, weight: np.ndarray, seed: int = 7) -> Model:
    """Adaptive gradient steps on the weighted logistic loss, batch by batch."""
    rng = np.random.default_rng(seed)
    share = float(np.clip((label * weight).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    model = Model(float(np.log(share / (1 - share))), np.zeros(WIDTH), rng.normal(0, 0.02, (WIDTH, FACTORS)))
    seen = [1e-3, np.full(WIDTH, 1e-3), np.full((WIDTH, FACTORS), 1e-3)]
    first = x.first
    done = 0
    while done < STEPS:
        for picked in np.array_split(rng.permutation(x.n), max(1, x.n // BATCH)):
            done += 1
            sizes = first[picked + 1] - first[picked]
            entries = np.repeat(first[picked] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            part = Rows(len(picked), np.repeat(np.arange(len(picked)), sizes), x.column[entries], x.value[entries])
            off = (probability(decision(model, part)) - label[picked]) * weight[picked] / len(picked)
            sums = np.stack([np.bincount(part.row, model.factors[part.column, f] * part.value, minlength=part.n)
                             for f in range(FACTORS)], axis=1)
            each = off[part.row] * part.value
            slope = np.bincount(part.column, each, minlength=WIDTH) + DECAY * model.linear
            inner = each[:, None] * (sums[part.row] - model.factors[part.column] * part.value[:, None])
            slopes = np.stack([np.bincount(part.column, inner[:, f], minlength=WIDTH) for f in range(FACTORS)], axis=1)
            slopes += DECAY * model.factors
            for k, (what, g) in enumerate((("bias", off.sum()), ("linear", slope), ("factors", slopes))):
                seen[k] = seen[k] + g**2
                setattr(model, what, getattr(model, what) - RATE * g / np.sqrt(seen[k]))
    return model


def held_out(key: str) -> Column:
    """Rows whose label is never learnt from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          label: str = "quality") -> Model:
    """Fits the model on a bounded sample of the labelled rows that are not held out.

    ``SAMPLE`` rows of each class at most; the classes are weighted by their share of all labelled
    rows. Without labelled rows the model answers 0.5 for every text.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key)).select(
        key, F.col(label).cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("label") == value).orderBy(F.xxhash64(key), key).limit(SAMPLE) for value in sorted(totals)]
    if not parts:
        return Model(0.0, np.zeros(WIDTH), np.zeros((WIDTH, FACTORS)))
    picked = parts[0]
    for more in parts[1:]:
        picked = picked.union(more)
    # At most 2 * SAMPLE ids.
    sample = docs.select(key, F.col(text).cast("string").alias("text")).join(F.broadcast(picked), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                x = features(part.column("text"))
                cells = pa.array(x.column.astype(np.int32)), pa.array(x.value.astype(np.float32))
                offsets = pa.array(x.first.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").cast(pa.string()), part.column("label"),
                     *(pa.ListArray.from_arrays(offsets, c) for c in cells)], ["key", "label", "columns", "values"])

    rows = (sample.select(F.col(key).alias("key"), "label", "text")
            .mapInArrow(run, "key string, label int, columns array<int>, values array<float>").toArrow()
            .sort_by([("key", "ascending"), ("label", "ascending")]).combine_chunks())
    label_of = rows["label"].to_numpy()
    columns, values = (rows[c].combine_chunks() for c in ("columns", "values"))
    sizes = np.diff(np.asarray(columns.offsets))
    x = Rows(len(label_of), np.repeat(np.arange(len(label_of)), sizes), np.asarray(columns.flatten()),
             np.asarray(values.flatten()).astype(float))
    taken = {value: max(1, int((label_of == value).sum())) for value in totals}
    scale = sum(totals.values()) / max(1, len(label_of))
    weight = np.array([totals[v] / taken[v] / scale for v in label_of])
    return fit(x, label_of.astype(float), weight)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns (key, held_out, score, predicted) for each row, from the whole text and nothing else.

    Null is scored as the empty text. Repeated rows get equal scores; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                z = decision(model, features(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(probability(z))], ["key", "score"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("score", T.DoubleType())])
    scored = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    return scored.withColumnRenamed("key", key).select(
        key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
