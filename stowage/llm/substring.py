"""Repeated passages by recompression: rounds that name runs and pairs of symbols until they are long.

Every round replaces runs of one symbol, then pairs whose left symbol falls in one half of the alphabet and whose
right symbol falls in the other. Names are hashes of what they replace and halves are bits of names, so all
tasks agree on them without a dictionary, and equal passages get equal symbols in their interior.
``Round`` also carries how much text around a symbol had a say in it; a symbol whose say lies inside a
window of words is the same wherever that window occurs. Each window is looked up by such a symbol,
and windows whose symbol occurs in several documents are compared by a hash of all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.registry import query, table
from stowage.llm.words import Words, chunks, cut, mix, rolling
from stowage.plans.staging import stage

WINDOW = 50
#: More rounds give longer symbols, but fewer windows that hold one; windows without one use an earlier round.
ROUNDS = 9
#: Runs are named in these rounds only: finding where a run ends takes a symbol more on both sides.
RUN_ROUNDS = (0,)


@dataclass
class Round:
    """Symbols of some rows in order: name, row, and the words ``low`` to ``high`` that had a say in it."""

    name: np.ndarray
    row: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _merge(symbols: Round, first: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> Round:
    """Groups consecutive symbols, each group from ``first`` on, given the extent that decided each group's ends."""
    last = np.append(first[1:], len(symbols.name)) - 1
    return Round(name, symbols.row[first], np.minimum(symbols.low[first], low), np.maximum(symbols.high[last], high))


def _neighbours(symbols: Round, first: np.ndarray, last: np.ndarray, looks_left: np.ndarray,
                looks_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Extents of groups of symbols, with the neighbours they looked at.

    That a row ends there is no property of its words, so a look beyond its end lies in no window.
    """
    n = len(symbols.name)
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    has_before = (first > 0) & (symbols.row[before] == symbols.row[first])
    has_after = (last < n - 1) & (symbols.row[after] == symbols.row[last])
    low, high = symbols.low[first], symbols.high[last]
    low = np.where(looks_left, np.where(has_before, symbols.low[before], low - 1), low)
    return low, np.where(looks_right, np.where(has_after, symbols.high[after], high + 1), high)


def name_runs(symbols: Round) -> Round:
    """Names each maximal run of one symbol; who its neighbours are decides where it ends."""
    n = len(symbols.name)
    if not n:
        return symbols
    starts = np.ones(n, bool)
    starts[1:] = (symbols.name[1:] != symbols.name[:-1]) | (symbols.row[1:] != symbols.row[:-1])
    first = np.flatnonzero(starts)
    size = np.diff(np.append(first, n))
    name = symbols.name[first]
    name = np.where(size > 1, mix(name * np.uint64(3) + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), name)
    every = np.ones(len(first), bool)
    return _merge(symbols, first, name, *_neighbours(symbols, first, first + size - 1, every, every))


def name_pairs(symbols: Round, number: int) -> Round:
    """Names each pair of a left-half and a right-half symbol."""
    n = len(symbols.name)
    if not n:
        return symbols
    left = (mix(symbols.name + np.uint64(number + 1)) & np.uint64(1)).astype(bool)
    pair = np.zeros(n, bool)
    pair[:-1] = left[:-1] & ~left[1:] & (symbols.row[:-1] == symbols.row[1:])
    second = np.zeros(n, bool)
    second[1:] = pair[:-1]
    first = np.flatnonzero(~second)
    paired = pair[first]
    name, right = symbols.name[first], symbols.name[np.minimum(first + 1, n - 1)]
    name = np.where(paired, mix(mix(name) * np.uint64(5) + right * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number)), name)
    # A right-half symbol left alone had its left neighbour looked at, a left-half symbol its right one.
    return _merge(symbols, first, name, *_neighbours(symbols, first, first + paired, ~left[first], left[first] & ~paired))


def anchors(words: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each place, whether a window starts there, and the symbol that it is looked up by.

    That is the leftmost symbol of the latest round that only words of the window had a say in, so
    equal windows are looked up by equal symbols. A word is always one, so every window has a symbol.
    """
    n = len(words.hash)
    places = np.arange(n, dtype=np.int32)
    row = words.row.astype(np.int32)
    starts = np.zeros(n, bool)
    if n >= window:
        starts[:n - window + 1] = row[:n - window + 1] == row[window - 1:]
    key = words.hash.copy()
    symbols = Round(words.hash, row, places, places + 1)
    begin = words.first[:-1].astype(np.int32)
    for number in range(ROUNDS):
        if number in RUN_ROUNDS:
            symbols = name_runs(symbols)
        symbols = name_pairs(symbols, number)
        # Symbol j is the leftmost for windows that start after the previous symbol's extent begins.
        after = np.empty(len(symbols.low), np.int32)
        if not len(after):
            break
        after[1:] = symbols.low[:-1] + 1
        fresh = np.ones(len(after), bool)
        fresh[1:] = symbols.row[1:] != symbols.row[:-1]
        after[fresh] = begin[symbols.row[fresh]]
        since = np.maximum(after, symbols.high - window)
        many = np.maximum(symbols.low - since + 1, 0)
        at = np.repeat(since - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        key[at] = np.repeat(symbols.name + np.uint64(number + 1), many)
    return starts, key


def symbol_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(symbol, doc): the symbols by which some window of a document is looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = cut(part.column("text"))
                starts, symbol = anchors(words)
                at = np.flatnonzero(starts)
                # The same symbol serves neighbouring windows: most repeats go here.
                new = np.ones(len(at), bool)
                new[1:] = (symbol[at[1:]] != symbol[at[:-1]]) | (words.row[at[1:]] != words.row[at[:-1]])
                at = at[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(symbol[at].view(np.int64)), part.column("doc").take(pa.array(words.row[at]))],
                    ["symbol", "doc"])

    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(
        run, "symbol long, doc long")


def progressions(row: np.ndarray, value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of equal values of one row as (index of the first, step, count); runs and periods take one entry each."""
    order = np.lexsort((at, value, row))
    row, value, at = row[order], value[order], at[order]
    same, gap = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
    same[1:] = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
    gap[1:] = at[1:] - at[:-1]
    opens = ~same
    opens[1:] |= same[:-1] & (gap[1:] != gap[:-1])
    first = np.flatnonzero(opens)
    count = np.diff(np.append(first, len(at)))
    return order[first], np.where(count > 1, gap[np.minimum(first + 1, len(at) - 1)], 0), count


def window_rows(docs: DataFrame, symbols: str) -> DataFrame:
    """(h1, h2, doc, at, step, n) of the windows looked up by one of the symbols in an array column.

    Two hashes of all the words, of 96 bits together, stand for a window; ``n`` equal ones start ``step`` words apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = cut(part.column("text"))
                starts, symbol = anchors(words)
                keep = np.zeros(len(symbol), bool)
                shared = part.column("symbols")
                for row, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
                    found = shared[row].values
                    if found is not None:
                        keep[a:b] = np.isin(symbol[a:b].view(np.int64), np.asarray(found))
                at = np.flatnonzero(starts & keep)
                one = rolling(words.hash, WINDOW)[at]
                two = rolling(mix(words.hash + np.uint64(11)), WINDOW)[at]
                row = words.row[at]
                first, step, n = progressions(row, one, at)
                at, row, one, two = at[first], row[first], one[first], two[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                     part.column("doc").take(pa.array(row)), pa.array((at - words.first[row]).astype(np.int32)),
                     pa.array(step.astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["h1", "h2", "doc", "at", "step", "n"])

    return docs.select("doc", "text", F.col(symbols).alias("symbols")).mapInArrow(
        run, "h1 long, h2 int, doc long, at int, step int, n int")


KEPT = "n_words long, n_removed long, kept_sha256 string, kept_text string"


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Returns (key, n_words, n_removed, kept_sha256) for each row, and ``kept_text`` if asked for.

    A word goes if a window of ``WINDOW`` words over it also starts in a document with a smaller id; all
    is judged on the input. Null and blank texts have no words. Copies of a whole text are settled by
    their text alone. Rows that share an id are one document for the purpose of smaller ids, and what is found in any
    of them goes from the same places of all; a null id is smaller than none and keeps its words. An
    empty table gives an empty one; other columns are not looked at.
    """
    plain = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    named = plain.where("doc IS NOT NULL")
    prints = stage(named.select("doc", F.md5("text").alias("print")), "prints")
    firsts = prints.groupBy("print").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    copies = stage(prints.join(firsts, "print").where("doc > first").select("doc").distinct(), "copies")

    symbols = stage(symbol_rows(named, "doc", "text"), "symbols").join(copies, "doc", "left_anti")
    shared = symbols.groupBy("symbol").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x < y")
    # No window goes from the first document of its symbol: it only shows others that theirs occurred before.
    by_doc = stage(symbols.join(shared.select("symbol", "x"), "symbol").groupBy("doc").agg(
        F.collect_set("symbol").alias("shared"),
        F.collect_set(F.when(F.col("doc") > F.col("x"), F.col("symbol"))).alias("later")), "shared")
    marked = named.join(by_doc, "doc")
    least = window_rows(marked, "shared").groupBy("h1", "h2").agg(
        F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    repeated = window_rows(marked, "later").join(least, ["h1", "h2"]).where("doc > first")
    places = repeated.groupBy("doc").agg(F.collect_set(F.struct("at", "step", "n")).alias("places"))
    empty = F.lit(None).cast("array<struct<at:int,step:int,n:int>>")
    marks = places.select("doc", "places", F.lit(False).alias("copy")).unionByName(
        copies.select("doc", empty.alias("places"), F.lit(True).alias("copy")))
    # All three uses of the named texts share one exchange by id.
    out = _cut_out(named.join(marks, "doc", "left")).unionByName(_cut_out(
        plain.where("doc IS NULL").select("doc", "text", empty.alias("places"), F.lit(False).alias("copy"))))
    return out.select(F.col("doc").cast(docs.schema[key].dataType).alias(key), "n_words", "n_removed", "kept_sha256",
                      *(["kept_text"] if with_text else []))


def _cut_out(marked: DataFrame) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                out: list[list] = [[], [], [], []]
                for t, copy, places in zip(*(part.column(c) for c in ("text", "copy", "places")), strict=True):
                    words = t.as_py().encode().split()
                    kept = words
                    if copy.as_py() and len(words) >= WINDOW:
                        kept = []
                    elif places.values is not None:
                        at, step, n = (places.values.field(f).to_numpy().astype(np.int64) for f in ("at", "step", "n"))
                        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        at = np.repeat(at, n) + nth * np.repeat(step, n)
                        change = np.zeros(len(words) + 1, np.int32)
                        np.add.at(change, at, 1)
                        np.add.at(change, at + WINDOW, -1)
                        kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                    joined = b" ".join(kept)
                    for column, value in zip(out, (len(words), len(words) - len(kept),
                                                   hashlib.sha256(joined).hexdigest(), joined.decode()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                     pa.array(out[2], pa.string()), pa.array(out[3], pa.string())],
                    ["doc", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return marked.select("doc", "text", "copy", "places").mapInArrow(run, f"doc long, {KEPT}")


@query("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
