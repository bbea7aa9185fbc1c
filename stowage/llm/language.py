"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

The text's likelihood comes from hashed byte trigrams of each language. Declared language and address
suffix are noisy witnesses whose reliability is counted from the corpus, and the prior of a host is its own count
of languages smoothed by that of its domain, which is smoothed by that of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.llm.registry import query, table
from stowage.llm.words import LOWER, chunks, text_bytes
from stowage.plans.staging import stage

LANGUAGES = ("de", "en", "es", "fr")
#: A class of its own for text of no wanted language: every trigram bucket alike.
UNKNOWN = "und"
CLASSES = (*LANGUAGES, UNKNOWN)

#: The trigram model is fitted on at most this many rows of each declared language, those with the smallest hash of their id.
SAMPLE = 1500
BUCKETS = 1 << 15
#: Weight of a trigram, since neighbours overlap; pseudo-counts of bucket, host and witness.
TEMPER, BUCKET_PRIOR, HOST_PRIOR, WITNESS_PRIOR = 1 / 3, 0.2, 20.0, 5.0
#: What a declared language or a suffix that names one is taken to mean before anything is seen: itself, with this probability.
ITSELF = 0.95
#: Witnesses are counted over texts with so many trigrams, whose own guess is sure.
SURE = 60
#: Share of rows taken to be of no wanted language before anything is seen.
UNKNOWN_SHARE = 0.01
NEEDED = 0.5

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[65:91] = LOWER[65:91]
_FOLD[97:123] = np.arange(97, 123)


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of letters (everything else is a blank), and the row it is in.

    A row has a blank before and behind it, so a single letter is a trigram and a row without letters has none.
    Runs of blanks and trigrams that cross rows are left out.
    """
    data, offsets = text_bytes(column)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(column)), sizes + 2)
    folded = np.full(len(row), 32, np.uint8)
    folded[np.arange(len(data)) + 2 * np.repeat(np.arange(len(column)), sizes) + 1] = _FOLD[data]
    inner = np.ones(len(folded), bool)
    inner[1:] = (folded[1:] != 32) | (folded[:-1] != 32) | (row[1:] != row[:-1])
    folded, row = folded[inner].astype(np.uint32), row[inner]
    code = (folded[:-2] << np.uint32(16)) | (folded[1:-1] << np.uint32(8)) | folded[2:]
    whole = row[:-2] == row[2:]
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(17)
    return code[whole].astype(np.int64), row[:-2][whole]


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", declared: str = "lang") -> np.ndarray:
    """Log-likelihood of each trigram bucket by class, from a bounded sample of rows with a declared language."""
    named = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"),
                        F.lower(F.col(declared).cast("string")).alias("declared"))
    picked = None
    for language in LANGUAGES:
        part = named.where((F.col("declared") == language) & F.col("key").isNotNull()).select("key", "declared").orderBy(
            F.xxhash64("key"), "key").limit(SAMPLE)
        picked = part if picked is None else picked.union(part)
    # At most SAMPLE ids for each language.
    sample = named.join(F.broadcast(picked), ["key", "declared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                code, row = trigrams(part.column("text"))
                place = np.array([LANGUAGES.index(d) for d in part.column("declared").to_pylist()], np.int64)
                cell, times = np.unique(place[row] * BUCKETS + code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(times.astype(np.int64))], ["cell", "n"])

    counted = sample.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(LANGUAGES) * BUCKETS)
    counts[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    counts = counts.reshape(len(LANGUAGES), BUCKETS) + BUCKET_PRIOR
    # About a third of the buckets occur in any language: a text of none has to miss them clearly.
    told = np.log(counts / counts.sum(axis=1, keepdims=True))
    return np.vstack([told, np.full(BUCKETS, -np.log(BUCKETS / 4))]).T.astype(np.float32)


def text_evidence(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """Replaces column ``text`` by ``told`` (tempered log-likelihood by class) and ``n_trigrams``."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                code, row = trigrams(part.column("text"))
                n = len(part)
                sums = np.stack([np.bincount(row, model[code, c], minlength=n) for c in range(len(CLASSES))], axis=1)
                told = pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1, dtype=np.int32) * len(CLASSES)), pa.array(sums.ravel() * TEMPER))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), told, pa.array(np.bincount(row, minlength=n).astype(np.int64))],
                    [*names, "told", "n_trigrams"])

    kept = rows.select(*names).schema.add("told", T.ArrayType(T.DoubleType())).add("n_trigrams", "long")
    return rows.mapInArrow(run, kept)


def address_suffix(url: Column) -> Column:
    """Last label of the host, with the first part of the path if that is two letters long: ``net/de``."""
    host = F.lower(F.regexp_extract(url, r"(?s)://([^/?#:]*)", 1))
    part = F.lower(F.regexp_extract(url, r"(?s)://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    suffix = F.concat_ws("/", F.substring_index(host, ".", -1), part)
    return F.when(host != "", suffix)


def named_language(suffix: Column) -> Column:
    """The language that an address suffix names: by the first part of the path, else by the label of the host."""
    part, label = F.element_at(F.split(suffix, "/"), -1), F.element_at(F.split(suffix, "/"), 1)
    return F.when(part.isin(*LANGUAGES), part).when(label.isin(*LANGUAGES), label)


def _shares(rows: DataFrame, by: str, least: int = 1) -> DataFrame:
    """Counts of the guessed language for each value of ``by``, as an array by class."""
    counts = [F.sum(((F.col("guess") == c) & (F.col("n_trigrams") >= least)).cast("long")).cast("double") for c in CLASSES]
    return rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.array(*counts).alias(f"{by}_n"))


def _of(name: Column, values: list[float]) -> Column:
    """The value of the class that ``name`` names; 0 where it names none."""
    value = F.lit(0.0)
    for c, v in zip(CLASSES, values, strict=True):
        value = F.when(name == c, F.lit(v)).otherwise(value)
    return value


def fuse(evidence: DataFrame) -> DataFrame:
    """Adds ``language``, ``probability`` and ``kept`` to stored rows with told, n_trigrams, host, declared, suffix.

    The guess of the text alone feeds all counts, each by one grouped aggregation, so a host with any
    share of the rows arrives as one row for each task.
    """
    classes = F.array(*map(F.lit, CLASSES))
    rows = evidence.withColumn("guess", F.when(
        F.col("n_trigrams") > 0, F.element_at(classes, F.array_position("told", F.array_max("told")).cast("int"))))
    rows = rows.withColumn("domain", F.substring_index("host", ".", -2))
    total = {r["guess"]: r["n"] for r in rows.where("guess IS NOT NULL").groupBy("guess").agg(F.count("*").alias("n")).collect()}
    seen = sum(total.get(c, 0) for c in LANGUAGES)
    share = [(total.get(c, 0) + 1) / (seen + len(LANGUAGES)) * (1 - UNKNOWN_SHARE) for c in LANGUAGES] + [UNKNOWN_SHARE]
    everywhere = F.array(*map(F.lit, share))

    def smoothed(own: str, above: Column) -> Column:
        counts = F.coalesce(F.col(own), F.array(*[F.lit(0.0)] * len(CLASSES)))
        size = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, above, lambda n, p: (n + HOST_PRIOR * p) / (size + HOST_PRIOR))

    def witness(name: str, names: Column) -> Column:
        # P(witness | class) up to a factor that is the same for all classes: P(class | witness) / P(class).
        counts = F.col(f"{name}_n")
        size = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        # A witness that names a language is smoothed towards that language, any other towards the shares of all rows.
        before = F.array(*[F.when(names.isNull(), F.lit(p)).when(names == c, F.lit(ITSELF)).otherwise(
            (1 - ITSELF) * p / (1 - _of(names, share))) for c, p in zip(CLASSES, share, strict=True)])
        likely = F.zip_with(counts, before, lambda n, p: (n + WITNESS_PRIOR * p) / (size + WITNESS_PRIOR))
        ratio = F.zip_with(likely, everywhere, lambda q, p: F.log(q / p))
        return F.coalesce(ratio, F.array(*[F.lit(0.0)] * len(CLASSES)))

    joined = rows
    for name, least in (("host", 1), ("domain", 1), ("declared", SURE), ("suffix", SURE)):
        joined = joined.join(_shares(rows, name, least), name, "left")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    prior = F.transform(smoothed("host_n", smoothed("domain_n", everywhere)), lambda p: F.log(p))
    joined = joined.withColumn("logs", add(add(F.col("told"), prior), add(
        witness("declared", F.when(F.col("declared").isin(*LANGUAGES), F.col("declared"))),
        witness("suffix", named_language(F.col("suffix"))))))
    top = F.array_max("logs")
    return joined.withColumn("language", F.when(F.col("n_trigrams") > 0, F.element_at(
        classes, F.array_position("logs", top).cast("int"))).otherwise(F.lit(UNKNOWN))).withColumn(
        "probability", F.when(F.col("n_trigrams") > 0, 1 / F.aggregate(
            "logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("logs")))).otherwise(F.lit(0.0))).withColumn(
        "kept", (F.col("language") != UNKNOWN) & (F.col("probability") >= NEEDED))


def identify(rows: DataFrame, model: np.ndarray, key: str, text: Column, declared: Column, host: Column,
             url: Column) -> DataFrame:
    """Returns (key, language, probability, declared, kept) for each row.

    Null evidence says nothing. A text without letters (null and empty ones too) is ``und`` with
    probability 0 and not kept. Rows are judged alone but for the counts; repeated rows count and come
    out as often as they are there, and an empty table gives an empty one.
    """
    plain = rows.select(F.col(key).alias("key"), F.coalesce(text.cast("string"), F.lit("")).alias("text"),
                        F.lower(declared.cast("string")).alias("declared"), F.lower(host.cast("string")).alias("host"),
                        address_suffix(url.cast("string")).alias("suffix"))
    fused = fuse(stage(text_evidence(plain, model), "evidence"))
    return fused.select(F.col("key").alias(key), "language", "probability", "declared", "kept")


def identify_documents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents: ``lang`` is what they declare and ``source`` their host; they carry no address."""
    return identify(docs, train(docs, key), key, F.col("text"), F.col("lang"), F.col("source"), F.lit(None))


def page_text(html: Column) -> Column:
    """Text of a page without scripts, styles and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>|&[A-Za-z]+;", " ")


def identify_pages(pages: DataFrame, model: np.ndarray, key: str = "page_id") -> DataFrame:
    """Pages: the ``lang`` of their markup, the suffix of their address and its host."""
    declared = F.regexp_extract("html", r"(?is)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2})", 1)
    host = F.regexp_extract("url", r"(?s)://([^/?#:]*)", 1)
    return identify(pages, model, key, page_text(F.col("html")), F.when(declared != "", declared),
                    F.when(host != "", host), F.col("url"))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(table(spark, sf_dir, "documents"))


@query("language_id_pages")
def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_pages(table(spark, sf_dir, "pages"), train(table(spark, sf_dir, "documents")))
