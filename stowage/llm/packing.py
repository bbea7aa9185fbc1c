"""Best-fit packing of token sequences after a dominance reduction in the manner of Martello and Toth.

Spark cuts and counts; only the histogram of piece lengths (at most ``capacity`` rows) is planned on the
driver, and the plan (see ``plan_sequences`` for its bound) is joined back to the pieces by their rank
among the pieces of the same length.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stowage.llm.registry import query, table
from stowage.llm.words import chunks
from stowage.plans.staging import stage

CAPACITY = 1024
END_ID = 2
#: Entries of a worker's dictionary of encoded words; beyond it the dictionary starts afresh.
DICTIONARY = 300_000

_ENCODERS: dict[str, ByteEncoder] = {}


class ByteEncoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    The byte-level vocabulary never joins a visible character with a blank that follows it, so a text is cut
    there and each distinct piece is encoded once per worker. ``ranks`` names the vocabulary as a rank
    file; its ids are those of the JSON form in the library ``tokenizers``, special tokens in a text included.
    """

    SPECIAL = "<|endoftext|>"
    # Other white space than these two may join a blank into one piece.
    _OTHER_SPACE = re.compile(r"[^\S\x20\n]")
    _PIECE = re.compile(r"[\x20\n]*[^\x20\n]+|[\x20\n]+")

    def __init__(self, ranks: str):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._core = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})._core_bpe
        self._special = len(table_).to_bytes(4, "little")
        self._known: dict[str, bytes] = {}

    def _encode(self, piece: str) -> bytes:
        ids = b"".join([i.to_bytes(4, "little") for i in self._core.encode_ordinary(piece)])
        if len(piece) < 64:
            self._known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.SPECIAL in text:
            return self._special.join(map(self.encode, text.split(self.SPECIAL)))
        if self._OTHER_SPACE.search(text):
            return b"".join([i.to_bytes(4, "little") for i in self._core.encode_ordinary(text)])
        if len(self._known) > DICTIONARY:
            self._known.clear()
        known = self._known.get
        return b"".join([known(p) or self._encode(p) for p in self._PIECE.findall(text)])


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut_points(total: int, capacity: int) -> list[int]:
    """Starts of the pieces of a document of ``total`` ids; only the first may be short."""
    first = total % capacity or capacity
    return [0, *range(first, total, capacity)]


PIECES = "piece int, start long, length long, ids_crc32 long"


def tokenised_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None,
                     capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: the document's ids, ``END_ID`` appended, cut to at most ``capacity``."""
    ranks = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ranks not in _ENCODERS:
            _ENCODERS[ranks] = ByteEncoder(ranks)
        encode, end = _ENCODERS[ranks].encode, END_ID.to_bytes(4, "little")
        for batch in batches:
            for part in chunks(batch, "text"):
                rows, out = [], ([], [], [], [])
                for row, t in enumerate(part.column("text").to_pylist()):
                    ids = encode(t or "") + end
                    starts = cut_points(len(ids) // 4, capacity)
                    for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids) // 4], strict=True)):
                        rows.append(row)
                        for column, value in zip(out, (piece, a, b - a, zlib.crc32(ids[4 * a:4 * b])), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()),
                     *(pa.array(c, pa.int64()) for c in out[1:])], ["key", "piece", "start", "length", "ids_crc32"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType)])
    for field in T.StructType.fromDDL(PIECES):
        schema.add(field)
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


PLAN = "length long, first_rank long, n_pieces long, first_sequence long, per_sequence long, at long"


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Places ``counts[length]`` pieces of each length into as few sequences as it can.

    Rows (length, first rank, pieces, first sequence, pieces in each sequence, offset in it). First the
    sets that dominate all others with the same piece are fixed: a pair that fills a sequence exactly;
    and, for the longest piece, itself where nothing else fits, or its best partner where two partners
    never fit, or three never do and no two hold more than the best one. What is left goes best-fit, longest first.

    Sequences with equal contents are one group throughout. A length touches a group once, fills it as
    far as it can, and leaves at most two new groups; a group is touched by distinct lengths whose sum
    is at most ``capacity``. So there are at most ``3 * capacity * sqrt(2 * capacity)`` rows, however many pieces.
    """
    left = {s: c for s, c in counts.items() if c > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    rows: list[tuple[int, ...]] = []
    sequences = 0

    def put(length: int, n: int, sequence: int, per: int, at: int) -> None:
        rows.append((length, used[length], n, sequence, per, at))
        used[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    def fix(longer: int, other: int | None) -> None:
        nonlocal sequences
        if other is None:
            n = left[longer]
            put(longer, n, sequences, 1, 0)
        elif other == longer:
            n = left[longer] // 2
            put(longer, 2 * n, sequences, 2, 0)
        else:
            n = min(left[longer], left[other])
            put(longer, n, sequences, 1, 0)
            put(other, n, sequences, 1, longer)
        sequences += n

    for s in sorted(left, reverse=True):
        other = capacity - s
        if s >= other and left.get(s, 0) >= 1 + (s == other) and (other == 0 or left.get(other)):
            fix(s, other or None)
    while left:
        longest = max(left)
        room = capacity - longest
        rest = {s: c - (s == longest) for s, c in left.items() if c > (s == longest)}
        small = [s for s in sorted(rest) for _ in range(min(3, rest[s]))][:3]
        partner = max((s for s in rest if s <= room), default=None)
        if partner is None or sum(small[:2]) > room or len(small) < 2:
            fix(longest, partner)
            continue
        if len(small) < 3 or sum(small) > room:
            pair = max((a + b for a in rest for b in [max((s for s in rest if s <= room - a and
                        (s != a or rest[a] > 1)), default=None)] if b is not None), default=0)
            if partner >= pair:
                fix(longest, partner)
                continue
        break

    groups: dict[int, deque[tuple[int, int]]] = {r: deque() for r in range(capacity + 1)}
    for s in sorted(left, reverse=True):
        room = s
        while s in left:
            while room <= capacity and not groups[room]:
                room += 1
            if room > capacity:
                per = min(capacity // s, left[s])
                n = left[s] // per
                groups[capacity - per * s].append((sequences, n))
                put(s, n * per, sequences, per, 0)
                sequences += n
                continue
            first, n = groups[room].popleft()
            per = min(room // s, left[s])
            taken = min(n, left[s] // per)
            if taken < n:
                groups[room].appendleft((first + taken, n - taken))
            groups[room - per * s].append((first, taken))
            put(s, taken * per, first, per, capacity - room)
    return rows


def pack(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a stored table of pieces with a column ``length``.

    Equal lengths may hold any share of the rows: ranks are counted in hash buckets of (length, bucket)
    and shifted by the buckets before. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_bucket").orderBy(key, "piece", "start", "ids_crc32")
    ranked = (dealt.withColumn("_row", F.row_number().over(order)).join(starts, ["length", "_bucket"])
              .withColumn("_rank", F.col("_before") + F.col("_row") - 1))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(plan_sequences(histogram, capacity), PLAN)
    # The plan's rows are bounded by the capacity alone (see plan_sequences).
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"])
                         & (F.col("_rank") >= F.col("first_rank"))
                         & (F.col("_rank") < F.col("first_rank") + F.col("n_pieces")))
    nth = F.col("_rank") - F.col("first_rank")
    return placed.select(
        key, "piece", "start", ranked["length"], "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("at") + nth % F.col("per_sequence") * ranked["length"]).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None,
                   capacity: int = CAPACITY) -> DataFrame:
    """Packs whole documents: one row per piece with its place in a sequence.

    Null and empty texts are one id long. Repeated rows are packed once each; rows equal in every
    packed column are interchangeable. Other columns of the table are not looked at.
    """
    pieces = stage(tokenised_pieces(docs, key, text, ranks, capacity).withColumnRenamed("key", key), "pieces")
    return pack(pieces, key, capacity)


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
