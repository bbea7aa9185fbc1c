"""Benchmark decontamination: MinHash containment search, partitioned by item size, then exact containment.

Everything runs as DataFrame expressions. A document is cut into overlapping windows twice as long as the
items of a size class, so a short item fills a known share of some window of a document of any length. A window's
sketch is of its distinct shingles, so text that repeats itself leaves the item's share as it is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.registry import query, table
from stowage.llm.shingles import shingles, sql_shingles, words
from stowage.plans.staging import stage

#: An item is in a document that holds at least this share (tenths) of its distinct shingles.
TENTHS = 8
#: Sizes of one class differ by this factor at most.
STEP = 1.5
#: Bound on the probability that the smallest hashes of a window hold none of an item that is in it.
MISS = 1e-6


def size_class(n: int) -> int:
    """Number of the class of items with ``n`` shingles."""
    return 0 if n <= 1 else math.ceil(math.log(n, STEP) - 1e-9)


def class_bounds(number: int) -> tuple[int, int]:
    """Smallest and largest size in a class."""
    sizes = [n for n in range(max(1, math.floor(STEP ** (number - 1))), math.ceil(STEP**number) + 1) if size_class(n) == number]
    return (sizes[0], sizes[-1]) if sizes else (1, 1)


def sketch_size(least: int, most: int) -> int:
    """How many smallest hashes of a window of ``2 * most`` shingles are kept.

    A window that holds the required share of the smallest item of the class keeps none of its shingles
    with a probability of at most ``MISS``.
    """
    window, inside = 2 * most, -(-least * TENTHS // 10)
    missed = 1.0
    for k in range(window - inside):
        missed *= (window - inside - k) / (window - k)
        if missed <= MISS:
            return k + 1
    return window - inside + 1


def item_shingles(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct shingles of each item, its size class and the class of its windows; items without words are left out.

    An item that repeats itself takes more places than it has distinct shingles; ``reach`` is the class of those
    places. For most items it is the size class.
    """
    cut = items.select(F.col(key).alias("item"), words(F.col(text)).alias("w")).select(
        "item", shingles("w").alias("all")).select("item", F.size("all").alias("places"), F.array_distinct("all").alias("shingles"))
    sized = cut.withColumn("n_item", F.size("shingles")).where("n_item > 0 AND item IS NOT NULL")

    def number(n: str) -> Column:
        return F.when(F.col(n) <= 1, 0).otherwise(F.ceil(F.log(STEP, F.col(n).cast("double")) - 1e-9)).cast("int")

    return sized.withColumn("class", number("n_item")).withColumn("reach", number("places")).drop("places")


def _least(least: int, most: int) -> Column:
    """The smallest distinct hashes of each window of column ``shingles`` for items of these sizes.

    Only texts that repeat a shingle (column ``repeats``) need the step that drops copies.
    """
    last = F.greatest(F.ceil((F.size("shingles") - 2 * most) / most), F.lit(0)).cast("int")
    size = F.lit(sketch_size(least, most))

    def window(j: Column) -> Column:
        held = F.slice("shingles", j * most + 1, F.lit(2 * most))
        return F.slice(F.sort_array(F.when(F.col("repeats"), F.array_distinct(held)).otherwise(held)), F.lit(1), size)

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), last), window)))


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                 item_key: str = "item_id") -> DataFrame:
    """Returns (key, item_key, n_item, n_found) for each item that is in a document.

    Null and empty texts hold nothing and nothing is in them; rows without an id are left out. Rows that
    share an id are one document (or item) that holds what any of its rows holds. Empty tables give an
    empty one; other columns are not looked at.
    """
    listed = stage(item_shingles(items, item_key), "items")
    # Classes grow with the logarithm of the longest item.
    classes = sorted((r["class"], r["reach"]) for r in listed.select("class", "reach").distinct().collect())

    def cut_up(of: DataFrame) -> DataFrame:
        return of.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), words(F.col(text)).alias("w")).select(
            "doc", shingles("w").alias("shingles"))

    cut = cut_up(docs)
    sketches = [F.struct(F.lit(c).alias("class"), F.lit(r).alias("reach"),
                         _least(class_bounds(c)[0], class_bounds(r)[1]).alias("least")) for c, r in classes]
    index = listed.select("item", "class", "reach", F.explode("shingles").alias("s"))
    if classes:
        marked = cut.withColumn("repeats", F.size(F.array_distinct("shingles")) < F.size("shingles"))
        kept = marked.select("doc", F.explode(F.array(*sketches)).alias("of")).select(
            "doc", "of.class", "of.reach", F.explode("of.least").alias("s"))
        pairs = kept.join(index, ["class", "reach", "s"]).select("doc", "item").distinct()
    else:
        pairs = cut.join(index, F.lit(False)).select("doc", "item")
    pairs = stage(pairs, "candidates")
    # The candidates' documents are picked out before they are cut again.
    again = docs.join(pairs.select(F.col("doc").alias(key)).distinct(), key, "left_semi")
    sets = cut_up(again).join(pairs, "doc").join(
        listed.select("item", "n_item", F.col("shingles").alias("of_item")), "item")
    found = sets.select("doc", "item", "n_item", F.size(F.array_intersect("of_item", "shingles")).alias("n_found"))
    return (found.where(F.col("n_found") * 10 >= F.col("n_item") * TENTHS)
            .groupBy(F.col("doc").alias(key), F.col("item").alias(item_key))
            .agg(F.max("n_item").cast("long").alias("n_item"), F.max("n_found").cast("long").alias("n_found")))


ORACLE = f"""
WITH d AS ({sql_shingles('documents', 'doc_id')}), i AS ({sql_shingles('benchmark', 'item_id')}),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_found FROM d JOIN i USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) * 10 >= n_item * {TENTHS}
"""


@query("op9_decontamination", ORACLE)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
