"""Places of rows in their group, counted from 0, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.plans.staging import stage

#: ``monotonically_increasing_id`` has the partition above this bit and the row below it.
ROW_BITS = 33


def with_slots(rows: DataFrame, group: str, order: list[str], slot: str = "slot") -> DataFrame:
    """``rows`` with each row's place in its group (never null) in the order given; ties in any order, but fixed.

    The rows are dealt by ranges of (group, order), so a group of any size goes through as many tasks as it needs, and
    equal rows are told apart by a number of their own. A row's place is its place in its range, plus what earlier
    ranges hold of its group: one count for each range and group, not a window over the rows.
    """
    named = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "named")
    dealt = named.repartitionByRange(group, *order, "_row").sortWithinPartitions(group, *order, "_row")
    dealt = stage(dealt.withColumn("_at", F.monotonically_increasing_id()), "dealt").withColumn(
        "_range", F.shiftright("_at", ROW_BITS))
    pieces = dealt.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return dealt.join(pieces.drop("_n"), [group, "_range"]).withColumn(
        slot, F.col("_at") - F.col("_first") + F.col("_before")).select(*rows.columns, slot)
