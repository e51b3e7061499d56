"""Positions of rows in sorted groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch


def numbered(rows: DataFrame, group: str, order: list, scratch: Scratch) -> DataFrame:
    """rows with pos (0, 1, 2, ... in their group, by order) and size (rows of the group), as a table of scratch joined with small counts.

    rows is a written table, as it is read twice: once to choose ranges. Rows are sorted in ranges over group and order, so that a large group lies in many tasks; what was
    counted before a range is added. Rows that agree in all of that are told apart by where they lie, so they don't gather in one range either. group is never null.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(group), *order, F.col("_tie")]
    # ids grow with the range in their upper bits and by one from row to row in their lower 33
    ranged = scratch.keep(tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33).alias("_part")
    counts = ranged.groupBy(group, part).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size"))
    return ranged.withColumn("_part", part).join(counts, [group, "_part"]).withColumn("pos", F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift")
