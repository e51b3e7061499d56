"""Exact order statistics of groups of any size: no buffer ever holds a group's values.

Narrowing passes: a mergeable sketch gives a grid of values of known rank error, the wanted rank lies between two of them, and only the values there go on. What is left is small however large the group was; its distinct
values are counted and summed up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import kept

#: Grid steps of a pass, and the sketch's accuracy (rank error one in so many), which is far finer.
GRID, ACCURACY = 500, 10_000
#: A group with at most so many values is counted as it is.
SMALL = 200_000


def at_ranks(rows: DataFrame, key: list[str], value: str, ranks, small: int = SMALL) -> DataFrame:
    """(key, rank, value): the values at ranks(n), an array of numbers from 0 to n - 1 for a group of n values that aren't null; NaN counts as greatest. A null key is a group; groups without values
    have no rows."""
    own = [f"k{i}" for i in range(len(key))]
    # one text stands for the key, so that a null in it joins like any other value
    rows = rows.where(F.col(value).isNotNull()).select(F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(k).alias(c) for k, c in zip(key, own, strict=True)])).alias("g"), *[F.col(k).alias(c) for k, c in zip(key, own, strict=True)], F.col(value).alias("v"))
    sizes = kept(rows.groupBy("g").agg(*[F.first(c).alias(c) for c in own], F.count("*").alias("n")))
    wanted = sizes.select("g", F.explode(F.array_distinct(ranks(F.col("n")))).alias("rank")).select("g", F.col("rank").cast("long").alias("rank"))
    wanted, rows = wanted.withColumn("left", F.col("rank")), rows.select("g", "v")
    most = sizes.agg(F.max("n")).first()[0] or 0
    # the sketch knows no NaN: they lie behind all else
    grid = F.percentile_approx(F.when(~F.isnan("v"), F.col("v")), [k / GRID for k in range(GRID + 1)], ACCURACY).alias("grid")
    while most > small:
        # from the second pass on, each wanted rank has values of its own
        by = ["g"] + (["rank"] if "rank" in rows.columns else [])
        met = wanted.join(rows.groupBy(*by).agg(grid, F.count_if(~F.isnan("v")).alias("m")), by)
        step = F.floor(F.col("left") / F.greatest(F.col("m") - 1, F.lit(1)) * GRID).cast("int")
        ends = {"low": F.greatest(step - 1, F.lit(0)), "high": F.least(step + 2, F.lit(GRID))}
        met = met.select("g", "rank", "left", *[F.when(F.col("left") >= F.col("m"), F.lit(float("nan"))).otherwise(F.get("grid", k)).alias(c) for c, k in ends.items()])
        both = rows.join(met.select("g", "rank", "low", "high"), by)
        below = both.groupBy("g", "rank").agg(F.count_if(F.col("v") < F.col("low")).alias("below"))
        wanted = met.join(below, ["g", "rank"]).select("g", "rank", (F.col("left") - F.col("below")).alias("left"))
        rows = both.where(F.col("v").between(F.col("low"), F.col("high"))).select("g", "rank", "v")
        most //= GRID // 4
    by = [c for c in ("g", "rank") if c in rows.columns]
    counts = rows.groupBy(*by, "v").agg(F.count("*").alias("c"))
    sums = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    hit = sums.join(wanted, by).where((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("c")))
    return hit.join(sizes, "g").select(*[F.col(c).alias(k) for k, c in zip(key, own, strict=True)], "rank", F.col("v").alias("value"))


def nearest_rank(rows: DataFrame, key: list[str], value: str, share: float, small: int = SMALL) -> DataFrame:
    """(key, value): the smallest value that at least a share of the group's values don't exceed."""
    at = lambda n: F.array(F.greatest(F.ceil(n * F.lit(share)) - 1, F.lit(0)))
    return at_ranks(rows, key, value, at, small).select(*key, "value")


def median(rows: DataFrame, key: list[str], value: str, small: int = SMALL) -> DataFrame:
    """(key, value): the middle value, or the mean of the two middle ones."""
    middle = at_ranks(rows, key, value, lambda n: F.array(F.floor((n - 1) / 2), F.floor(n / 2)), small)
    return middle.groupBy(*key).agg(F.avg("value").alias("value")).where("value IS NOT NULL")
