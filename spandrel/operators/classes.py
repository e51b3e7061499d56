"""Class hierarchies as intervals: a class and all its subtypes are a range of numbers.

Every way from a root down to a class has a place in the order of ways, and what lies below it follows it without a gap. So a class has one number for each way (one in a tree, several where it has several
parents), and its subtypes are the classes with a number in the range of any one of its ways. Hierarchies are as large as a schema, not as the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import kept


def closure(pairs: DataFrame) -> DataFrame:
    """(child, parent, distance) of all ancestors, from direct ones, by squaring: each round joins what is known with itself, so chains twice as long are covered. Cycles end; no class is its own ancestor."""
    known = kept(pairs.where("child <> parent").select("child", "parent", F.lit(1).alias("distance")).distinct())
    n = known.count()
    while n:
        up = known.select(F.col("child").alias("parent"), F.col("parent").alias("next"), F.col("distance").alias("more"))
        longer = known.join(up, "parent").where("child <> next").select("child", F.col("next").alias("parent"), (F.col("distance") + F.col("more")).alias("distance"))
        known = kept(known.unionByName(longer).groupBy("child", "parent").agg(F.min("distance").alias("distance")))
        before, n = n, known.count()
        if n == before:
            break
    return known


def intervals(pairs: DataFrame) -> DataFrame:
    """(class_, first, last), one row for each way from a root to a class: first is its place in depth-first order, and first to last the places of it and all below it.

    A class that a cycle leads back to is not entered again; classes on cycles that no root leads to have no interval.
    """
    pairs = kept(pairs.where("child <> parent AND child IS NOT NULL AND parent IS NOT NULL").select("child", "parent").distinct())
    names = pairs.select(F.col("child").alias("class_")).unionByName(pairs.select(F.col("parent").alias("class_"))).distinct()
    roots = names.join(pairs.select(F.col("child").alias("class_")), "class_", "left_anti")
    front = kept(roots.select("class_", F.array("class_").alias("way")))
    ways = front
    while not front.isEmpty():
        down = front.join(pairs, F.col("class_") == F.col("parent")).where(~F.array_contains("way", F.col("child")))
        front = kept(down.select(F.col("child").alias("class_"), F.concat("way", F.array("child")).alias("way")))
        ways = ways.unionByName(front)
    # what is below a way are the ways that begin with it
    below = ways.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("way")), lambda k: F.slice("way", 1, k))).alias("way")).groupBy("way").agg(F.count("*").alias("n"))
    placed = ways.withColumn("first", F.row_number().over(Window.orderBy("way")).cast("long"))
    return placed.join(below, "way").select("class_", "first", (F.col("first") + F.col("n") - 1).alias("last"))


def subtypes(spans: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class_, subtype): each wanted class_ with itself and all below it, by a range join; one way of a class is enough, as all its ways hold the same subtypes."""
    one = spans.groupBy("class_").agg(F.min(F.struct("first", "last")).alias("s")).join(wanted.select("class_").distinct(), "class_")
    inside = one.join(spans.select(F.col("class_").alias("subtype"), F.col("first").alias("place")), F.col("place").between(F.col("s.first"), F.col("s.last")))
    alone = wanted.select("class_", F.col("class_").alias("subtype"))
    return inside.select("class_", "subtype").unionByName(alone).distinct()
