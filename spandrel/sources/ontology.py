"""Class hierarchies from JSON: an object of class to its ancestors, nearest first, or to its parent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "child string, parent string"


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """(child, parent) of the files' classes; with no file, or none that can be read as such an object, no rows: classes then have no known ancestors."""
    if not paths:
        return spark.createDataFrame([], _SCHEMA)
    text = spark.read.text(list(paths), wholetext=True).withColumn("many", F.from_json("value", "map<string, array<string>>")).withColumn("one", F.from_json("value", "map<string, string>"))
    chains = text.select(F.explode("many").alias("child", "up")).where(F.size("up") > 0)
    steps = chains.select(F.explode(F.arrays_zip(F.concat(F.array("child"), F.expr("slice(up, 1, size(up) - 1)")).alias("child"), F.col("up").alias("parent"))).alias("s")).select("s.child", "s.parent")
    single = text.where("many IS NULL OR size(many) = 0 OR NOT exists(map_values(many), v -> v IS NOT NULL)").select(F.explode("one").alias("child", "parent"))
    return steps.unionByName(single.where("parent IS NOT NULL AND NOT parent LIKE '[%'")).where("child IS NOT NULL AND child <> parent").distinct()
