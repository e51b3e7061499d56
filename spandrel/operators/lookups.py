"""Looking up elements and their fields by identifiers, filling gaps, ancestors, samples and lines for display."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from . import relational
from .graph import walk
from .relational import Tables
from .request import Field

# Spellings of element columns, without case and underscores.
COLUMNS = {"expressid": "express_id", "globalid": "global_id", "class": "ifc_class", "ifcclass": "ifc_class", "predefinedtype": "predefined_type", "name": "name", "description": "description", "objecttype": "object_type", "tag": "tag", "level": "level", "levelkey": "level_key", "typename": "type_name"}


def by_identifiers(elements: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, dataset, express_id): elements that identifiers (wanted) mean, by global id first, else by express id. Two equi-joins; an OR would compare all with all."""
    by_global = wanted.join(elements.select("dataset", "express_id", F.col("global_id").alias("wanted")), "wanted")
    rest = wanted.join(by_global.select("wanted").distinct(), "wanted", "left_anti")
    by_express = rest.withColumn("express_id", F.col("wanted").try_cast("long")).join(elements.select("dataset", "express_id"), "express_id")
    return by_global.select("wanted", "dataset", "express_id").unionByName(by_express.select("wanted", "dataset", "express_id"))


def field_values(tables: Tables, ids: DataFrame, name: str) -> DataFrame:
    """(dataset, express_id, source, text, number) of a field for elements: an own column, else a property, else a quantity."""
    column = COLUMNS.get(name.lower().replace("_", ""))
    if column:
        rows = tables.elements.join(ids.select("dataset", "express_id"), ["dataset", "express_id"], "left_semi")
        return rows.select("dataset", "express_id", F.lit("element").alias("source"), F.col(column).cast("string").alias("text"), F.lit(None).cast("double").alias("number"))
    found = None
    for rank, source in enumerate(("property", "quantity")):
        rows = relational.first_values(tables, Field(source, name)).join(ids.select("dataset", "express_id"), ["dataset", "express_id"], "left_semi")
        rows = rows.select("dataset", "express_id", F.lit(source).alias("source"), F.lit(rank).alias("_rank"), "text", "number")
        found = rows if found is None else found.unionByName(rows)
    w = Window.partitionBy("dataset", "express_id").orderBy("_rank")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def nested(tables: Tables, name: str) -> DataFrame:
    """(dataset, express_id, text, number) of a property by name, by set and name, or at a path inside a nested value of either: every reading of the dots counts."""
    parts, readings = name.split("."), []
    for depth in range(1, len(parts) + 1):
        head, path = parts[:depth], parts[depth:]
        for group, own in [("", head)] + ([(head[0], head[1:])] if depth > 1 else []):
            fits = F.col("property_name") == ".".join(own)
            value = F.concat(F.lit("json:"), values.at_path(F.col("value"), ".".join(path))) if path else F.col("value")
            readings.append((fits & (F.col("pset_name") == group) if group else fits, value))
    # all readings of one scan; a generator's output is a column of its own: the long expression isn't repeated in each place that reads it
    rows = tables.properties.where(reduce(or_, [fits for fits, _ in readings]))
    rows = rows.select(*tables.key, F.col("element_id").alias("express_id"), F.explode(F.array(*[F.when(fits, value) for fits, value in readings])).alias("_value")).where("_value IS NOT NULL")
    text, number = relational.decoded(F.col("_value"))
    rows = rows.select(*tables.key, "express_id", F.explode(F.array(F.struct(text.alias("text"), number.alias("number")))).alias("_v"))
    return rows.select(*tables.key, "express_id", "_v.text", "_v.number").where("text IS NOT NULL OR number IS NOT NULL")


def filled(stated: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Stated values (key, name, value) with stored ones where a name is missing or null."""
    names = [*key, "name"]
    both = stated.withColumnRenamed("value", "a").join(stored.withColumnRenamed("value", "b"), names, "full_outer")
    return both.select(*names, F.coalesce("a", "b").alias("value"))


def class_ancestors(pairs: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, ancestor, distance) from (child, parent), nearest first; cycles end."""
    move = pairs.select(F.col("child").alias("a"), F.col("parent").alias("b"))
    seeds = pairs.select(F.col("child").alias("id")).distinct()
    return walk(move, seeds, depth).where("depth > 0").select(F.col("seed").alias("id"), F.col("id").alias("ancestor"), F.col("depth").alias("distance"))


def pruning(nodes: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """(class_, n, skipped): how many nodes derived phases see, and leave out."""
    return nodes.groupBy("class_").agg(F.count("*").alias("n")).withColumn("skipped", F.when(F.col("class_").isin(*excluded), F.col("n")).otherwise(F.lit(0)))


def samples(rows: DataFrame, group: str, order: list[str], k: int = 3) -> DataFrame:
    """The first k rows of each group."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("ordinal", F.row_number().over(w)).where(F.col("ordinal") <= k)


def lines(rows: DataFrame, columns: list[str], order: list[str], shown: int = 10) -> DataFrame:
    """(rank, line, more_count): the first rows as text, and how many are not shown."""
    total = rows.agg(F.count("*").alias("total"))
    top = rows.orderBy(*order).limit(shown).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    line = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
    return top.crossJoin(F.broadcast(total)).select("rank", line.alias("line"), F.greatest(F.col("total") - shown, F.lit(0)).alias("more_count"))
