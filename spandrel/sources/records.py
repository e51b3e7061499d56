"""Element records (JSON lines) to relational tables and graph tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.graph import canonical, containment, counted, sent
from ..operators.relational import Tables
from ..operators.staging import staged

_ATTRIBUTES = "MAP<STRING, MAP<STRING, VARIANT>>"
SCHEMA = f"""GlobalId STRING, ExpressId BIGINT, Name STRING, IfcType STRING, ClassRaw STRING, BaseClasses ARRAY<STRING>, PredefinedType STRING, Description STRING,
ObjectType STRING, Tag STRING, TypeName STRING, Hierarchy STRUCT<ParentId: STRING, ParentType: STRING, Level: STRING, Path: ARRAY<STRING>>,
Geometry STRUCT<Centroid: ARRAY<DOUBLE>, BoundingBox: STRUCT<min: ARRAY<DOUBLE>, max: ARRAY<DOUBLE>>, FootprintPolygon2D: ARRAY<ARRAY<DOUBLE>>,
MeshVertices: ARRAY<ARRAY<DOUBLE>>, OrientedBoundingBox: STRUCT<center: ARRAY<DOUBLE>, extents: ARRAY<DOUBLE>, corners_xy: ARRAY<ARRAY<DOUBLE>>>>,
Materials ARRAY<STRING>, PropertySets STRUCT<Official: {_ATTRIBUTES}, Custom: {_ATTRIBUTES}>, Quantities {_ATTRIBUTES}, Relationships MAP<STRING, ARRAY<STRING>>"""
# Relation names in records whose targets are elements, and those whose targets are labels with the class of the label's node.
ELEMENT_RELATIONS = ("hosts", "hosted_by", "ifc_connected_to", "typed_by", "space_bounded_by", "bounds_space", "path_connected_to")
CONTEXT_RELATIONS = {"belongs_to_system": "System", "in_zone": "Zone", "classified_as": "Classification"}


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """Records with dataset (the file's stem) and line (a number that grows along a file). Blank lines, lines that are no JSON object and records without ExpressId go."""
    lines = spark.read.text(list(paths)).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("dataset"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value")
    )
    return parsed(lines)


def parsed(lines: DataFrame) -> DataFrame:
    """Records of lines (dataset, line, value). Each line is parsed once, and its record written by columns, as tables and graph read records many times."""
    # a generator's output is a column of its own: the parser isn't repeated in the condition
    whole = lines.where("value <> ''").select("dataset", "line", F.explode(F.array(F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}))).alias("r"))
    return staged(whole.where("r.ExpressId IS NOT NULL").select("dataset", "line", "r.*"))


def first_per(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of each key that comes first in an order, numbers that no two rows share. Only keys that come again are looked up, so that rows stay where they are while those are few, and as they are without any."""
    ordered = rows.withColumn("_order", order)
    again = staged(ordered.groupBy(*keys).agg(F.min("_order").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    n = counted(again)
    return ordered.join(sent(again, n), keys, "left").where("_first IS NULL OR _first = _order").drop("_first", "_order") if n else rows


def elements(records: DataFrame) -> DataFrame:
    """The elements table: a key that comes again loses to the first; a record needs a GlobalId and a class."""
    level = F.col("Hierarchy.Level")
    rows = records.where("GlobalId IS NOT NULL AND IfcType IS NOT NULL")
    rows = first_per(first_per(rows, ["dataset", "ExpressId"], F.col("line")), ["dataset", "GlobalId"], F.col("line"))
    names = {"PredefinedType": "predefined_type", "Name": "name", "Description": "description", "ObjectType": "object_type", "Tag": "tag"}
    return rows.select(
        "dataset", F.col("ExpressId").alias("express_id"), F.col("GlobalId").alias("global_id"), F.col("IfcType").alias("ifc_class"),
        *[tx.blank_to_null(F.col(a)).alias(b) for a, b in names.items()], tx.blank_to_null(level).alias("level"), tx.level_key(level).alias("level_key"), tx.blank_to_null(F.col("TypeName")).alias("type_name"),
    )


def _attributes(records: DataFrame, sets: list[tuple[Column, Callable]], value: Callable, kind: str) -> DataFrame:
    """(dataset, element_id, set_name, name, value, is_official, id) of the members of records' sets, each with a function that tells official ones by their name. All of a record's members lie in its row, so
    their numbers (official ones first, then by names) are places in a sorted array."""
    none = F.array().cast(f"array<struct<other: int, set_name: string, name: string, value: {kind}>>")

    def flat(own: Column, official: Callable) -> Column:
        member = lambda s: lambda m: F.struct((1 - official(s["key"])).alias("other"), s["key"].alias("set_name"), m["key"].alias("name"), value(m["value"]).alias("value"))
        members = lambda s: F.transform(F.filter(F.map_entries(s["value"]), lambda m: m["key"] != "id"), member(s))
        return F.coalesce(F.flatten(F.transform(F.filter(F.map_entries(own), lambda s: s["value"].isNotNull()), members)), none)

    parts = [flat(own, official) for own, official in sets]
    rows = records.select("dataset", F.col("ExpressId").alias("element_id"), F.posexplode(F.array_sort(F.concat(*parts))).alias("n", "m"))
    return rows.select("dataset", "element_id", "m.set_name", "m.name", "m.value", (1 - F.col("m.other")).alias("is_official"), (F.col("n") + 1).cast("long").alias("id"))


def tables(records: DataFrame) -> Tables:
    """Elements, properties and quantities; attributes of records that lost their key go with them. Joins with them are merges unless the other side is sent: Spark takes some columns of the written records
    for a few MB, as a variant counts much in a row and keys take little room on disk, and would send millions of rows through the driver."""
    own = elements(records)
    kept = first_per(records, ["dataset", "ExpressId"], F.col("line"))
    lost = staged(kept.select("dataset", "ExpressId").join(own.select("dataset", F.col("express_id").alias("ExpressId")).hint("merge"), ["dataset", "ExpressId"], "left_anti"))
    n = counted(lost)
    kept = kept.join(sent(lost, n), ["dataset", "ExpressId"], "left_anti") if n else kept
    sets = [(F.col("PropertySets.Official"), lambda name: F.lit(1)), (F.col("PropertySets.Custom"), lambda name: F.lit(0))]
    properties = _attributes(kept, sets, lambda x: F.concat(F.lit("json:"), F.to_json(x)), "string").withColumnsRenamed({"set_name": "pset_name", "name": "property_name"})
    sets = [(F.col("Quantities"), lambda name: name.startswith("Qto_").cast("int"))]
    quantities = _attributes(kept, sets, lambda x: F.try_variant_get(x, "$", "double"), "double").withColumnsRenamed({"set_name": "qto_name", "name": "quantity_name"})
    return Tables(own.hint("merge"), properties.hint("merge"), quantities.hint("merge"))


def write(records: DataFrame, folder: str) -> None:
    """Records as JSON lines, a folder for each dataset; null fields are left out."""
    body = [c for c in records.columns if c not in ("dataset", "line")]
    records.select("dataset", F.to_json(F.struct(*body)).alias("value")).write.mode("overwrite").partitionBy("dataset").text(folder)


def node_id(dataset: Column, class_: Column, gid: Column) -> Column:
    """A dataset has one project and one building, whatever records describe them."""
    place = F.when(class_ == "IfcBuildingStorey", "Storey").otherwise("Element")
    single = F.when(class_ == "IfcProject", "Project").when(class_ == "IfcBuilding", "Building")
    return F.when(single.isNotNull(), F.concat_ws("::", single, dataset)).otherwise(F.concat_ws("::", place, dataset, gid))


def ring(points: Column) -> Column:
    """A polygon of arrays (x, y) as structs, without a last corner that repeats the first; null under three corners."""
    corners = F.transform(F.filter(points, lambda p: F.size(p) >= 2), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    open_ = F.when((F.size(corners) > 1) & (F.element_at(corners, 1) == F.element_at(corners, -1)), F.slice(corners, 1, F.size(corners) - 1)).otherwise(corners)
    return F.when(F.size(open_) >= 3, open_)


def graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): elements, the labels they refer to, and a project and a building for each dataset, stated or not; the last record of an identifier wins; targets are sought in the same
    dataset, others and loops go. The project aggregates the building, the building the storeys; parents contain."""
    rows = records.where("GlobalId IS NOT NULL")
    rows = first_per(rows, ["dataset", "GlobalId"], -F.col("line"))
    class_ = F.coalesce("IfcType", "ClassRaw", F.lit("IfcProduct"))
    me = node_id(F.col("dataset"), class_, F.col("GlobalId"))
    # as many as there are records, however small Spark takes them for: merged, never sent through the driver
    named = rows.select("dataset", F.col("GlobalId").alias("target"), me.alias("dst")).hint("merge")
    rows = first_per(rows.withColumn("_me", me), ["_me"], -F.col("line")).drop("_me")
    box = F.col("Geometry.BoundingBox")
    whole = (F.size(box["min"]) == 3) & (F.size(box["max"]) == 3)
    nodes = rows.select(
        "dataset", me.alias("id"), F.coalesce("Name", "GlobalId").alias("label"), class_.alias("class_"), F.col("GlobalId").alias("global_id"), F.col("ExpressId").alias("express_id"),
        tx.level_key(F.col("Hierarchy.Level")).alias("level_key"), F.when(F.size("Geometry.Centroid") == 3, F.col("Geometry.Centroid")).alias("centre"),
        F.when(whole, box["min"]).alias("lo"), F.when(whole, box["max"]).alias("hi"), "Materials", F.coalesce(ring(F.col("Geometry.FootprintPolygon2D")), ring(F.col("Geometry.OrientedBoundingBox.corners_xy"))).alias("footprint"),
        F.col("Geometry.MeshVertices").alias("mesh"), tx.blank_to_null(F.col("TypeName")).alias("type_name"), tx.blank_to_null(F.col("ObjectType")).alias("object_type"), tx.blank_to_null(F.col("Description")).alias("description"),
    )
    datasets = records.select("dataset").distinct()
    single = lambda kind: datasets.select("dataset", F.concat_ws("::", F.lit(kind), "dataset").alias("id"), F.lit(kind).alias("label"), F.lit("Ifc" + kind).alias("class_"))
    missing = single("Project").unionByName(single("Building")).join(nodes.where(F.col("class_").isin("IfcProject", "IfcBuilding")).select("id"), "id", "left_anti")
    aggregates = datasets.select(F.concat_ws("::", F.lit("Project"), "dataset").alias("src"), F.concat_ws("::", F.lit("Building"), "dataset").alias("dst"), F.lit("aggregates").alias("relation"))
    storeys = nodes.where("class_ = 'IfcBuildingStorey'").select(F.concat_ws("::", F.lit("Building"), "dataset").alias("src"), F.col("id").alias("dst"), F.lit("aggregates").alias("relation"))
    parents = rows.select("dataset", me.alias("id"), F.col("Hierarchy.ParentId").alias("target")).join(named, ["dataset", "target"]).select("id", F.col("dst").alias("parent")).where("id <> parent")
    stated = rows.select("dataset", me.alias("src"), F.explode("Relationships").alias("relation", "targets")).select("dataset", "src", "relation", F.explode("targets").alias("target"))
    direct = stated.where(F.col("relation").isin(*ELEMENT_RELATIONS)).join(named, ["dataset", "target"]).select("src", "dst", "relation")
    label = tx.context_label(F.col("target"))
    context = stated.where(F.col("relation").isin(*CONTEXT_RELATIONS)).withColumn("label", label).where("label IS NOT NULL")
    kind = F.create_map(*[F.lit(x) for kv in CONTEXT_RELATIONS.items() for x in kv])[F.col("relation")]
    context = context.withColumns({"class_": kind, "dst": F.concat_ws("::", kind, "dataset", "label")})
    labels = context.select("dataset", F.col("dst").alias("id"), "label", "class_").distinct()
    edges = containment(parents).unionByName(aggregates).unionByName(storeys).unionByName(canonical(direct.unionByName(context.select("src", "dst", "relation"))))
    return nodes.unionByName(missing, allowMissingColumns=True).unionByName(labels, allowMissingColumns=True), edges
