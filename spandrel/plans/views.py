"""Building-model tables made of the driver's tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.graph import containment
from ..operators.relational import Tables
from ..sources import records as rec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def elements(spark, d) -> DataFrame:
    """Parts and suppliers as the elements of two datasets."""
    part = table(spark, d, "part").select(
        F.lit("part").alias("dataset"), F.col("p_partkey").alias("express_id"), key("P", "p_partkey").alias("global_id"),
        F.concat(F.lit("Ifc"), F.initcap("p_type")).alias("ifc_class"), F.col("p_brand").alias("predefined_type"), F.col("p_name").alias("name"), F.col("p_brand").alias("type_name"),
        F.concat(F.lit("Level "), (F.col("p_size") % 5).cast("string")).alias("level"),
    )
    supplier = table(spark, d, "supplier").select(
        F.lit("supplier").alias("dataset"), F.col("s_suppkey").alias("express_id"), key("S", "s_suppkey").alias("global_id"), F.lit("IfcSupplierType").alias("ifc_class"),
        F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("predefined_type"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("type_name"),
        F.concat(F.lit("Level "), (F.col("s_nationkey") % 5).cast("string")).alias("level"),
    )
    none = F.lit(None).cast("string")
    return part.unionByName(supplier).withColumns({"level_key": tx.level_key(F.col("level")), "description": none, "object_type": none, "tag": none})


def tables(spark, d) -> Tables:
    part = table(spark, d, "part")
    value = {"Brand": F.concat(F.lit('json:"'), F.col("p_brand"), F.lit('"')), "Size": F.concat(F.lit("json:"), F.col("p_size").cast("string")), "Price": F.concat(F.lit("json:"), F.col("p_retailprice").cast("string"))}
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("n"), F.lit(name).alias("property_name"), v.alias("value")) for k, (name, v) in enumerate(value.items())]))
    own = part.select("p_partkey", entries.alias("e")).select(
        F.lit("part").alias("dataset"), F.col("p_partkey").alias("element_id"), (F.col("p_partkey") * 3 + F.col("e.n")).alias("id"), F.lit("Pset_Part").alias("pset_name"), "e.property_name", "e.value", F.lit(1).alias("is_official")
    )
    events = table(spark, d, "events").select(
        F.lit("part").alias("dataset"), F.col("user_id").alias("element_id"), (F.col("event_id") + 1_000_000_000).alias("id"), F.lit("Custom_Events").alias("pset_name"), F.lit("K").alias("property_name"),
        F.concat(F.lit("json:"), F.get_json_object("props", "$.k")).alias("value"), F.lit(0).alias("is_official"),
    )
    entries = F.explode(F.array(F.struct(F.lit(0).alias("n"), F.lit("NetPrice").alias("name"), F.col("p_retailprice").alias("v")), F.struct(F.lit(1).alias("n"), F.lit("NetSize").alias("name"), F.col("p_size").cast("double").alias("v"))))
    quantities = part.select("p_partkey", entries.alias("e")).select(
        F.lit("part").alias("dataset"), F.col("p_partkey").alias("element_id"), (F.col("p_partkey") * 2 + F.col("e.n")).alias("id"), F.lit("Qto_Part").alias("qto_name"), F.col("e.name").alias("quantity_name"), F.col("e.v").alias("value"), F.lit(1).alias("is_official")
    )
    return Tables(elements(spark, d), own.unionByName(events), quantities)


def nodes(spark, d) -> DataFrame:
    """Regions, nations and customers as containers, orders, parts and suppliers as elements, and the labels they refer to."""
    part = lambda name, id_, class_, label: table(spark, d, name).select(id_.alias("id"), class_.alias("class_"), label.cast("string").alias("label"))
    status = F.when(F.col("o_orderstatus") == "F", "IfcWall").when(F.col("o_orderstatus") == "O", "IfcDoor").otherwise("IfcBeam")
    rich = F.when(F.col("s_acctbal") > 5000, "IfcPump").otherwise("IfcFlowTerminal")
    kinds = F.when(F.col("p_brand") == "Brand#1", "IfcFan").otherwise(F.concat(F.lit("Ifc"), F.initcap("p_type")))
    out = part("region", key("R", "r_regionkey"), F.lit("IfcSite"), F.col("r_name"))
    for more in (
        part("nation", key("N", "n_nationkey"), F.lit("IfcBuilding"), F.col("n_name")), part("customer", key("C", "c_custkey"), F.lit("IfcBuildingStorey"), F.col("c_name")),
        part("orders", key("O", "o_orderkey"), status, F.col("o_orderpriority")), part("supplier", key("S", "s_suppkey"), rich, F.col("s_name")), part("part", key("P", "p_partkey"), kinds, F.col("p_name")),
        part("orders", key("Classification::", "o_orderpriority"), F.lit("Classification"), F.col("o_orderpriority")).distinct(),
    ):
        out = out.unionByName(more)
    return out


def hierarchy(spark, d) -> DataFrame:
    rows = [("nation", key("N", "n_nationkey"), key("R", "n_regionkey")), ("customer", key("C", "c_custkey"), key("N", "c_nationkey")), ("orders", key("O", "o_orderkey"), key("C", "o_custkey"))]
    parts = [table(spark, d, t).select(i.alias("id"), p.alias("parent")) for t, i, p in rows]
    return containment(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def connections(spark, d) -> DataFrame:
    """Parts and the suppliers that delivered them."""
    # numbers are compared, not the names made of them
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().select(key("P", "l_partkey").alias("src"), key("S", "l_suppkey").alias("dst"), F.lit("ifc_connected_to").alias("relation"))


def edges(spark, d) -> DataFrame:
    typed = table(spark, d, "part").select(key("P", "p_partkey").alias("src"), key("Type::", "p_brand").alias("dst"), F.lit("typed_by").alias("relation"))
    zone = table(spark, d, "customer").select(key("C", "c_custkey").alias("src"), key("Zone::", "c_mktsegment").alias("dst"), F.lit("in_zone").alias("relation"))
    class_ = table(spark, d, "orders").select(key("O", "o_orderkey").alias("src"), key("Classification::", "o_orderpriority").alias("dst"), F.lit("classified_as").alias("relation"))
    return hierarchy(spark, d).unionByName(connections(spark, d)).unionByName(typed).unionByName(zone).unionByName(class_)


def shapes(spark, d) -> DataFrame:
    """Boxes around the first three coordinates of embeddings."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.array(*[F.col("embedding")[k].cast("double") * 20 for k in range(3)]).alias("centre"), (F.lit(0.2) + F.lit(0.04) * F.col("label")).alias("w"))
    return e.select("id", "centre", F.transform("centre", lambda x: x - F.col("w")).alias("lo"), F.transform("centre", lambda x: x + F.col("w")).alias("hi"))


def axes(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    at = lambda k: F.col("embedding")[k].cast("double")
    norm = F.sqrt(at(3) * at(3) + at(4) * at(4))
    return e.where(norm > 0).select(F.col("vec_id").alias("id"), (at(0) * 20).alias("x"), (at(1) * 20).alias("y"), (at(3) / norm).alias("dx"), (at(4) / norm).alias("dy"), (F.lit(0.2) + F.lit(0.04) * F.col("label")).alias("short"))


def records(spark, d) -> DataFrame:
    """Nations as storeys, customers as spaces, orders as elements, written as lines of JSON among lines that aren't records, and read as such."""
    none = F.lit(None).cast("string")
    line = lambda name, gid, number, class_, label, parent, *more: table(spark, d, name).select(F.to_json(F.struct(gid.alias("GlobalId"), number.alias("ExpressId"), class_.alias("IfcType"), label.alias("Name"), F.struct(parent.alias("ParentId")).alias("Hierarchy"), *more)).alias("value"))
    sets = F.create_map(F.lit("Pset_Order"), F.struct(F.col("o_orderstatus").alias("Status"), F.struct(F.col("o_totalprice").alias("Amount"), F.col("o_orderpriority").alias("Priority")).alias("Price")))
    order = (
        F.struct(sets.alias("Official")).alias("PropertySets"), F.create_map(F.lit("Qto_Order"), F.struct(F.col("o_totalprice").alias("Total"))).alias("Quantities"),
        F.create_map(F.lit("classified_as"), F.array("o_orderpriority"), F.lit("hosted_by"), F.array(key("C", "o_custkey"), F.lit("gone"))).alias("Relationships"),
    )
    status = F.when(F.col("o_orderstatus") == "F", "IfcWall").when(F.col("o_orderstatus") == "O", "IfcDoor").otherwise("IfcBeam")
    lines = line("nation", key("N", "n_nationkey"), F.col("n_nationkey") + 1, F.lit("IfcBuildingStorey"), F.col("n_name"), none)
    lines = lines.unionByName(line("customer", key("C", "c_custkey"), F.col("c_custkey") + 1000, F.lit("IfcSpace"), F.col("c_name"), key("N", "c_nationkey")))
    lines = lines.unionByName(line("orders", key("O", "o_orderkey"), F.col("o_orderkey") + 100_000_000, status, F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), key("C", "o_custkey"), *order))
    odd = spark.createDataFrame([("",), ("no json",), ("[1]",), ('{"GlobalId": "X"}',)], "value string")
    return rec.parsed(lines.unionByName(odd).select(F.lit("m").alias("dataset"), F.monotonically_increasing_id().alias("line"), "value"))


#: Rows of a table of which a task makes lines.
DEALT = 20_000


def _dealt(rows: DataFrame, by: str) -> DataFrame:
    """A table's rows spread over tasks, more of them for more rows: a small file, of which much is made, is one task's otherwise."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, 1 + rows.count() // DEALT), by)


def step_parts(spark, d) -> DataFrame:
    """Customers as walls in STEP lines: their placements are relative to their nations', those to their regions'; every other nation is turned by a right angle."""
    of = lambda id_, entity, *args: F.concat(F.lit("#"), id_.cast("string"), F.lit(f"={entity}("), F.concat_ws(",", *args), F.lit(")"))
    to = lambda id_: F.concat(F.lit("#"), id_.cast("string"))
    at = lambda *xs: F.concat(F.lit("(("), F.concat_ws(".,", *[x.cast("string") for x in xs]), F.lit(".))"))
    point = lambda id_, *xs: F.concat(F.lit("#"), id_.cast("string"), F.lit("=IFCCARTESIANPOINT"), at(*xs))
    none, zero = F.lit("$"), F.lit(0)
    ways = spark.createDataFrame([("#1=IFCDIRECTION((1.,0.,0.))",), ("#2=IFCDIRECTION((0.,1.,0.))",), ("#3=IFCDIRECTION((0.,0.,1.))",)], "value string")
    r, n, c = F.col("r_regionkey"), F.col("n_nationkey"), F.col("c_custkey")
    b = c * 10 + 10_000
    ref = lambda k: F.concat(F.lit("(#"), (b + k).cast("string"), F.lit(")"))
    regions = F.array(point(r + 100, r * 1000, zero, zero), of(r + 200, "IFCAXIS2PLACEMENT3D", to(r + 100), none, none), of(r + 300, "IFCLOCALPLACEMENT", none, to(r + 200)))
    nations = F.array(
        point(n + 1000, n * 10, n * 5, n), of(n + 2000, "IFCAXIS2PLACEMENT3D", to(n + 1000), to(F.lit(3)), F.when(n % 2 == 1, "#2").otherwise("#1")), of(n + 3000, "IFCLOCALPLACEMENT", to(F.col("n_regionkey") + 300), to(n + 2000)),
    )
    walls = F.array(
        point(b, c % 100, c % 7, zero), of(b + 1, "IFCAXIS2PLACEMENT3D", to(b), none, none), of(b + 2, "IFCLOCALPLACEMENT", to(F.col("c_nationkey") + 3000), to(b + 1)), of(b + 3, "IFCRECTANGLEPROFILEDEF", F.lit(".AREA."), none, none, F.lit("2."), F.lit("1.")),
        of(b + 4, "IFCEXTRUDEDAREASOLID", to(b + 3), none, to(F.lit(3)), F.lit("3.")), of(b + 5, "IFCSHAPEREPRESENTATION", none, F.lit("'Body'"), F.lit("'SweptSolid'"), ref(4)), of(b + 6, "IFCPRODUCTDEFINITIONSHAPE", none, none, ref(5)),
        of(b + 7, "IFCWALL", F.concat(F.lit("'C"), c.cast("string"), F.lit("'")), none, F.concat(F.lit("'a; (''"), F.col("c_name"), F.lit("'')'")), none, none, to(b + 2), to(b + 6), none, none),
    )
    many = [rows.select(F.explode(v).alias("value")) for rows, v in ((table(spark, d, "region"), regions), (table(spark, d, "nation"), nations), (_dealt(table(spark, d, "customer"), "c_custkey"), walls))]
    lines = ways.unionByName(many[0]).unionByName(many[1]).unionByName(many[2])
    return lines.select(F.lit("m").alias("dataset"), F.monotonically_increasing_id().alias("line"), "value")


def runs(spark, d) -> DataFrame:
    """Events as evaluation runs."""
    v = F.col("value")
    return table(spark, d, "events").select(
        F.col("user_id").alias("profile"), F.col("event_type").alias("case_id"), (v >= 5).alias("answer_correct"), (F.col("event_type") != "view").alias("route_correct"),
        (F.col("event_type") != "error").alias("no_error"), v.alias("duration_ms"), F.when(v >= 1, F.floor(v)).alias("tokens"),
    )


# The same in SQL.
ELEMENTS = """(SELECT 'part' AS dataset, p_partkey AS express_id, 'P' || p_partkey AS global_id, 'Ifc' || substr(p_type, 1, 1) || lower(substr(p_type, 2)) AS ifc_class, p_brand AS predefined_type,
 p_name AS name, p_brand AS type_name, 'Level ' || (p_size % 5) AS level, 'level ' || (p_size % 5) AS level_key FROM part
 UNION ALL SELECT 'supplier', s_suppkey, 'S' || s_suppkey, 'IfcSupplierType', 'Nation ' || s_nationkey, s_name, NULL, 'Level ' || (s_nationkey % 5), 'level ' || (s_nationkey % 5) FROM supplier)"""
NODES = """(SELECT 'R' || r_regionkey AS id, 'IfcSite' AS class_, r_name AS label FROM region UNION ALL SELECT 'N' || n_nationkey, 'IfcBuilding', n_name FROM nation
 UNION ALL SELECT 'C' || c_custkey, 'IfcBuildingStorey', c_name FROM customer
 UNION ALL SELECT 'O' || o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'IfcWall' WHEN 'O' THEN 'IfcDoor' ELSE 'IfcBeam' END, o_orderpriority FROM orders
 UNION ALL SELECT 'S' || s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'IfcPump' ELSE 'IfcFlowTerminal' END, s_name FROM supplier
 UNION ALL SELECT 'P' || p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'IfcFan' ELSE 'Ifc' || substr(p_type, 1, 1) || lower(substr(p_type, 2)) END, p_name FROM part
 UNION ALL SELECT DISTINCT 'Classification::' || o_orderpriority, 'Classification', o_orderpriority FROM orders)"""
DOWN = """(SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders)"""
LINKS = """(SELECT DISTINCT 'P' || l_partkey AS p, 'S' || l_suppkey AS s FROM lineitem)"""
EDGES = f"""(SELECT src, dst, 'contains' AS relation FROM {DOWN} UNION ALL SELECT dst, src, 'contained_in' FROM {DOWN} UNION ALL SELECT p, s, 'ifc_connected_to' FROM {LINKS}
 UNION ALL SELECT 'P' || p_partkey, 'Type::' || p_brand, 'typed_by' FROM part UNION ALL SELECT 'C' || c_custkey, 'Zone::' || c_mktsegment, 'in_zone' FROM customer
 UNION ALL SELECT 'O' || o_orderkey, 'Classification::' || o_orderpriority, 'classified_as' FROM orders)"""
SHAPES = """(SELECT id, x, y, z, x - w AS x0, x + w AS x1, y - w AS y0, y + w AS y1, z - w AS z0, z + w AS z1 FROM (SELECT vec_id AS id, embedding[1]::DOUBLE * 20 AS x, embedding[2]::DOUBLE * 20 AS y,
 embedding[3]::DOUBLE * 20 AS z, 0.2::DOUBLE + 0.04::DOUBLE * label AS w FROM embeddings))"""
RUNS = """(SELECT user_id AS profile, event_type AS case_id, value >= 5 AS answer_correct, event_type <> 'view' AS route_correct, event_type <> 'error' AS no_error, value AS duration_ms,
 CASE WHEN value >= 1 THEN floor(value) END AS tokens FROM events)"""
