"""Queries of the engine on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, values
from ..functions import text as tx
from ..operators import classes, evals, graph, lookups, paths, relational, search, spatial
from ..operators.request import Field, Filter, Request
from ..operators.staging import kept, staged
from ..sources import records as rec
from ..sources import step, step_check, step_model
from ..streaming import windows
from . import router
from . import views as v
from .model import Model

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _at(part: str) -> str:
    return f"{v.ELEMENTS} e WHERE {part}"


# Relational requests


@query(f"SELECT count(DISTINCT (dataset, express_id)) AS count FROM {_at("ifc_class = 'IfcStandard' AND level_key = 'level 2'")}")
def count_class_level(s, d):
    return relational.count(v.tables(s, d), Request("count", "standard", "floor 2"))


@query(f"SELECT DISTINCT dataset, express_id, global_id, ifc_class, predefined_type, name, level FROM {_at("ifc_class = 'IfcPromo'")} ORDER BY name NULLS FIRST, ifc_class, global_id, express_id LIMIT 50")
def list_elements(s, d):
    return relational.listing(v.tables(s, d), Request("list", "promo", limit=50))


_QTY = "SELECT {how} AS value, count(*) AS matched_count, 0::BIGINT AS missing_count FROM part WHERE {where}"


def _rounded(df):
    return df.select(F.round("value", 4).alias("value"), "matched_count", "missing_count")


@query("SELECT round(sum(p_retailprice), 4) AS value, count(*) AS matched_count, 0::BIGINT AS missing_count FROM part WHERE p_type = 'SMALL'")
def agg_sum_quantity(s, d):
    return _rounded(relational.aggregate(v.tables(s, d), Request("aggregate", "small", aggregate_op="sum", aggregate_field=Field("quantity", "Qto_Part.NetPrice"))))


@query("SELECT round(avg(p_size), 4) AS value, count(*) AS matched_count, (SELECT count(*) FROM supplier) AS missing_count FROM part")
def agg_avg_property(s, d):
    return _rounded(relational.aggregate(v.tables(s, d), Request("aggregate", aggregate_op="avg", aggregate_field=Field("property", "Size"))))


@query("SELECT 'min' AS op, min(p_retailprice) AS value FROM part WHERE p_size % 5 = 3 UNION ALL SELECT 'max', max(p_retailprice) FROM part WHERE p_size % 5 = 3")
def agg_min_max(s, d):
    t = v.tables(s, d)
    one = lambda op: relational.aggregate(t, Request("aggregate", level="Level 03", aggregate_op=op, aggregate_field=Field("quantity", "NetPrice"))).select(F.lit(op).alias("op"), "value")
    return one("min").unionByName(one("max"))


@query(f"SELECT ifc_class AS value, count(DISTINCT (dataset, express_id)) AS count FROM {v.ELEMENTS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def group_by_element(s, d):
    return relational.group(v.tables(s, d), Request("group", group_by=Field("element", "ifc_class")))


@query("SELECT p_brand AS value, count(*) AS count FROM part WHERE p_type = 'MEDIUM' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def group_by_property(s, d):
    return relational.group(v.tables(s, d), Request("group", "Medium", group_by=Field("property", "Pset_Part.Brand")))


@query("SELECT count(*) AS count FROM part WHERE p_brand = 'Brand#12'")
def filter_property_exists(s, d):
    return relational.count(v.tables(s, d), Request("count", filters=(Filter("property", "Pset_Part.Brand", "eq", "Brand#12"),)))


@query("SELECT count(*) AS count FROM part WHERE p_retailprice >= 950 AND p_size < 20")
def filter_quantity_exists(s, d):
    return relational.count(v.tables(s, d), Request("count", filters=(Filter("quantity", "NetPrice", "gte", 950), Filter("quantity", "Qto_Part.NetSize", "lt", 20))))


@query("SELECT p_name AS name, count(*) AS n FROM part WHERE list_contains(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+'), 'red') GROUP BY 1")
def text_token_match(s, d):
    return relational.scope(v.tables(s, d), Request("list", text_match="Red")).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT 'named' AS kind, count(*) AS n FROM part WHERE p_name ILIKE '%bolt%' UNION ALL SELECT 'suppliers', 0::BIGINT UNION ALL SELECT 'by_class', count(*) FROM supplier WHERE s_name ILIKE '%supplier%'")
def type_row_exclusion(s, d):
    t = v.tables(s, d)
    n = lambda kind, r: relational.scope(t, r).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    name = lambda p: (Filter("element", "name", "like", p),)
    return n("named", Request("count", filters=name("%Bolt%"))).unionByName(n("suppliers", Request("count", filters=name("%SUPPLIER%")))).unionByName(n("by_class", Request("count", "SupplierType", filters=name("%supplier%"))))


@query("""SELECT user_id AS express_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS number FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""")
def first_value_window(s, d):
    return relational.first_values(v.tables(s, d), Field("property", "K")).select("express_id", "number")


@query(f"SELECT dataset, count(*) AS n, round(avg(express_id), 6) AS mean_id, min(name) AS first_name FROM {v.ELEMENTS} GROUP BY 1 UNION ALL SELECT 'all', count(*), round(avg(express_id), 6), min(name) FROM {v.ELEMENTS}")
def multi_dataset_merge(s, d):
    e = v.elements(s, d)
    figures = (F.count("*").alias("n"), F.round(F.avg("express_id"), 6).alias("mean_id"), F.min("name").alias("first_name"))
    return e.groupBy("dataset").agg(*figures).unionByName(e.agg(F.lit("all").alias("dataset"), *figures))


_KEYS = """SELECT k AS key, count(DISTINCT e) AS n_elements FROM (SELECT unnest(['Brand', 'Size', 'Price', 'Pset_Part.Brand', 'Pset_Part.Size', 'Pset_Part.Price', 'NetPrice', 'NetSize', 'Qto_Part.NetPrice', 'Qto_Part.NetSize']) AS k,
 p_partkey AS e FROM part UNION ALL SELECT unnest(['K', 'Custom_Events.K']), user_id FROM events) GROUP BY 1"""


@query(_KEYS)
def attribute_keys(s, d):
    return relational.attribute_keys(v.tables(s, d)).select("key", "n_elements")


@query("""SELECT 'Pset_Order.Price.Amount' AS key, count(*) AS n_elements, NULL AS first_sample FROM orders UNION ALL SELECT 'Pset_Order.Price.Priority', count(*), 'json:"' || min(o_orderpriority) || '"' FROM orders""")
def nested_keys(s, d):
    rows = relational.attribute_keys(rec.tables(v.records(s, d))).where("key LIKE 'Pset_Order.Price.%'")
    return rows.select("key", "n_elements", F.when(F.col("key").endswith("Priority"), F.get("samples", F.lit(0))).alias("first_sample"))


@query("SELECT 'level ' || p_size AS level_key, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT 'ground floor', count(*) FROM part UNION ALL SELECT 'basement ' || s_nationkey, count(*) FROM supplier GROUP BY 1")
def canonical_levels(s, d):
    size = F.col("p_size").cast("string")
    part = v.table(s, d, "part")
    raw = part.select(F.concat(F.lit("  Floor_0"), size).alias("raw")).unionByName(part.select(F.concat(F.lit("GROUND-Level / "), size).alias("raw")))
    raw = raw.unionByName(v.table(s, d, "supplier").select(F.concat(F.lit("Basement.00"), F.col("s_nationkey").cast("string")).alias("raw")))
    return raw.groupBy(tx.level_key(F.col("raw")).alias("level_key")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS element_id, 'Brand' AS property_name, 'json:\"' || p_brand || '\"' AS value FROM part UNION ALL SELECT p_partkey, 'Size', 'json:' || p_size FROM part")
def eav_unpivot(s, d):
    return v.tables(s, d).properties.where(F.col("property_name").isin("Brand", "Size")).select("element_id", "property_name", "value")


@query("SELECT CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS prefix, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 0.0, count(*) FROM customer")
def numeric_prefixes(s, d):
    both = v.table(s, d, "orders").select(F.col("o_orderpriority").alias("t")).unionAll(v.table(s, d, "customer").select("c_name"))
    return both.groupBy(tx.numeric_prefix(F.col("t")).alias("prefix")).agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM part) AS matched_count, (SELECT count(*) FROM supplier) AS missing_count")
def field_coverage(s, d):
    return relational.coverage(v.tables(s, d), Request("count"), Field("element", "type_name"))


@query("SELECT p_partkey AS element_id, 'Brand=' || p_brand || ';Size=' || p_size AS attributes FROM part")
def element_properties(s, d):
    p = v.tables(s, d).properties.where(F.col("property_name").isin("Brand", "Size"))
    text, number = relational.decoded(F.col("value"))
    shown = F.concat_ws("=", "property_name", F.coalesce(text, number.cast("long").cast("string")))
    return p.groupBy("element_id").agg(F.array_join(F.array_sort(F.collect_list(shown)), ";").alias("attributes"))


@query(f"SELECT s AS supplier, count(*) AS n, round(sum(p_retailprice), 4) AS total, min(p_retailprice) AS least, max(p_retailprice) AS most FROM {v.LINKS} JOIN part ON p = 'P' || p_partkey GROUP BY 1")
def aggregate_id_sets(s, d):
    prices = v.table(s, d, "part").select(v.key("P", "p_partkey").alias("src"), "p_retailprice")
    price = F.col("p_retailprice")
    return v.connections(s, d).join(prices, "src").groupBy(F.col("dst").alias("supplier")).agg(F.count("*").alias("n"), F.round(F.sum(price), 4).alias("total"), F.min(price).alias("least"), F.max(price).alias("most"))


@query(f"SELECT p_brand AS value, count(DISTINCT p) AS count FROM {v.LINKS} JOIN part ON p = 'P' || p_partkey JOIN supplier ON s = 'S' || s_suppkey WHERE s_acctbal > 5000 GROUP BY 1")
def group_id_set(s, d):
    pumps = v.table(s, d, "supplier").where("s_acctbal > 5000").select(v.key("S", "s_suppkey").alias("dst"))
    ids = v.connections(s, d).join(pumps, "dst", "left_semi").select("src").distinct()
    brands = v.table(s, d, "part").select(v.key("P", "p_partkey").alias("src"), "p_brand")
    return ids.join(brands, "src").groupBy(F.col("p_brand").alias("value")).agg(F.count("*").alias("count"))


@query("SELECT p_partkey AS express_id, p_name AS name, p_size AS size, (SELECT count(*) FROM part WHERE p_size > 45) AS total_found FROM part WHERE p_size > 45 ORDER BY p_name, p_partkey LIMIT 25")
def find_nodes_bounded(s, d):
    hits = v.table(s, d, "part").where("p_size > 45").select(F.col("p_partkey").alias("express_id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return relational.bounded(hits, [F.asc("name"), F.asc("express_id")], 25).select("express_id", "name", "size", "total_found")


@query("SELECT 'P' || p_partkey AS wanted, p_partkey AS express_id FROM part WHERE p_size = 7 UNION ALL SELECT p_partkey::VARCHAR, p_partkey FROM part WHERE p_size = 8")
def id_lookup(s, d):
    part = v.table(s, d, "part")
    wanted = part.where("p_size = 7").select(v.key("P", "p_partkey").alias("wanted")).unionByName(part.where("p_size = 8").select(F.col("p_partkey").cast("string").alias("wanted")))
    return lookups.by_identifiers(v.elements(s, d).where("dataset = 'part'"), wanted).select("wanted", "express_id")


@query("SELECT p_partkey AS express_id, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'stored ' || p_type END AS value FROM part")
def fill_missing(s, d):
    part = v.table(s, d, "part").select(F.col("p_partkey").alias("express_id"), "p_brand", "p_type")
    stated = part.select("express_id", F.lit("Mark").alias("name"), F.when(F.col("express_id") % 2 == 0, F.col("p_brand")).alias("value"))
    stored = part.select("express_id", F.lit("Mark").alias("name"), F.concat(F.lit("stored "), F.col("p_type")).alias("value"))
    return lookups.filled(stated, stored, ["express_id"]).select("express_id", "value")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def nested_values(s, d):
    e = v.table(s, d, "events").select("event_type", values.at_path(F.concat(F.lit('json:{"a": '), "props", F.lit("}")), "a.k").cast("long").alias("k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '[REDACTED_COMPLEX]' WHEN length(source || lang) > 160 THEN NULL ELSE source || '/' || lang END AS shown FROM documents")
def shown_payload(s, d):
    text = F.concat("source", F.lit("/"), "lang")
    stored = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('json:{"b": 1, "a": ["'), text, F.lit('"]}'))).otherwise(values.encoded(text))
    return v.table(s, d, "documents").select("doc_id", values.shown(stored).alias("shown"))


@query("SELECT 'N' || n_nationkey AS id, 'R' || n_regionkey AS ancestor, 1 AS distance FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 1 FROM customer UNION ALL SELECT 'C' || c_custkey, 'R' || n_regionkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey")
def class_ancestors(s, d):
    nation = v.table(s, d, "nation").select(v.key("N", "n_nationkey").alias("child"), v.key("R", "n_regionkey").alias("parent"))
    customer = v.table(s, d, "customer").select(v.key("C", "c_custkey").alias("child"), v.key("N", "c_nationkey").alias("parent"))
    return lookups.class_ancestors(nation.unionByName(customer))


@query(f"SELECT class_, count(*) AS n, CASE WHEN class_ IN ('IfcWall', 'IfcDoor') THEN count(*) ELSE 0 END AS skipped FROM {v.NODES} GROUP BY 1")
def pruning_statistics(s, d):
    return lookups.pruning(v.nodes(s, d), ("IfcWall", "IfcDoor"))


@query("SELECT p_type AS class_, p_name AS name, p_partkey AS express_id, row_number() OVER (PARTITION BY p_type ORDER BY p_name, p_partkey)::INT AS ordinal FROM part QUALIFY ordinal <= 3")
def evidence_samples(s, d):
    part = v.table(s, d, "part").select(F.col("p_type").alias("class_"), F.col("p_name").alias("name"), F.col("p_partkey").alias("express_id"))
    return lookups.samples(part, "class_", ["name", "express_id"])


@query("SELECT row_number() OVER (ORDER BY s_name, s_suppkey)::INT AS rank, s_name || ' | ' || s_nationkey AS line, greatest((SELECT count(*) FROM supplier) - 10, 0) AS more_count FROM supplier QUALIFY rank <= 10")
def presentation_lines(s, d):
    return lookups.lines(v.table(s, d, "supplier"), ["s_name", "s_nationkey"], ["s_name", "s_suppkey"])


@query("""SELECT vec_id AS id, round((embedding[1]::DOUBLE + embedding[4] + embedding[7]) / 3, 6) AS cx, round(least(embedding[1]::DOUBLE, embedding[4], embedding[7]), 6) AS x0,
 round(least(sqrt((embedding[1]::DOUBLE - embedding[10])^2 + (embedding[2]::DOUBLE - embedding[11])^2 + (embedding[3]::DOUBLE - embedding[12])^2), sqrt((embedding[4]::DOUBLE - embedding[10])^2 + (embedding[5]::DOUBLE - embedding[11])^2 + (embedding[6]::DOUBLE - embedding[12])^2),
  sqrt((embedding[7]::DOUBLE - embedding[10])^2 + (embedding[8]::DOUBLE - embedding[11])^2 + (embedding[9]::DOUBLE - embedding[12])^2)), 6) AS distance FROM embeddings""")
def mesh_figures(s, d):
    at = lambda k: F.array(*[F.col("embedding")[k + j].cast("double") for j in range(3)])
    e = v.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.array(at(0), at(3), at(6)).alias("mesh"), F.array(at(9)).alias("other"))
    low, _ = geometry.bounds(F.col("mesh"))
    return e.select("id", F.round(geometry.centroid(F.col("mesh"))[0], 6).alias("cx"), F.round(low[0], 6).alias("x0"), F.round(geometry.vertex_distance(F.col("mesh"), F.col("other")), 6).alias("distance"))


# Graph


@query("SELECT 'R' || n_regionkey AS seed, 'O' || o_orderkey AS id, 3 AS depth FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey")
def containment_descendants(s, d):
    seeds = v.table(s, d, "region").select(v.key("R", "r_regionkey").alias("id"))
    return graph.elements_below(v.nodes(s, d), v.hierarchy(s, d), seeds).select("seed", "id", "depth")


@query("SELECT 'O' || o_orderkey AS seed, 'N' || c_nationkey AS id FROM orders JOIN customer ON o_custkey = c_custkey")
def ancestor_container(s, d):
    seeds = v.table(s, d, "orders").select(v.key("O", "o_orderkey").alias("id"))
    return graph.container_of(v.nodes(s, d), v.hierarchy(s, d), seeds, "IfcBuilding")


@query("SELECT 'O' || a.o_orderkey AS seed, 'O' || b.o_orderkey AS id FROM orders a JOIN orders b USING (o_custkey) WHERE a.o_orderstatus = 'P' AND a.o_orderkey <> b.o_orderkey")
def same_storey(s, d):
    seeds = v.nodes(s, d).where("class_ = 'IfcBeam'").select("id")
    return graph.same_container(v.nodes(s, d), v.hierarchy(s, d), seeds)


@query("""SELECT 'R' || n_regionkey AS seed, 'R' || n_regionkey AS from_id, 'N' || n_nationkey AS to_id, 'contains' AS relation, 1 AS depth FROM nation
 UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey, 'C' || c_custkey, 'contains', 2 FROM nation JOIN customer ON n_nationkey = c_nationkey""")
def traverse_depth2(s, d):
    seeds = v.table(s, d, "region").select(v.key("R", "r_regionkey").alias("id"))
    return graph.traverse(v.hierarchy(s, d), seeds, 2, ("contains",))


_HOPS = f"""WITH l AS {v.LINKS}, a AS (SELECT DISTINCT p FROM l WHERE s = 'S0'), b AS (SELECT DISTINCT s FROM l JOIN a USING (p) WHERE s <> 'S0'), c AS (SELECT DISTINCT p FROM l JOIN b USING (s) WHERE p NOT IN (SELECT p FROM a))
 SELECT p AS id, 1 AS depth FROM a UNION ALL SELECT s, 2 FROM b UNION ALL SELECT p, 3 FROM c"""


@query(_HOPS)
def network_trace(s, d):
    return graph.trace(v.connections(s, d), s.createDataFrame([("S0",)], "id string"), 3).select("id", "depth")


@query(f"""WITH RECURSIVE l AS MATERIALIZED {v.LINKS}, e AS MATERIALIZED (SELECT p AS a, s AS b FROM l UNION ALL SELECT s, p FROM l), r(n, d) AS (SELECT 'S0', 0 UNION SELECT b, d + 1 FROM r JOIN e ON n = a WHERE d < 8)
 SELECT min(d)::BIGINT AS hops FROM r WHERE n = 'S1'""")
def shortest_hops(s, d):
    e = staged(v.connections(s, d))
    way = paths.between(e, "S0", "S1", longest=8)
    return paths.grounded(s.createDataFrame([(0, way)], "n int, path array<string>"), e, ["n"]).select(F.explode("steps").alias("s")).where("s.relation = 'ifc_connected_to'").agg(F.count("*").alias("hops"))


@query(f"""WITH l AS {v.LINKS}, a AS (SELECT DISTINCT p FROM l WHERE s = 'S0'), b AS (SELECT s, min(p) AS p FROM l JOIN a USING (p) WHERE s <> 'S0' GROUP BY 1), c AS (SELECT l.p, min(s) AS s FROM l JOIN b USING (s) WHERE l.p NOT IN (SELECT p FROM a) GROUP BY 1)
 SELECT p AS id, 'S0>' || p AS way, 'backward' AS turns FROM a UNION ALL SELECT s, 'S0>' || p || '>' || s, 'backward>forward' FROM b
 UNION ALL SELECT c.p, 'S0>' || b.p || '>' || s || '>' || c.p, 'backward>forward>backward' FROM c JOIN b USING (s)""")
def network_paths(s, d):
    e = staged(v.connections(s, d))
    reach = kept(graph.walk(graph.steps(e, graph.NETWORK, "any"), s.createDataFrame([("S0",)], "id string"), 3))
    rows = paths.grounded(paths.paths(reach, 3).where("depth > 0"), e, ["id"], graph.NETWORK)
    return rows.select("id", F.array_join("path", ">").alias("way"), F.array_join(F.transform("steps", lambda x: x["direction"]), ">").alias("turns"))


@query("SELECT 'N' || n_nationkey AS id FROM nation WHERE n_nationkey % 10 <> 1 UNION ALL SELECT 'C' || c_custkey FROM customer WHERE c_nationkey % 10 <> 1 UNION ALL SELECT 'O' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 10 <> 1")
def container_excluding(s, d):
    containers = v.table(s, d, "region").select(v.key("R", "r_regionkey").alias("id"))
    out = v.table(s, d, "nation").where(F.col("n_nationkey") % 10 == 1).select(v.key("N", "n_nationkey").alias("id"))
    return graph.excluding(v.hierarchy(s, d), containers, out)


@query(f"SELECT s AS anchor, p AS id, 'ifc_connected_to' AS relation FROM {v.LINKS}")
def neighbors_both_ways(s, d):
    anchors = v.table(s, d, "supplier").select(v.key("S", "s_suppkey").alias("id"))
    return graph.neighbours(v.connections(s, d), anchors, "ifc_connected_to")


@query(f"SELECT p AS id, count(*) AS matched_anchors, min(s) AS first_anchor FROM {v.LINKS} GROUP BY 1")
def relation_union(s, d):
    anchors = v.table(s, d, "supplier").select(v.key("S", "s_suppkey").alias("id"))
    return graph.related(v.connections(s, d), anchors, "ifc_connected_to")


@query("""WITH l AS (SELECT DISTINCT 'P' || l_partkey AS p, 'S' || l_suppkey AS s, min(l_quantity)::DOUBLE AS distance, max(l_extendedprice)::DOUBLE AS area FROM lineitem WHERE l_suppkey % 4 = 1 GROUP BY 1, 2)
 SELECT p AS id, string_agg(s, ',' ORDER BY s) AS anchors, min(distance) AS distance, max(area) AS area FROM l GROUP BY 1""")
def relation_union_details(s, d):
    anchors = v.table(s, d, "supplier").where("s_suppkey % 4 = 1").select(v.key("S", "s_suppkey").alias("id"))
    ends = v.table(s, d, "lineitem").groupBy(v.key("P", "l_partkey").alias("src"), v.key("S", "l_suppkey").alias("dst")).agg(F.min("l_quantity").cast("double").alias("distance"), F.max("l_extendedprice").cast("double").alias("area"))
    rows = graph.related(ends.withColumn("relation", F.lit("adjacent_to")), anchors, "adjacent_to", details=True)
    return rows.select("id", F.array_join("anchor_ids", ",").alias("anchors"), "distance", "area")


@query("SELECT 'O' || o_orderkey AS id, 1 AS score, o_orderpriority AS label FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%'")
def classification_match(s, d):
    return graph.by_classification(v.nodes(s, d), v.edges(s, d), "Urgent").select("id", "score", F.col("labels")[0].alias("label"))


_BOUNDS = "SELECT DISTINCT l_partkey AS element, s_nationkey AS space FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'"


@query(f"WITH b AS ({_BOUNDS}) SELECT x.space AS src, y.space AS dst, count(*) AS n_shared, min(x.element) AS first_shared FROM b x JOIN b y USING (element) WHERE x.space < y.space GROUP BY 1, 2")
def shared_boundary_pairs(s, d):
    of = v.table(s, d, "lineitem").where("l_returnflag = 'R'").join(v.table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    # half of the facts are stated from the element, half from the space
    own, other, back = F.col("l_partkey") + 1000, F.col("s_nationkey"), F.col("l_partkey") % 2 == 0
    e = of.select(F.when(back, other).otherwise(own).alias("src"), F.when(back, own).otherwise(other).alias("dst"), F.when(back, "space_bounded_by").otherwise("bounds_space").alias("relation"))
    return graph.shared_boundaries(e).select("src", "dst", F.size("shared").cast("long").alias("n_shared"), (F.col("shared")[0] - 1000).alias("first_shared"))


@query(f"SELECT 'class' AS kind, class_ AS name, count(*) AS n FROM {v.NODES} GROUP BY 2 UNION ALL SELECT 'relation', relation, count(*) FROM {v.EDGES} GROUP BY 2")
def graph_summary(s, d):
    return graph.summary(v.nodes(s, d), v.edges(s, d))


@query(f"SELECT id, count(*) AS degree FROM (SELECT src AS id FROM {v.EDGES} UNION ALL SELECT dst FROM {v.EDGES}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_degrees(s, d):
    return graph.top_degrees(v.edges(s, d))


@query(f"SELECT relation, count(*) AS n FROM (SELECT DISTINCT * FROM {v.EDGES}) GROUP BY 1")
def symmetric_relation_counts(s, d):
    e = v.edges(s, d)
    back = e.where("relation = 'ifc_connected_to'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation")
    return graph.relation_counts(e.unionByName(back))


@query(f"SELECT 'contains/contained_in' AS pair, count(*) AS n FROM (SELECT DISTINCT * FROM {v.DOWN})")
def inverse_pairs(s, d):
    return graph.inverse_pair_counts(v.edges(s, d))


_SERVING = f"""WITH k AS (SELECT 'N' || s_nationkey AS space, 'S' || s_suppkey AS id, s_acctbal > 5000 AS e FROM supplier), base AS (SELECT *, CASE WHEN e THEN 6 ELSE 5 END AS b FROM k),
 r AS (SELECT space, id, b AS score, 0 AS hops, e AS equipment FROM base UNION ALL SELECT space, p, b + 2, 1, TRUE FROM base JOIN {v.LINKS} ON s = id JOIN part ON p = 'P' || p_partkey WHERE p_brand = 'Brand#1'),
 g AS (SELECT space, id, max(score) AS score, min(hops) AS hops, bool_or(equipment) AS equipment FROM r GROUP BY 1, 2), w AS (SELECT *, bool_or(equipment) OVER (PARTITION BY space) AS has_any FROM g)
 SELECT space, id, score, hops, CASE WHEN equipment THEN 'equipment' ELSE 'terminal' END AS kind, CASE WHEN score >= 6 THEN 'strong' WHEN score >= 4 THEN 'moderate' ELSE 'weak' END AS strength FROM w WHERE equipment OR NOT has_any"""


@query(_SERVING)
def serving_candidates(s, d):
    spaces = v.table(s, d, "nation").select(v.key("N", "n_nationkey").alias("id"))
    holds = v.table(s, d, "supplier").select(v.key("N", "s_nationkey").alias("src"), v.key("S", "s_suppkey").alias("dst"), F.lit("contains").alias("relation"))
    return graph.serving(v.nodes(s, d), v.connections(s, d).unionByName(holds), spaces, 1)


# Space

_NEAREST = f"WITH s AS {v.SHAPES}, n AS (SELECT a.id, min(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))) AS m FROM s a, s b WHERE a.id <> b.id GROUP BY 1), t AS (SELECT greatest(0.5, 1.5 * median(m)) AS t FROM n)"


@query(f"{_NEAREST} SELECT round(t, 6) AS threshold FROM t")
def adjacency_threshold(s, d):
    return spatial.adjacency_threshold(v.shapes(s, d)).select(F.round("threshold", 6).alias("threshold"))


@query(f"{_NEAREST}, p AS (SELECT a.id AS a, b.id AS b, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS m FROM s a JOIN s b ON a.id < b.id) SELECT a, b, round(m, 6) AS distance FROM p, t WHERE m <= t")
def radius_join(s, d):
    shapes = v.shapes(s, d)
    return spatial.within(shapes, spatial.adjacency_threshold(shapes).first().threshold).withColumn("distance", F.round("distance", 6))


_GAP = "sqrt(power(greatest(a.x0-b.x1, b.x0-a.x1, 0), 2) + power(greatest(a.y0-b.y1, b.y0-a.y1, 0), 2) + power(greatest(a.z0-b.z1, b.z0-a.z1, 0), 2))"


@query(f"WITH s AS {v.SHAPES}, p AS (SELECT a.id AS a, b.id AS b, {_GAP} AS m FROM s a JOIN s b ON a.id < b.id) SELECT a, b, round(m, 6) AS distance, CASE WHEN m <= 1e-9 THEN 'connected_to' ELSE 'adjacent_to' END AS relation FROM p WHERE m <= 0.75")
def box_adjacency(s, d):
    return spatial.adjacency(v.shapes(s, d), 0.75).select("a", "b", F.round("distance", 6).alias("distance"), "relation")


_VERTICES = "[[x - w, y, z], [x + w, y, z], [x, y + w, z + w], [x, y - w, z - w]]"


@query(f"""WITH s AS (SELECT *, (x1 - x0) / 2 AS w FROM {v.SHAPES}), m AS (SELECT *, CASE WHEN id % 3 <> 0 AND id % 7 <> 0 THEN {_VERTICES} END AS mesh, id % 7 <> 0 AS boxed FROM s),
 p AS (SELECT a.id AS a, b.id AS b, CASE WHEN a.mesh IS NOT NULL AND b.mesh IS NOT NULL THEN list_min(flatten([[sqrt((i[1]-j[1])^2 + (i[2]-j[2])^2 + (i[3]-j[3])^2) FOR j IN b.mesh] FOR i IN a.mesh])) WHEN a.boxed AND b.boxed THEN {_GAP}
   ELSE sqrt((a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2) END AS m, CASE WHEN a.mesh IS NOT NULL AND b.mesh IS NOT NULL THEN 'mesh_vertices' WHEN a.boxed AND b.boxed THEN 'bbox' ELSE 'centroid' END AS distance_method FROM m a JOIN m b ON a.id < b.id)
 SELECT a, b, round(m, 6) AS distance, distance_method FROM p WHERE m <= 0.75""")
def mesh_adjacency(s, d):
    at = lambda *k: F.array(*[F.col("centre")[i] + F.col("w") * x for i, x in enumerate(k)])
    rows = v.shapes(s, d).withColumn("w", (F.col("hi")[0] - F.col("lo")[0]) / 2).withColumn("boxed", F.col("id") % 7 != 0)
    rows = rows.withColumn("mesh", F.when((F.col("id") % 3 != 0) & F.col("boxed"), F.array(at(-1, 0, 0), at(1, 0, 0), at(0, 1, 1), at(0, -1, -1))))
    rows = rows.withColumns({c: F.when(F.col("boxed"), F.col(c)).otherwise(F.col("centre")) for c in ("lo", "hi")})
    return spatial.adjacency(rows, 0.75).select("a", "b", F.round("distance", 6).alias("distance"), "distance_method")


_MEET = "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"
_DEEP = f"{_MEET} AND a.z0 <= b.z1 AND b.z0 <= a.z1"
_AREA = "(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_OVER = f"WITH s AS {v.SHAPES}, o AS (SELECT a.id AS a, b.id AS b, {_AREA} AS area, {_AREA} / least((a.x1-a.x0)*(a.y1-a.y0), (b.x1-b.x0)*(b.y1-b.y0)) AS ratio, a.z0 - b.z1 AS up, b.z0 - a.z1 AS down FROM s a JOIN s b ON a.id < b.id AND {_MEET})"


@query(f"WITH s AS {v.SHAPES} SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.id < b.id AND {_DEEP}")
def bbox_pairs(s, d):
    return spatial.intersections(v.shapes(s, d))


@query(f"{_OVER}, u AS (SELECT CASE WHEN up > 0 THEN a ELSE b END AS hi, CASE WHEN up > 0 THEN b ELSE a END AS lo, greatest(up, down) AS gap FROM o WHERE area > 0 AND greatest(up, down) > 0) SELECT hi AS src, lo AS dst, 'above' AS relation, round(gap, 6) AS gap FROM u UNION ALL SELECT lo, hi, 'below', round(gap, 6) FROM u")
def above_below(s, d):
    return spatial.levels(v.shapes(s, d), 6).select("src", "dst", "relation", "gap")


@query(f"{_OVER} SELECT a, b, round(area, 6) AS area FROM o WHERE area > 0 AND ratio >= 0.2")
def overlap_threshold(s, d):
    return spatial.overlap_edges(spatial.plan_overlaps(v.shapes(s, d), min_ratio=spatial.MIN_RATIO), "threshold").withColumn("area", F.round("area", 6))


@query(f"{_OVER}, e AS (SELECT a, b, area, a AS own, b AS other FROM o WHERE area > 0 UNION ALL SELECT a, b, area, b, a FROM o WHERE area > 0) SELECT DISTINCT a, b, round(area, 6) AS area FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY own ORDER BY area DESC, other) <= 5)")
def overlap_topk(s, d):
    return spatial.overlap_edges(spatial.plan_overlaps(v.shapes(s, d), spatial.TOP_K), "top_k").withColumn("area", F.round("area", 6))


@query(f"{_OVER} SELECT count(*) AS candidates, count(*) FILTER (ratio >= 0.2) AS emitted, count(*) FILTER (ratio < 0.2) AS rejected FROM o WHERE area > 0")
def overlap_statistics(s, d):
    return spatial.overlap_statistics(spatial.plan_overlaps(v.shapes(s, d)))


@query(f"WITH s AS {v.SHAPES} SELECT a.id AS area, b.id AS id FROM s a JOIN s b ON a.id <> b.id AND b.x BETWEEN a.x0 - 1e-9 AND a.x1 + 1e-9 AND b.y BETWEEN a.y0 - 1e-9 AND a.y1 + 1e-9")
def point_in_footprint(s, d):
    shapes = v.shapes(s, d)
    points = shapes.select("id", F.col("centre")[0].alias("x"), F.col("centre")[1].alias("y"))
    return spatial.inside_footprint(points, shapes.select("id", "lo", "hi", geometry.rectangle(F.col("lo"), F.col("hi")).alias("points")))


@query("""WITH e AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 20 AS x, embedding[2]::DOUBLE * 20 AS y, embedding[4]::DOUBLE AS u, embedding[5]::DOUBLE AS v, 0.2::DOUBLE + 0.04::DOUBLE * label AS w FROM embeddings),
 n AS (SELECT id, x, y, u / sqrt(u*u + v*v) AS u, v / sqrt(u*u + v*v) AS v, w FROM e WHERE u*u + v*v > 0),
 p AS (SELECT a.id AS a, b.id AS b, abs(a.u*b.u + a.v*b.v) AS dot, a.u + s * b.u AS mu, a.v + s * b.v AS mv, b.x - a.x AS dx, b.y - a.y AS dy, least(a.w, b.w) AS w
  FROM (SELECT a, b, CASE WHEN a.u*b.u + a.v*b.v < 0 THEN -1 ELSE 1 END AS s FROM n a JOIN n b ON a.id < b.id))
 SELECT a, b, round(degrees(acos(least(1, dot))), 5) AS angle, round(abs(dx*mv - dy*mu) / sqrt(mu*mu + mv*mv), 6) AS "offset" FROM p WHERE degrees(acos(least(1, dot))) <= 10 AND abs(dx*mv - dy*mu) / sqrt(mu*mu + mv*mv) <= greatest(0.25, w)""")
def aligned_pairs(s, d):
    return spatial.aligned(v.axes(s, d)).select("a", "b", F.round("angle", 5).alias("angle"), F.round("offset", 6).alias("offset"))


@query(f"{_OVER} SELECT a, b, round(area, 6) AS area FROM o WHERE area > 1e-6")
def polygon_overlap_area(s, d):
    shapes = v.shapes(s, d).withColumn("poly", geometry.rectangle(F.col("lo"), F.col("hi")))
    return spatial.polygon_overlaps(shapes).withColumn("area", F.round("area", 6))


# Search

_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"


@query(f"""WITH t AS (SELECT 'P' || p_partkey AS id, p_name AS label, list_distinct({_TOK.format("p_name")}) AS a, list_distinct({_TOK.format("p_brand")}) AS b FROM part)
 SELECT id, label, (len(a) = 2)::INT AS exact_fields, 1 AS matched_fields, len(list_distinct(list_concat(a, b))) - 2 AS extra_terms FROM t WHERE list_has_all(a, ['red', 'bolt'])""")
def element_set_rank(s, d):
    n = v.table(s, d, "part").select(v.key("P", "p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("type_name"))
    return search.element_set(n, "Bolt, red", ("label", "type_name"))


_HITS = f"SELECT id, label, class_, CASE WHEN lower(id) LIKE '%fan%' THEN 100 WHEN lower(label) LIKE '%fan%' THEN 96 ELSE 92 END AS score FROM {v.NODES} WHERE lower(id) LIKE '%fan%' OR lower(label) LIKE '%fan%' OR lower(class_) LIKE '%fan%'"


@query(f"WITH h AS ({_HITS}), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, label, id) AS k, least(2, ceil(count(*) OVER () / 25.0)) AS p FROM h) SELECT id, label, class_, score FROM r WHERE k > (p - 1) * 25 AND k <= p * 25")
def search_page(s, d):
    return search.page(search.substring_search(v.nodes(s, d), "Fan"), 2, 25).select("id", "label", "class_", "score")


@query(f"SELECT class_, count(*) AS n FROM {v.NODES} GROUP BY 1")
def class_histogram(s, d):
    return search.class_histogram(v.nodes(s, d))


@query()
def fuzzy_rank(s, d):
    hits = search.fuzzy_nodes(v.nodes(s, d).where("class_ <> 'IfcBuildingStorey'"), "red blt")
    return hits.orderBy(F.desc("score"), "label", "id").limit(25)


# Evaluation

_ROLL = """count(*) AS runs, round(avg(answer_correct::INT), 6) AS answer_correct_rate, round(avg(route_correct::INT), 6) AS route_correct_rate, round(avg(no_error::INT), 6) AS no_error_rate, round(avg(duration_ms), 6) AS avg_duration_ms,
 quantile_disc(duration_ms, 0.95) AS p95_duration_ms, round(avg(tokens), 6) AS avg_tokens, sum(tokens)::BIGINT AS sum_tokens, round(avg((tokens IS NOT NULL)::INT), 6) AS token_coverage_rate"""


@query(f"SELECT profile, {_ROLL} FROM {v.RUNS} GROUP BY 1 ORDER BY answer_correct_rate DESC NULLS LAST, route_correct_rate DESC NULLS LAST, avg_tokens NULLS LAST, avg_duration_ms NULLS LAST, profile LIMIT 10")
def leaderboard(s, d):
    return evals.leaderboard(v.runs(s, d), "profile", 10)


@query(f"SELECT case_id, {_ROLL} FROM {v.RUNS} GROUP BY 1")
def case_groups(s, d):
    return evals.roll_up(v.runs(s, d), "case_id")


@query(f"SELECT profile, quantile_disc(duration_ms, 0.95) AS p95 FROM {v.RUNS} GROUP BY 1")
def p95_by_profile(s, d):
    return evals.p95(v.runs(s, d), ["profile"], "duration_ms")


@query(f"SELECT count(*) AS runs, count(tokens) AS covered, sum(tokens)::BIGINT AS sum_tokens, round(avg(tokens), 6) AS avg_tokens FROM {v.RUNS}")
def token_coverage(s, d):
    return v.runs(s, d).agg(F.count("*").alias("runs"), F.count("tokens").alias("covered"), F.sum("tokens").alias("sum_tokens"), evals.mean(F.col("tokens")).alias("avg_tokens"))


_CUES = """SELECT kind, graph, intent, aggregate_op, count(*) AS n FROM (SELECT kind,
 CASE WHEN regexp_matches(q, '\\b(in|inside|within)\\s+(the\\s+)?((room|space)\\s+[a-z0-9_.-]+|kitchen|bathroom|bedroom|toilet|washroom|lobby|corridor|hallway|office)\\b') THEN 'containment'
  WHEN list_has_any([contains(q, c) FOR c IN ['adjacent', 'near', 'distance', 'connected', 'connection', 'route', 'path', 'between', 'neighbor', 'neighbour', 'closest', 'touch', 'intersect', 'next to', 'beside', 'overlap', 'above', 'below', 'in front of', 'behind']], [true]) THEN 'spatial'
  WHEN list_has_any([contains(q, c) FOR c IN ['classification', 'classified', 'system', 'serves', 'serving', 'served by', 'zone']], [true]) THEN 'system'
  WHEN list_has_any([contains(q, c) FOR c IN ['material', 'color', 'colour', 'rgb']], [true]) THEN 'material'
  WHEN list_has_any([contains(q, c) FOR c IN ['geo-reference', 'geo reference', 'georeference', 'fuzzy', 'approximate name', 'similar name', 'closest match']], [true]) THEN 'fuzzy'
  WHEN list_has_any([contains(q, c) FOR c IN ['compare', 'comparison', 'versus', ' vs ', 'which is larger', 'which is smaller', 'which is higher', 'which is lower', 'larger than', 'smaller than']], [true]) THEN 'comparison' END AS graph,
 CASE WHEN regexp_matches(q, '\\b(group|break\\s+down)\\b.*\\bby\\b|\\bgrouped\\s+by\\b|\\bwhat\\s+kinds?\\s+of\\b|\\b(what|which)\\s+types\\s+of\\b') THEN 'group'
  WHEN q LIKE '%avg%' OR q LIKE '%average%' OR q LIKE '%mean%' OR q LIKE '%min%' OR q LIKE '%lowest%' OR q LIKE '%smallest%' OR q LIKE '%max%' OR q LIKE '%highest%' OR q LIKE '%largest%' OR q LIKE '%sum of%' OR q LIKE '%summed%' THEN 'aggregate'
  WHEN q LIKE '%how many%' OR q LIKE '%count%' OR q LIKE '%number of%' OR q LIKE '%total%' OR q LIKE '%are there%' OR q LIKE '%is there%' OR q LIKE '%do we have%' OR q LIKE '%does the building have%' OR q LIKE '%does the house have%' OR q LIKE '%exist%' THEN 'count'
  WHEN q LIKE '%list%' OR q LIKE '%find%' OR q LIKE '%show%' OR q LIKE '%which%' OR q LIKE '%what are%' OR q LIKE '%display%' OR q LIKE '%get%' OR q LIKE '%retrieve%' OR q LIKE '%identify%' THEN 'list' END AS intent,
 CASE WHEN q LIKE '%avg%' OR q LIKE '%average%' OR q LIKE '%mean%' THEN 'avg' WHEN q LIKE '%min%' OR q LIKE '%lowest%' OR q LIKE '%smallest%' THEN 'min' WHEN q LIKE '%max%' OR q LIKE '%highest%' OR q LIKE '%largest%' THEN 'max'
  WHEN q LIKE '%sum of%' OR q LIKE '%summed%' OR q LIKE '%total%' THEN 'sum' END AS aggregate_op
 FROM (SELECT 'turn' AS kind, lower(text) AS q FROM conversations UNION ALL SELECT 'asked', 'how many ' || lower(p_name) || 's are there on level ' || p_size FROM part)) GROUP BY ALL"""


@query(_CUES)
def route_cues(s, d):
    asked = v.table(s, d, "part").select(F.lit("asked").alias("kind"), F.concat(F.lit("How many "), F.col("p_name"), F.lit("s are there on level "), F.col("p_size").cast("string")).alias("text"))
    q = v.table(s, d, "conversations").select(F.lit("turn").alias("kind"), "text").unionByName(asked)
    return router.routed(q).groupBy("kind", "graph", "intent", "aggregate_op").agg(F.count("*").alias("n"))


# Records, and actions on the model made of them


def _model(s, d):
    return Model.of_records(v.records(s, d))


@query("""SELECT 'elements' AS part, ifc AS name, count(*) AS n, 0.0::DOUBLE AS total FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'IfcWall' WHEN 'O' THEN 'IfcDoor' ELSE 'IfcBeam' END AS ifc FROM orders UNION ALL SELECT 'IfcSpace' FROM customer UNION ALL SELECT 'IfcBuildingStorey' FROM nation) GROUP BY 2
 UNION ALL SELECT 'properties', x, count(*), count(*)::DOUBLE FROM orders, (VALUES ('Pset_Order.Status'), ('Pset_Order.Price')) t(x) GROUP BY 2 UNION ALL SELECT 'quantities', 'Qto_Order.Total', count(*), round(sum(o_totalprice), 2) FROM orders""")
def record_tables(s, d):
    t = rec.tables(v.records(s, d))
    out = t.elements.groupBy(F.lit("elements").alias("part"), F.col("ifc_class").alias("name")).agg(F.count("*").alias("n"), F.lit(0.0).alias("total"))
    out = out.unionByName(t.properties.groupBy(F.lit("properties").alias("part"), F.concat_ws(".", "pset_name", "property_name").alias("name")).agg(F.count("*").alias("n"), F.sum("is_official").cast("double").alias("total")))
    return out.unionByName(t.quantities.groupBy(F.lit("quantities").alias("part"), F.concat_ws(".", "qto_name", "quantity_name").alias("name")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")))


@query("""SELECT 'aggregates' AS relation, 1 + (SELECT count(*) FROM nation) AS n UNION ALL SELECT r, (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) FROM (VALUES ('contains'), ('contained_in')) t(r)
 UNION ALL SELECT 'classified_as', count(*) FROM orders UNION ALL SELECT 'hosted_by', count(*) FROM orders JOIN customer ON o_custkey = c_custkey""")
def record_graph(s, d):
    return rec.graph(v.records(s, d))[1].groupBy("relation").agg(F.count("*").alias("n"))


_BOUNDED = "total_found, least(total_found, {k}) AS returned_count, total_found > {k} AS truncated"


@query(f"SELECT 'O' || o_orderkey AS global_id, {_BOUNDED.format(k=5)} FROM (SELECT o_orderkey, count(*) OVER () AS total_found FROM orders WHERE o_orderstatus = 'F') ORDER BY 'Order ' || o_orderkey LIMIT 5")
def action_by_class(s, d):
    return _model(s, d).act("find_elements_by_class", class_="wall", max_results=5).select("global_id", "total_found", "returned_count", "truncated")


@query(f"SELECT 'O' || o_orderkey AS global_id, {_BOUNDED.format(k=7)} FROM (SELECT o_orderkey, count(*) OVER () AS total_found FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3) ORDER BY 'Order ' || o_orderkey LIMIT 7")
def action_storey(s, d):
    return _model(s, d).get_elements_in_storey("N3", 7).select("global_id", "total_found", "returned_count", "truncated")


@query(f"SELECT 'O' || o_orderkey AS global_id, {_BOUNDED.format(k=9)} FROM (SELECT o_orderkey, count(*) OVER () AS total_found FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '1-URGENT') ORDER BY 'Order ' || o_orderkey LIMIT 9")
def action_find_nodes(s, d):
    return _model(s, d).find_nodes(filters={"Pset_Order.Status": ["F", "P"], "Price.Priority": "1-URGENT"}, max_results=9).select("global_id", "total_found", "returned_count", "truncated")


@query("SELECT round(sum(o_totalprice), 2) AS value, count(*) AS matched_count, 1::BIGINT AS missing_count, 0::BIGINT AS non_numeric FROM orders WHERE o_orderkey <= 40")
def action_aggregate(s, d):
    ids = [f"O{r[0]}" for r in v.table(s, d, "orders").where("o_orderkey <= 40").select("o_orderkey").collect()]  # at most 40
    return _model(s, d).aggregate_elements([*ids, "N1", *ids[:3]], "sum", Field("quantity", "Qto_Order.Total")).withColumn("value", F.round("value", 2))


@query("""SELECT 'json:"' || o_orderstatus || '"' AS value, count(*) AS count FROM orders WHERE o_orderkey <= 40 GROUP BY 1""")
def action_group(s, d):
    ids = [f"O{r[0]}" for r in v.table(s, d, "orders").where("o_orderkey <= 40").select("o_orderkey").collect()]
    return _model(s, d).group_elements_by_property(ids, Field("property", "Status")).select("value", "count")


@query(f"SELECT 'O' || o_orderkey AS global_id, 2 AS score, {_BOUNDED.format(k=6)} FROM (SELECT o_orderkey, count(*) OVER () AS total_found FROM orders WHERE o_orderpriority = '2-HIGH') ORDER BY 'Order ' || o_orderkey LIMIT 6")
def action_classification(s, d):
    return _model(s, d).find_by_classification("2 high", 6).select("global_id", "score", "total_found", "returned_count", "truncated")


@query("SELECT count(*) AS total_count, count(*) FILTER (WHERE o_orderstatus = 'F') AS walls, count(*) FILTER (WHERE o_orderstatus <> 'F') AS missing_count FROM orders")
def answer_totals(s, d):
    t = rec.tables(v.records(s, d))
    walls = relational.totals(t, Request("count", "wall")).select(F.col("total_count").alias("walls"))
    some = relational.totals(t, Request("group", filters=(Filter("element", "name", "like", "Order %"),), group_by=Field("property", "Status")))
    return some.crossJoin(walls).select("total_count", "walls", (F.col("matched_count") - F.col("walls")).alias("missing_count"))


# Values, boxes and walks of any size


@query("SELECT count(*) FILTER (WHERE p_size % 3 = 1) AS is_false, count(*) FILTER (WHERE p_size % 3 <> 1) AS not_false, count(*) FILTER (WHERE p_size % 3 = 0 OR p_size % 3 = 2) AS above_false FROM part")
def boolean_filters(s, d):
    t = v.tables(s, d)
    size = F.substring("value", 6, 9).cast("int") % 3
    flags = t.properties.where("property_name = 'Size'").withColumns({"property_name": F.lit("Flag"), "value": F.when(size == 0, "json:true").when(size == 1, "json:false").otherwise("0 by text")})
    own = relational.Tables(t.elements, flags, t.quantities)
    n = {name: relational.count(own, Request("count", filters=(Filter("property", "Flag", op, False),))).select(F.col("count").alias(name)) for name, op in (("is_false", "eq"), ("not_false", "neq"), ("above_false", "gt"))}
    return n["is_false"].crossJoin(n["not_false"]).crossJoin(n["above_false"])


@query(f"SELECT count(*) AS pairs, count(*) FILTER (WHERE big) AS with_site FROM (SELECT a.id = -1 OR b.id = -1 AS big FROM (SELECT id, x0, x1, y0, y1 FROM {v.SHAPES} UNION ALL SELECT -1, -1000, 1000, -1000, 1000) a JOIN (SELECT id, x0, x1, y0, y1 FROM {v.SHAPES} UNION ALL SELECT -1, -1000, 1000, -1000, 1000) b ON a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)")
def boxes_of_all_sizes(s, d):
    site = s.createDataFrame([(-1, [-1000.0] * 3, [1000.0] * 3)], "id long, lo array<double>, hi array<double>")
    pairs = spatial.plan_overlaps(v.shapes(s, d).select("id", "lo", "hi").unionByName(site))
    return pairs.agg(F.count("*").alias("pairs"), F.count_if((F.col("a") == -1) | (F.col("b") == -1)).alias("with_site"))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS src, c_custkey + 1 AS dst FROM customer WHERE c_custkey % 30 <> 0 AND c_custkey < (SELECT max(c_custkey) FROM customer)), r(seed, id, depth) AS (SELECT src, dst, 1 FROM e WHERE src % 30 = 1 UNION ALL SELECT r.seed, e.dst, r.depth + 1 FROM r JOIN e ON r.id = e.src)
 SELECT seed, count(*) AS n, max(depth) AS deepest FROM r GROUP BY 1""")
def deep_containment(s, d):
    c = v.table(s, d, "customer").select("c_custkey")
    last = c.agg(F.max("c_custkey")).first()[0]
    e = c.where((F.col("c_custkey") % 30 != 0) & (F.col("c_custkey") < last)).select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + 1).alias("dst"), F.lit("contains").alias("relation"))
    seeds = c.where(F.col("c_custkey") % 30 == 1).select(F.col("c_custkey").alias("id"))
    return graph.descendants(e, seeds).groupBy("seed").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


@query(f"SELECT id FROM (SELECT 'P' || p_partkey AS id FROM part UNION ALL SELECT 'C' || c_custkey FROM customer) WHERE id NOT IN (SELECT p FROM {v.LINKS})")
def anchors_without_match(s, d):
    anchors = v.nodes(s, d).where("id LIKE 'P%' OR id LIKE 'C%'").where("class_ <> 'Classification'").select("id")
    return graph.unmatched(v.edges(s, d), anchors, "ifc_connected_to")


@query(f"SELECT a.id AS id, round(sqrt(greatest(b.x0 - a.x, a.x - b.x1, 0)^2 + greatest(b.y0 - a.y, a.y - b.y1, 0)^2 + greatest(b.z0 - a.z, a.z - b.z1, 0)^2), 6) AS distance, round((a.x1 - a.x0) * (a.y1 - a.y0) / 2, 6) AS area FROM {v.SHAPES} a JOIN {v.SHAPES} b ON b.id = a.id + 1")
def point_to_box(s, d):
    a = v.shapes(s, d)
    b = a.select((F.col("id") - 1).alias("id"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
    half = F.slice(geometry.rectangle(F.col("lo"), F.col("hi")), 1, 3)
    return a.join(b, "id").select("id", F.round(geometry.point_box_distance(F.col("centre"), F.col("lb"), F.col("hb")), 6).alias("distance"), F.round(geometry.footprint_area(half, F.col("lo"), F.col("hi")), 6).alias("area"))


@query(f"SELECT a.id AS a, b.id AS b FROM {v.SHAPES} a JOIN {v.SHAPES} b ON a.id < b.id AND a.id % 3 = b.id % 3 WHERE (a.x - b.x)^2 + (a.y - b.y)^2 + (a.z - b.z)^2 <= 4")
def radius_by_dataset(s, d):
    return spatial.within(v.shapes(s, d).withColumn("dataset", F.concat(F.lit("m"), (F.col("id") % 3).cast("string"))), 2.0).select("a", "b")


# Labels, digests, roll-ups and orders


@query("""SELECT o_orderstatus || ':' || o_orderpriority AS label, sha256(o_orderstatus || ':' || o_orderpriority) AS digest, CASE WHEN o_orderstatus = 'F' THEN 'IFC4X3' WHEN o_orderstatus = 'O' THEN 'IFC4' END AS family, count(*) AS n FROM orders GROUP BY ALL""")
def labels_and_digests(s, d):
    o = v.table(s, d, "orders")
    label = values.joined_label(F.col("o_orderstatus"), F.lit("  "), F.col("o_orderpriority"))
    family = tx.schema_family(F.when(F.col("o_orderstatus") == "F", "ifc4x3_add2").when(F.col("o_orderstatus") == "O", "IFC4_TC1").otherwise("STEP"))
    return o.groupBy(label.alias("label"), values.digest(label).alias("digest"), family.alias("family")).agg(F.count("*").alias("n"))


@query(f"SELECT CASE relation WHEN 'contains' THEN 'hierarchy' WHEN 'contained_in' THEN 'hierarchy' ELSE 'explicit' END AS bucket, relation, count(*) AS n FROM (SELECT DISTINCT CASE WHEN relation = 'ifc_connected_to' THEN least(src, dst) ELSE src END AS a, CASE WHEN relation = 'ifc_connected_to' THEN greatest(src, dst) ELSE dst END AS b, relation FROM {v.EDGES}) GROUP BY 1, 2")
def relation_legend(s, d):
    return graph.legend(v.edges(s, d))


@query(f"SELECT id LIKE 'Classification::%' AS context, count(*) AS n FROM {v.NODES} GROUP BY 1")
def context_nodes(s, d):
    return v.nodes(s, d).groupBy(graph.is_context(F.col("id")).alias("context")).agg(F.count("*").alias("n"))


@query("""SELECT user_id AS profile, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS errors, sum(event_id % 3)::BIGINT AS warnings, count(*) FILTER (WHERE value >= 5) AS with_data, round(avg(value), 6) AS avg_duration_ms, max(value) AS max_duration_ms FROM events GROUP BY 1""")
def profile_figures(s, d):
    runs = v.table(s, d, "events").select(F.col("user_id").alias("profile"), F.when(F.col("event_type") == "error", "failed").alias("error"), (F.col("event_id") % 3).alias("warnings"), F.when(F.col("value") >= 5, 1).otherwise(0).alias("rows_returned"), F.col("value").alias("duration_ms"))
    return evals.profile_summary(runs)


@query("""SELECT route_correct, no_error, duration_pass, count(*) AS n FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'sql' ELSE 'graph' END = CASE WHEN event_type = 'view' THEN 'sql' ELSE 'graph' END AS route_correct, event_type <> 'error' AS no_error, CASE WHEN user_id % 3 > 0 THEN value <= 5 END AS duration_pass FROM events) GROUP BY ALL""")
def judged_runs(s, d):
    e = v.table(s, d, "events").select(
        F.when(F.col("user_id") % 2 == 0, "sql").otherwise("graph").alias("expected_route"), F.when(F.col("event_type") == "view", "sql").otherwise("graph").alias("route"), F.when(F.col("event_type") == "error", "x").alias("error"),
        F.when(F.col("user_id") % 3 > 0, 5.0).alias("limit_ms"), F.col("value").alias("duration_ms"),
    )
    return evals.judged(e).groupBy("route_correct", "no_error", "duration_pass").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id FROM customer ORDER BY c_mktsegment = 'BUILDING' DESC, c_acctbal DESC, c_name, c_custkey LIMIT 8")
def recent_models(s, d):
    c = v.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_mktsegment") == "BUILDING").alias("pinned"), F.col("c_acctbal").alias("last_used"))
    return search.recents(c).select("id")


@query("SELECT c, p, ordinal FROM (SELECT o_custkey AS c, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_orderkey), o_orderpriority) AS ordinal FROM orders GROUP BY 1, 2) WHERE ordinal <= 3")
def unique_evidence(s, d):
    o = v.table(s, d, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"), "o_orderkey")
    return search.merged_evidence(o, "c", "p", "o_orderkey", 3)


@query(f"SELECT 'box' AS kind, id::VARCHAR AS name, round((x1 - x0) * (y1 - y0) * (z1 - z0), 6) AS volume FROM {v.SHAPES} UNION ALL SELECT 'stem', regexp_replace(n_name || ' / ' || n_nationkey, '[^A-Za-z0-9._-]+', '_', 'g'), NULL FROM nation")
def volumes_and_stems(s, d):
    boxes = v.shapes(s, d).select(F.lit("box").alias("kind"), F.col("id").cast("string").alias("name"), F.round(geometry.box_volume(F.col("lo"), F.col("hi")), 6).alias("volume"))
    stem = values.file_stem(F.concat(F.col("n_name"), F.lit(" / "), F.col("n_nationkey").cast("string")))
    return boxes.unionByName(v.table(s, d, "nation").select(F.lit("stem").alias("kind"), stem.alias("name"), F.lit(None).cast("double").alias("volume")))


# Class hierarchies

_TREE = "(SELECT DISTINCT ifc_class AS child, 'IfcKind' || substr(ifc_class, 4, 1) AS parent FROM e UNION SELECT DISTINCT 'IfcKind' || substr(ifc_class, 4, 1), 'IfcThing' FROM e UNION SELECT DISTINCT ifc_class, 'IfcEven' FROM e WHERE length(ifc_class) % 2 = 0 UNION SELECT 'IfcEven', 'IfcThing')"


def _tree(s, d):
    """Classes of the elements, their kinds by initial, one thing above all, and a second parent for some."""
    e = v.elements(s, d).select("ifc_class").distinct()
    kind = F.concat(F.lit("IfcKind"), F.substring("ifc_class", 4, 1))
    even = s.createDataFrame([("IfcEven", "IfcThing")], "child string, parent string")
    rows = e.select(F.col("ifc_class").alias("child"), kind.alias("parent")).unionByName(e.select(kind.alias("child"), F.lit("IfcThing").alias("parent")))
    return rows.unionByName(e.where(F.length("ifc_class") % 2 == 0).select(F.col("ifc_class").alias("child"), F.lit("IfcEven").alias("parent"))).unionByName(even).distinct()


@query(f"""WITH RECURSIVE e AS {v.ELEMENTS}, t AS MATERIALIZED {_TREE}, r(class_, sub) AS (SELECT child, child FROM t UNION SELECT parent, parent FROM t UNION SELECT t.parent, r.sub FROM r JOIN t ON r.class_ = t.child)
 SELECT class_, count(ifc_class) AS n FROM r LEFT JOIN e ON ifc_class = sub GROUP BY 1""")
def class_rollup(s, d):
    spans = kept(classes.intervals(_tree(s, d)))
    own = v.elements(s, d).groupBy(F.col("ifc_class").alias("subtype")).agg(F.count("*").alias("n"))
    return classes.subtypes(spans, spans.select("class_")).join(own, "subtype", "left").groupBy("class_").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query(f"WITH RECURSIVE e AS {v.ELEMENTS}, t AS MATERIALIZED {_TREE}, r(c) AS (SELECT 'IfcEven' UNION SELECT child FROM r JOIN t ON parent = c) SELECT level AS value, count(DISTINCT (dataset, express_id)) AS count FROM e WHERE ifc_class IN (SELECT c FROM r) GROUP BY 1")
def group_with_subtypes(s, d):
    t = v.tables(s, d)
    own = relational.Tables(t.elements, t.properties, t.quantities, kept(classes.intervals(_tree(s, d))))
    return relational.group(own, Request("group", "IfcEven", group_by=Field("element", "level")))


# STEP files


@query("""SELECT c_custkey AS id, c_name AS name, round(x, 6) AS x, round(y, 6) AS y, round(z + 1.5, 6) AS z, round(x - a, 6) AS x0, round(y - b, 6) AS y0, round(z, 6) AS z0, round(x + a, 6) AS x1, round(y + b, 6) AS y1, round(z + 3, 6) AS z1
 FROM (SELECT c_custkey, c_name, (n_regionkey * 1000 + n_nationkey * 10 + CASE WHEN n_nationkey % 2 = 1 THEN -(c_custkey % 7) ELSE c_custkey % 100 END)::DOUBLE AS x,
  (n_nationkey * 5 + CASE WHEN n_nationkey % 2 = 1 THEN c_custkey % 100 ELSE c_custkey % 7 END)::DOUBLE AS y, n_nationkey::DOUBLE AS z, CASE WHEN n_nationkey % 2 = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS a, CASE WHEN n_nationkey % 2 = 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS b
  FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def step_positions(s, d):
    all_ = staged(step.parsed(v.step_parts(s, d)), "entity")
    shapes = step_model.vertices(all_).select("express_id", step_model.measured("vertices").alias("f")).join(step.elements(all_).select("express_id", "global_id", "name"), "express_id")
    at = lambda c, k: F.round(F.col(f"f.{c}")[k], 6)
    name = F.regexp_extract("name", r"^a; \('(.*)'\)$", 1).alias("name")
    return shapes.select(F.substring("global_id", 2, 20).cast("long").alias("id"), name, *[at(c, k).alias("xyz"[k] + n) for c, n in (("centre", ""), ("lo", "0"), ("hi", "1")) for k in range(3)])


@query("""SELECT 'dangling' AS rule, c_custkey * 10 + 10002 AS id, 'refers to #' || (c_nationkey + 3000) AS message FROM customer WHERE c_nationkey % 5 = 0 UNION ALL SELECT 'double', r_regionkey + x, 'comes 2 times' FROM region, (VALUES (100), (200), (300)) t(x)
 UNION ALL SELECT 'arguments', c_custkey * 10 + 10004, 'argument 4 of IFCEXTRUDEDAREASOLID is no number' FROM customer WHERE c_custkey % 10 = 3 UNION ALL SELECT 'project', NULL, '0 projects'""")
def step_problems(s, d):
    lines = v.step_parts(s, d)
    # placements of every fifth nation left out, those of regions twice, every tenth solid without a depth
    left = lines.where(~F.regexp_extract("value", r"^#(\d+)=IFCLOCALPLACEMENT\(#3\d\d,", 1).isin([str(3000 + n) for n in range(0, 25, 5)]))
    left = left.withColumn("value", F.when(F.col("value").rlike(r"^#\d*34=IFCEXTRUDEDAREASOLID"), F.regexp_replace("value", r",3\.\)$", ",.T.)")).otherwise(F.col("value")))
    again = lines.where(F.col("value").rlike(r"^#[123]0\d="))
    return step_check.problems(kept(step.parsed(left.unionByName(again)))).select("rule", "id", "message")


# Extension


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(s, d):
    return windows.counts(v.table(s, d, "events")).withColumn("total", F.round("total", 4))
