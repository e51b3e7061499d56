"""Operators over a typed property graph: nodes (id, class_, label, ...) and edges (src, dst, relation, ...).

Walks are loops of joins, one per level; what has been seen is removed by an anti-join, and the frontier is written to the shared
folder, so that a level's plan never holds those before it.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .staging import kept, staged

# The relations and what is known of them.
HIERARCHY = ("aggregates", "contains", "contained_in")
SPATIAL = ("adjacent_to", "connected_to")
TOPOLOGY = ("above", "below", "aligned_with", "overlaps_xy", "intersects_bbox", "intersects_3d", "touches_surface", "space_bounded_by", "bounds_space", "shares_boundary_with", "path_connected_to")
EXPLICIT = ("hosts", "hosted_by", "ifc_connected_to", "typed_by", "belongs_to_system", "in_zone", "classified_as")
SYMMETRIC = ("adjacent_to", "connected_to", "aligned_with", "overlaps_xy", "intersects_bbox", "intersects_3d", "touches_surface", "shares_boundary_with", "ifc_connected_to", "path_connected_to")
DIRECTIONAL = ("above", "below", "space_bounded_by", "bounds_space")
STATED_TOPOLOGY = ("space_bounded_by", "bounds_space", "path_connected_to", "shares_boundary_with")
INVERSE = {"above": "below", "hosts": "hosted_by", "contains": "contained_in", "space_bounded_by": "bounds_space"}
NETWORK = ("ifc_connected_to", "path_connected_to", "connected_to")
SERVING = ("ifc_connected_to", "path_connected_to", "belongs_to_system", "connected_to", "hosts", "hosted_by")
CONTAINERS = ("IfcProject", "IfcSite", "IfcBuilding", "IfcBuildingStorey", "IfcSpace", "IfcZone", "IfcSpatialZone", "IfcTypeObject")
TERMINALS = ("IfcFlowTerminal", "IfcDistributionPort", "IfcOutlet", "IfcSanitaryTerminal", "IfcWasteTerminal", "IfcStackTerminal", "IfcAirTerminalBox")
EQUIPMENT = (
    "IfcFlowController", "IfcFlowMovingDevice", "IfcEnergyConversionDevice", "IfcUnitaryEquipment", "IfcElectricAppliance", "IfcBoiler", "IfcBurner", "IfcChiller", "IfcCoil", "IfcCondenser",
    "IfcCooledBeam", "IfcCoolingTower", "IfcDamper", "IfcDuctFitting", "IfcDuctSilencer", "IfcElectricDistributionBoard", "IfcEvaporativeCooler", "IfcFan", "IfcFilter",
    "IfcFireSuppressionTerminal", "IfcHeatExchanger", "IfcHumidifier", "IfcInterceptor", "IfcLamp", "IfcMedicalDevice", "IfcMotorConnection", "IfcPump", "IfcProtectiveDevice", "IfcSensor",
    "IfcSolarDevice", "IfcSpaceHeater", "IfcSwitchingDevice", "IfcTransformer", "IfcTubeBundle", "IfcValve",
)
EQUIPMENT_PARTS = (
    "Equipment", "Controller", "MovingDevice", "ConversionDevice", "Appliance", "Boiler", "Chiller", "Condenser", "CoolingTower", "Fan", "HeatExchanger", "Pump", "Sensor", "SpaceHeater",
    "Transformer", "Valve",
)
HARD_CAP = 100


def relation_table(spark: SparkSession) -> DataFrame:
    """(relation, bucket, symmetric, expected_source) of the 23 relations."""
    rows = []
    for bucket, names in (("hierarchy", HIERARCHY), ("spatial", SPATIAL), ("topology", TOPOLOGY), ("explicit", EXPLICIT)):
        for n in names:
            source = {"hierarchy": None, "spatial": "heuristic", "topology": "ifc" if n in STATED_TOPOLOGY else "topology", "explicit": "ifc"}[bucket]
            rows.append((n, bucket, n in SYMMETRIC, source))
    return spark.createDataFrame(rows, "relation string, bucket string, symmetric boolean, expected_source string")


def known_relations(names) -> list[str]:
    names = [names] if isinstance(names, str) else list(names)
    clean = [n.strip().lower() for n in names]
    unknown = set(clean) - {*HIERARCHY, *SPATIAL, *TOPOLOGY, *EXPLICIT}
    if unknown:
        raise ValueError(f"no such relations: {sorted(unknown)}")
    return clean


def is_equipment(c: Column) -> Column:
    return F.coalesce(c.isin(*EQUIPMENT) | c.rlike("|".join(EQUIPMENT_PARTS)), F.lit(False))


def is_terminal(c: Column) -> Column:
    return F.coalesce(c.isin(*TERMINALS) | c.endswith("Terminal") | c.endswith("Port"), F.lit(False))


def is_container(c: Column) -> Column:
    return F.coalesce(c.isin(*CONTAINERS), F.lit(False))


def is_context(id_: Column, kind: Column | None = None) -> Column:
    """Whether a node is a label that elements refer to: by its kind, or by the start of its identifier."""
    named = id_.startswith("System::") | id_.startswith("Zone::") | id_.startswith("Classification::")
    return named if kind is None else F.coalesce(kind == "context", F.lit(False)) | named


def legend(edges: DataFrame) -> DataFrame:
    """(bucket, relation, n): distinct edges by relation, symmetric ones once, for a legend."""
    bucket = reduce(lambda c, x: c.when(F.col("relation").isin(*x[1]), x[0]), (("spatial", SPATIAL), ("topology", TOPOLOGY), ("explicit", EXPLICIT)), F.when(F.col("relation").isin(*HIERARCHY), "hierarchy"))
    return relation_counts(edges).select(bucket.alias("bucket"), "relation", "n")


def canonical(edges: DataFrame) -> DataFrame:
    """Each edge once: symmetric ones with the smaller end first; of several the first by its other columns; self-loops go."""
    swap = F.col("relation").isin(*SYMMETRIC)
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    a, b = F.when(swap, F.least("src", "dst")).otherwise(F.col("src")), F.when(swap, F.greatest("src", "dst")).otherwise(F.col("dst"))
    key = ["src", "dst", "relation"] + (["source"] if "source" in rest else [])
    ends = edges.where("src <> dst").select(a.alias("src"), b.alias("dst"), *rest)
    more = [c for c in rest if c not in key]
    if not more:
        return ends.distinct()
    first = ends.groupBy(*key).agg(F.min(F.struct(*more)).alias("_first"))
    return first.select(*key, *[F.col("_first")[c].alias(c) for c in more]).select(*ends.columns)


def steps(edges: DataFrame, relations=None, mode: str = "walk") -> DataFrame:
    """(a, b, relation): moves along edges. walk: forward, and backward on symmetric ones; any: both ways; out: forward; into: backward."""
    e = edges if relations is None else edges.where(F.col("relation").isin(known_relations(relations)))
    forward = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "relation")
    backward = e.select(F.col("dst").alias("a"), F.col("src").alias("b"), "relation")
    if mode == "out":
        return forward
    if mode == "into":
        return backward
    return forward.unionByName(backward if mode == "any" else backward.where(F.col("relation").isin(*SYMMETRIC)))


def neighbours(edges: DataFrame, anchors: DataFrame, relations=None, mode: str = "any") -> DataFrame:
    """(anchor, id, relation) of all distinct neighbours of anchors(id)."""
    s = steps(edges, relations, mode)
    return anchors.select(F.col("id").alias("a")).join(s, "a").select(F.col("a").alias("anchor"), F.col("b").alias("id"), "relation").distinct()


def unmatched(edges: DataFrame, anchors: DataFrame, relation: str) -> DataFrame:
    """(id) of the anchors that have no neighbour by a relation."""
    (name,) = known_relations({"above": "below", "below": "above"}.get(relation, relation))
    e = edges.where(F.col("relation") == name)
    # whom an anchor meets doesn't matter: ends alone, of one reading
    ends = e.select(F.col("src").alias("id")) if relation in DIRECTIONAL else e.select(F.explode(F.array("src", "dst")).alias("id"))
    return anchors.select("id").distinct().join(ends.distinct(), "id", "left_anti")


def related(edges: DataFrame, anchors: DataFrame, relation: str, details: bool = False) -> DataFrame:
    """Union of the neighbours of several anchors by one relation: id, matched_anchors (how many) and the least of them; with details also anchor_ids (all of them, as many as were asked for at most) and the
    best of what the edges measure: least distance and gap, greatest area. above and below are seen from the anchor: what is above it is what lies in an edge `below` from it."""
    (name,) = known_relations({"above": "below", "below": "above"}.get(relation, relation))
    best = {"distance": F.min, "gap": F.min, "area": F.max}
    measures = [c for c in best if c in edges.columns and details]
    e = edges.where(F.col("relation") == name)
    move = e.select(F.col("src").alias("a"), F.col("dst").alias("id"), *measures)
    if relation not in DIRECTIONAL:
        move = move.unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("id"), *measures))
    met = anchors.select(F.col("id").alias("a")).distinct().join(move, "a")
    return met.groupBy("id").agg(F.countDistinct("a").alias("matched_anchors"), F.min("a").alias("first_anchor"), *([F.array_sort(F.collect_set("a")).alias("anchor_ids")] if details else []), *[best[c](c).alias(c) for c in measures])


def moves(rows: DataFrame, again: bool = False) -> DataFrame:
    """Moves (a, b), written once, as every level of a walk reads them; distinct ones, unless those that come again may stay, as they do no harm in a walk and cost a shuffle. Joins with them are merges
    unless the other side is sent: a broadcast of it may be too much for the driver."""
    rows = rows.select("a", "b")
    return staged(rows if again else rows.distinct()).hint("merge")


#: So many rows are sent to the moves or edges at most; more of them meet these by a merge, as a broadcast would send whole levels through the driver.
SENT = 50_000


def counted(rows: DataFrame) -> int:
    """The number of rows, of more than SENT that there are more."""
    return rows.limit(SENT + 1).count()


def sent(rows: DataFrame, n: int) -> DataFrame:
    """n rows as the smaller side of a join: broadcast if they are few, so that what they meet stays where it is, else merged."""
    return F.broadcast(rows) if n <= SENT else rows.hint("merge")


def walk(move: DataFrame, seeds: DataFrame, depth: int | None) -> DataFrame:
    """(seed, id, depth, parent) of what seeds(id) reach by moves (a, b) within a number of levels, or of any number for None, by shortest ways; of equal ways the least parent's."""
    move = moves(move, again=True) if depth is None or depth > 1 else move.select("a", "b")
    front = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth"), F.lit(None).cast(seeds.schema["id"].dataType).alias("parent")).distinct()
    seen, size = front, counted(seeds)
    for level in count(1) if depth is None else range(1, depth + 1):
        new = move.join(sent(front, size), F.col("id") == F.col("a")).groupBy("seed", F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        new = new.join(seen.select("seed", "id").hint("merge"), ["seed", "id"], "left_anti").select("seed", "id", F.lit(level).alias("depth"), "parent")
        front = kept(new)
        size = counted(front)
        if not size:
            break
        seen = seen.unionByName(front)
    return seen


def descendants(edges: DataFrame, seeds: DataFrame, depth: int | None = None, relations=("contains",)) -> DataFrame:
    """(seed, id, depth) of what lies below seeds, seeds left out."""
    return walk(steps(edges, relations, "out"), seeds, depth).where("depth > 0").select("seed", "id", "depth")


def elements_below(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Descendants that aren't containers themselves; containers are walked through."""
    below = descendants(edges, seeds)
    return below.join(nodes.where(~is_container(F.col("class_"))), "id")


def ancestors(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(seed, id, depth) of the containers above seeds."""
    return walk(steps(edges, ("contained_in",), "out"), seeds, depth).where("depth > 0").select("seed", "id", "depth")


def container_of(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, class_: str) -> DataFrame:
    """(seed, id): the nearest container of a class above each seed."""
    up = ancestors(edges, seeds).join(nodes.where(F.col("class_") == class_).select("id"), "id", "left_semi")
    return up.groupBy("seed").agg(F.min_by("id", F.struct("depth", "id")).alias("id"))


def same_container(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, class_: str = "IfcBuildingStorey") -> DataFrame:
    """(seed, id) of other elements in each seed's nearest container of a class."""
    home = container_of(nodes, edges, seeds, class_).withColumnRenamed("id", "home")
    below = elements_below(nodes, edges, home.select(F.col("home").alias("id")).distinct()).select(F.col("seed").alias("home"), "id")
    return home.join(below, "home").where("id <> seed").select("seed", "id")


def excluding(edges: DataFrame, container: DataFrame, excluded: DataFrame, depth: int = 4) -> DataFrame:
    """(id) below containers by contains and aggregates, without excluded ones and what is below those."""
    relations = ("contains", "aggregates")
    inside = descendants(edges, container, depth, relations).select("id").distinct()
    out = descendants(edges, excluded, depth, relations).select("id").unionByName(excluded.select("id"))
    return inside.join(out, "id", "left_anti")


def traverse(edges: DataFrame, seeds: DataFrame, depth: int, relations=None) -> DataFrame:
    """(seed, from_id, to_id, relation, depth): every edge, parallel ones too, over which a node was found first, from the node that found it."""
    move = steps(edges, relations, "walk")
    found = walk(move, seeds, depth).where("depth > 0")
    return found.join(move, (F.col("a") == F.col("parent")) & (F.col("b") == F.col("id"))).select("seed", F.col("a").alias("from_id"), F.col("b").alias("to_id"), "relation", "depth")


def trace(edges: DataFrame, seeds: DataFrame, depth: int = 3, relations=NETWORK) -> DataFrame:
    """(seed, id, depth, parent) of the network around seeds, edges taken both ways."""
    return walk(steps(edges, relations, "any"), seeds, min(depth, 6)).where("depth > 0")


def shortest_path(edges: DataFrame, start, end, longest: int = 8, relations=None) -> DataFrame:
    """(hop, from_id, to_id, relation) of one shortest way between two nodes; no rows if there is none within the bound."""
    from . import paths

    try:
        way = paths.between(edges, start, end, relations, min(longest, 20))
    except paths.NoPath:
        way = [start]
    spark = edges.sparkSession
    rows = spark.createDataFrame([(0, way)], "n int, path array<string>" if isinstance(start, str) else "n int, path array<long>")
    return paths.grounded(rows, edges, ["n"], relations).select(F.explode("steps").alias("s")).select("s.hop", "s.from_id", "s.to_id", "s.relation")


def match_score(label: Column, query: str) -> Column:
    """3 for the same text without case, 2 for the same words, 1 if one holds the other, else null."""
    raw, words = F.lower(F.trim(label)), tx.plain(label)
    q, qw = query.strip().lower(), tx.plain_of(query)
    return F.when(raw == q, 3).when((words != "") & F.lit(qw != "") & (words == qw), 2).when((words != "") & F.lit(qw != "") & (words.contains(qw) | F.lit(qw).contains(words)), 1)


def by_classification(nodes: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """(id, score, labels) of elements classified as something like the query."""
    hits = nodes.where(F.col("class_") == "Classification").select(F.col("id").alias("dst"), "label", match_score(F.col("label"), query).alias("score")).where("score IS NOT NULL")
    hits = staged(hits)
    of = edges.where(F.col("relation") == "classified_as").select("src", "dst")
    return of.join(sent(hits, counted(hits)), "dst").groupBy(F.col("src").alias("id")).agg(F.max("score").alias("score"), F.array_sort(F.collect_set("label")).alias("labels"))


def serving(nodes: DataFrame, edges: DataFrame, spaces: DataFrame, depth: int = 4, seed: bool = False) -> DataFrame:
    """(space, id, score, hops, kind, strength): equipment that may serve spaces, terminals only where there is no equipment.

    Seeds are what a space contains (6 or 5 for equipment or terminals), is bounded by (5, 4) or adjoins (4, 3); from them the network is walked, and hops lower the score. With seed, also the one where the best way begins.
    """
    kinds = nodes.select("id", is_equipment(F.col("class_")).alias("equipment"), is_terminal(F.col("class_")).alias("terminal")).where("equipment OR terminal")
    parts = []
    for relations, mode, base in ((("contains",), "out", 6), (("space_bounded_by", "bounds_space"), "any", 5), (SPATIAL, "any", 4)):
        parts.append(neighbours(edges, spaces, relations, mode).select("anchor", "id", F.lit(base).alias("base")))
    seeds = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(kinds, "id").select("anchor", "id", (F.col("base") - (~F.col("equipment")).cast("int")).alias("base"))
    seeds = kept(seeds.groupBy("anchor", "id").agg(F.max("base").alias("base")))
    reach = serving_walk(edges, seeds, depth)
    reach = seeds.select("anchor", "base", F.col("id").alias("seed")).join(reach.select("seed", "id", "depth"), "seed").join(kinds, "id")
    score = F.when(F.col("depth") == 0, F.col("base")).otherwise(F.col("base") + F.greatest(F.lit(0), 2 - F.col("depth")) + F.col("equipment").cast("int"))
    best = reach.where("id <> anchor").withColumn("score", score).groupBy(F.col("anchor").alias("space"), "id").agg(F.max("score").alias("score"), F.min("depth").alias("hops"), F.max("equipment").alias("equipment"), F.min_by("seed", F.struct(-F.col("score"), "depth", "seed")).alias("seed"))
    any_equipment = best.groupBy("space").agg(F.max("equipment").alias("some"))
    best = best.join(any_equipment, "space").where("equipment OR NOT some")
    return best.select("space", "id", "score", "hops", F.when(F.col("equipment"), "equipment").otherwise("terminal").alias("kind"), F.when(F.col("score") >= 6, "strong").when(F.col("score") >= 4, "moderate").otherwise("weak").alias("strength"), *(["seed"] if seed else []))


def serving_walk(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, id, depth, parent) of the network around equipment and terminals (id) of spaces."""
    return walk(steps(edges, SERVING, "any"), seeds.select("id").distinct(), min(depth, 6))


def shared_boundaries(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(src, dst, shared) of spaces that a common element bounds, whichever of the two relations says so; with nodes only spaces count, and openings bound nothing."""
    ends = lambda relation, element, space: edges.where(F.col("relation") == relation).select(F.col(element).alias("element"), F.col(space).alias("space"))
    of = ends("bounds_space", "src", "dst").unionByName(ends("space_bounded_by", "dst", "src")).where("element <> space").distinct()
    if nodes is not None:
        of = of.join(nodes.where(F.col("class_") == "IfcSpace").select(F.col("id").alias("space")), "space", "left_semi")
        of = of.join(nodes.where(F.col("class_") == "IfcOpeningElement").select(F.col("id").alias("element")), "element", "left_anti")
    a, b = of.select("element", F.col("space").alias("src")), of.select("element", F.col("space").alias("dst"))
    return a.join(b, "element").where("src < dst").groupBy("src", "dst").agg(F.array_sort(F.collect_set("element")).alias("shared"))


def containment(children: DataFrame) -> DataFrame:
    """Edges both ways from (id, parent), made of one reading."""
    way = lambda src, dst, relation: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(relation).alias("relation"))
    return children.where("parent IS NOT NULL").select(F.explode(F.array(way("parent", "id", "contains"), way("id", "parent", "contained_in"))).alias("w")).select("w.*")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes by class and edges by relation."""
    return nodes.groupBy(F.lit("class").alias("kind"), F.col("class_").alias("name")).agg(F.count("*").alias("n")).unionByName(
        edges.groupBy(F.lit("relation").alias("kind"), F.col("relation").alias("name")).agg(F.count("*").alias("n"))
    )


def top_degrees(edges: DataFrame, limit: int = 10) -> DataFrame:
    """(id, degree) of the nodes with most edge ends."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(limit)


def relation_counts(edges: DataFrame) -> DataFrame:
    """(relation, n): distinct edges, of symmetric relations distinct pairs of ends."""
    e = canonical(edges.select("src", "dst", "relation"))
    return e.groupBy("relation").agg(F.count("*").alias("n"))


def inverse_pair_counts(edges: DataFrame) -> DataFrame:
    """(pair, n): facts stated by a relation or its inverse, counted once."""
    back = {v: k for k, v in INVERSE.items()}
    name = reduce(lambda c, kv: c.when(F.col("relation") == kv[0], kv[1]), back.items(), F.when(F.col("relation").isin(*INVERSE), F.col("relation"))).alias("first")
    flip = F.col("relation").isin(*back)
    e = edges.where(F.col("relation").isin(*INVERSE, *back)).select(name, F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("a"), F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("b")).distinct()
    other = reduce(lambda c, kv: c.when(F.col("first") == kv[0], kv[1]), INVERSE.items(), F.when(F.lit(False), F.lit("")))
    return e.groupBy(F.concat_ws("/", "first", other).alias("pair")).agg(F.count("*").alias("n"))


def top_per_node(pairs: DataFrame, measure: str, k: int) -> DataFrame:
    """Pairs (a, b) that are among the k strongest of either end."""
    end = lambda own, other: F.struct(F.col(own).alias("own"), F.col(other).alias("other"))
    # both ends of one reading of the pairs
    ends = pairs.select("a", "b", F.col(measure), F.explode(F.array(end("a", "b"), end("b", "a"))).alias("e")).select("a", "b", measure, "e.*")
    w = Window.partitionBy("own").orderBy(F.desc(measure), "other")
    return ends.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("a", "b", measure).distinct()
