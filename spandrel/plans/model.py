"""One object for a set of models: questions for the tables, and actions on the graph.

Every action returns a lazy, bounded, totally ordered DataFrame with ``total_found``, ``returned_count`` and ``truncated``; an identifier that names nothing or several nodes, a relation that doesn't exist
and a parameter out of range raise ValueError.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx
from ..functions import values
from ..operators import classes, graph, lookups, paths, relational, search, spatial
from ..operators.relational import Tables
from ..operators.request import Field, Request
from ..operators.staging import kept, staged
from ..sources import records, step_model, store
from .router import Route, route

# Default limits.
SCAN, NEAR, HARD_CAP = 50, 25, 100


@dataclass
class Policy:
    """How derived edges are made."""

    excluded: tuple[str, ...] = spatial.EXCLUDED
    overlap: str = "none"
    min_ratio: float = spatial.MIN_RATIO
    top_k: int = spatial.TOP_K
    threshold: float | None = None


class Model:
    def __init__(self, tables: Tables | Callable[[], Tables], nodes: DataFrame, stated: DataFrame, policy: Policy | None = None):
        self._tables, self.nodes, self.stated, self.policy = tables, nodes, stated, policy or Policy()
        self.spark = nodes.sparkSession

    @cached_property
    def tables(self) -> Tables:
        return self._tables() if callable(self._tables) else self._tables

    @classmethod
    def read(cls, spark: SparkSession, *paths: str, policy: Policy | None = None) -> Model:
        return cls.of_records(records.read(spark, *paths), policy)

    @classmethod
    def of_records(cls, rows: DataFrame, policy: Policy | None = None) -> Model:
        """A model of records; its tables are made when they are first asked for."""
        return cls(lambda: records.tables(rows), *records.graph(rows), policy)

    @classmethod
    def read_step(cls, spark: SparkSession, *paths: str, policy: Policy | None = None, strict: bool = False) -> Model:
        """A model of STEP files: elements, types and containers with their attributes, relations and geometry. strict refuses files that refer to what isn't there, repeat ids or the like."""
        return cls.of_records(kept(step_model.read(spark, *paths, strict=strict)), policy)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, *datasets: str, policy: Policy | None = None) -> Model:
        """A saved model, or some datasets of it; edges that were derived when it was saved are not derived again."""
        f = store.read(spark, folder, *datasets)
        own = cls(Tables(f["elements"], f["properties"], f["quantities"]), f["nodes"], f["edges"].where(F.col("relation").isin(*graph.HIERARCHY, *graph.EXPLICIT, "space_bounded_by", "bounds_space", "path_connected_to")), policy)
        own.__dict__["edges"] = f["edges"]
        return own

    def with_classes(self, pairs: DataFrame) -> Model:
        """The same model with a class hierarchy (child, parent), as ontologies give it: requests for a class then take in all its subtypes."""
        t = self.tables
        own = Model(Tables(t.elements, t.properties, t.quantities, kept(classes.intervals(pairs))), self.nodes, self.stated, self.policy)
        own.__dict__.update({k: v for k, v in self.__dict__.items() if k in ("shapes", "derived", "edges")})
        return own

    def _frames(self) -> dict[str, DataFrame]:
        home = self.nodes.select(F.col("id").alias("src"), "dataset").distinct()
        edges = self.edges.join(home, "src").withColumn("source", paths.source_of(F.col("relation")))
        return {"elements": self.tables.elements, "properties": self.tables.properties, "quantities": self.tables.quantities, "nodes": self.nodes, "edges": edges}

    def save(self, folder: str) -> str:
        """Writes tables, nodes and all edges below a folder, as a new version."""
        return store.write(folder, self._frames())

    @classmethod
    def update(cls, spark: SparkSession, folder: str, *sources: str, policy: Policy | None = None, step: bool = False) -> dict[str, list[str]]:
        """Brings a saved model up to date with its source files (records, or with step STEP files): only datasets whose files are new or changed are read, derived and written; the others keep their tables
        and edges. The names of built, kept and removed datasets. A policy must be the one of before, as kept edges aren't made anew."""
        build = lambda files: (cls.read_step if step else cls.read)(spark, *files, policy=policy)._frames()
        return store.update(spark, folder, list(sources), build)

    # Tables

    def answer(self, request: Request) -> dict[str, DataFrame]:
        """The plans of an answer: rows, totals (how many there are in all, with and without the field) and the first few elements as evidence."""
        return {"rows": self.run(request), "totals": relational.totals(self.tables, request), "evidence": relational.evidence(self.tables, request)}

    def answer_each(self, request: Request, strict: bool = True) -> tuple[dict[str, DataFrame], dict[str, str]]:
        """The request for each dataset on its own, and the errors by dataset; strict raises the first one."""
        done, failed = {}, {}
        for name in [r[0] for r in self.tables.elements.select("dataset").distinct().orderBy("dataset").collect()]:
            only = lambda df: df.where(F.col("dataset") == name)  # noqa: B023,E731
            try:
                got = relational.execute(Tables(only(self.tables.elements), only(self.tables.properties), only(self.tables.quantities), self.tables.classes), request)
                done[name] = got
                if request.intent == "aggregate" and request.aggregate_op != "count":
                    relational.checked(got)
            except ValueError as error:
                if strict:
                    raise
                done.pop(name, None)
                failed[name] = str(error)
        return done, failed

    def ask(self, question: str) -> tuple[Route, DataFrame | None]:
        """Where a question goes, and the plan of its answer if the tables can give it."""
        to = route(question)
        return to, self.run(to.request) if to.request else None

    def run(self, request: Request) -> DataFrame:
        """The plan of a request; it fails when it runs if a sum, average, minimum or maximum meets values that aren't numeric."""
        plan = relational.execute(self.tables, request)
        return relational.guarded(plan) if request.intent == "aggregate" else plan

    # Graph

    @cached_property
    def shapes(self) -> DataFrame:
        return self.nodes.where("lo IS NOT NULL AND hi IS NOT NULL").select("dataset", "id", "class_", "lo", "hi", F.coalesce("centre", F.transform(F.arrays_zip("lo", "hi"), lambda z: (z["lo"] + z["hi"]) / 2)).alias("centre"), F.when(F.col("centre").isNull(), "bbox_center_fallback").otherwise("centroid").alias("point_method"), self._footprint().alias("points"))

    def _places(self) -> DataFrame:
        """Shapes with their meshes, and nodes that have a centre alone."""
        mesh = F.col("mesh") if "mesh" in self.nodes.columns else F.lit(None).cast("array<array<double>>")
        boxed = F.col("lo").isNotNull() & F.col("hi").isNotNull()
        rows = self.nodes.where(boxed | F.col("centre").isNotNull()).select("dataset", "id", "class_", *[F.when(boxed, F.col(c)).otherwise(F.col("centre")).alias(c) for c in ("lo", "hi")], F.col("centre").alias("c"), boxed.alias("boxed"), mesh.alias("mesh"))
        return rows.withColumn("centre", F.coalesce("c", F.transform(F.arrays_zip("lo", "hi"), lambda z: (z["lo"] + z["hi"]) / 2))).drop("c")

    def _footprint(self) -> Column:
        """The stated plan polygon of a node, else its box's plan."""
        box = g.rectangle(F.col("lo"), F.col("hi"))
        return F.coalesce(F.col("footprint"), box) if "footprint" in self.nodes.columns else box

    @cached_property
    def derived(self) -> DataFrame:
        """Adjacency and plan topology between shapes of one model: src, dst, relation, distance, gap, area. Written once, as every action on edges reads it."""
        p = self.policy
        near = spatial.adjacency(self._places(), p.threshold, p.excluded).select(F.col("a").alias("src"), F.col("b").alias("dst"), "relation", "distance", "distance_method")
        rows = self.shapes.where(~F.col("class_").isin(*p.excluded))
        over = spatial.plan_overlaps(rows)
        up = spatial.above_below(over)
        meet = spatial.intersections(rows).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("intersects_bbox").alias("relation"))
        plan = spatial.overlap_edges(spatial.plan_overlaps(rows, p.top_k) if p.overlap == "top_k" else over, p.overlap, p.min_ratio, p.top_k).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("overlaps_xy").alias("relation"), "area")
        out = near
        for more in (up, meet, plan):
            out = out.unionByName(more, allowMissingColumns=True)
        return kept(out)

    @cached_property
    def edges(self) -> DataFrame:
        """Stated and derived edges, written once: walks and paths read them many times."""
        bounds = graph.shared_boundaries(self.stated, self.nodes).select("src", "dst", F.lit("shares_boundary_with").alias("relation"))
        return kept(self.stated.unionByName(bounds).unionByName(self.derived, allowMissingColumns=True))

    def resolve(self, wanted: str, classes: tuple[str, ...] | None = None) -> str:
        """The one node that an identifier means: its id, its global or express id, or a container's label."""
        n = self.nodes if classes is None else self.nodes.where(F.col("class_").isin(*classes))
        rank = F.when(F.col("id") == wanted, 0).when(F.col("global_id") == wanted, 1).when(F.col("express_id").cast("string") == wanted, 2)
        rank = rank.when(graph.is_container(F.col("class_")) & (tx.plain(F.col("label")) == tx.plain_of(wanted)), 3)
        found = n.select("id", rank.alias("r")).where("r IS NOT NULL").distinct().orderBy("r", "id").limit(2).collect()
        if not found:
            raise ValueError(f"no node is called {wanted!r}")
        if len(found) > 1 and found[0].r == found[1].r:
            raise ValueError(f"several nodes are called {wanted!r}")
        return found[0].id

    def _one(self, wanted: str, classes=None) -> DataFrame:
        return self._ids([self.resolve(wanted, classes)])

    def resolve_all(self, wanted: list[str]) -> list[str]:
        """The nodes that identifiers mean, in their order and each once, by one query for all of them."""
        # as many rows as were asked for, so they are what is sent around; nodes are read once
        rows = [(w, w, k) for w in dict.fromkeys(wanted) for k in range(3)] + [(w, tx.plain_of(w), 3) for w in dict.fromkeys(wanted)]
        asked = F.broadcast(self.spark.createDataFrame(rows, "wanted string, name string, rank int"))
        words = F.when(graph.is_container(F.col("class_")), tx.plain(F.col("label")))
        names = F.array(*[F.struct(c.alias("name"), F.lit(k).alias("rank")) for k, c in enumerate((F.col("id"), F.col("global_id"), F.col("express_id").cast("string"), words))])
        hits = self.nodes.select("id", F.explode(names).alias("n")).select("id", "n.*").join(asked, ["name", "rank"])
        best = hits.groupBy("wanted", "id").agg(F.min("rank").alias("rank")).groupBy("wanted", "rank").agg(F.count("*").alias("n"), F.min("id").alias("id"))
        found = {r.wanted: r.f for r in best.groupBy("wanted").agg(F.min(F.struct("rank", "n", "id")).alias("f")).collect()}
        for w in wanted:
            if w not in found:
                raise ValueError(f"no node is called {w!r}")
            if found[w].n > 1:
                raise ValueError(f"several nodes are called {w!r}")
        return list(dict.fromkeys(found[w].id for w in wanted))

    def _ids(self, names: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in names], "id string")

    def _of_class(self, class_: str | None = None) -> DataFrame:
        return self.nodes.where(F.lower("class_") == ("ifc" + class_.lower().removeprefix("ifc"))) if class_ else self.nodes

    def _shown(self, ids: DataFrame, class_: str | None = None) -> DataFrame:
        """The compact columns of nodes, with what ids brings. All nodes are never sent through the driver."""
        return ids.join(self._of_class(class_).select("id", "global_id", "label", "class_").hint("merge"), "id")

    def _bounded(self, rows: DataFrame, limit: int, *order: Column) -> DataFrame:
        if limit < 1:
            raise ValueError("a limit must be at least 1")
        return relational.bounded(rows, [*order, F.coalesce("label", F.lit("")).asc(), F.col("id").asc()], limit, HARD_CAP)

    def _storey(self, wanted: str) -> str:
        return self.resolve(wanted, ("IfcBuildingStorey",))

    def act(self, action: str, **params) -> DataFrame:
        """An action by name."""
        if action not in ACTIONS:
            raise ValueError(f"no such action: {action}; there are {', '.join(ACTIONS)}")
        return getattr(self, action)(**params)

    def get_elements_in_storey(self, storey: str, max_results: int = SCAN) -> DataFrame:
        below = graph.elements_below(self.nodes.select("id", "class_").hint("merge"), self.stated, self._ids([self._storey(storey)])).select("id").distinct()
        return self._bounded(self._shown(below), max_results)

    def find_elements_by_class(self, class_: str, max_results: int = SCAN) -> DataFrame:
        return self._bounded(self._of_class(class_).select("id", "global_id", "label", "class_"), max_results)

    def find_nodes(self, class_: str | None = None, filters: dict | None = None, max_results: int = SCAN) -> DataFrame:
        """Nodes of a class whose properties have the values given: of the element itself (Name, TypeName, ...), else by name in any set, by set and name, or deeper inside a nested value (Set.Name.Key).
        A list asks for any of its values."""
        hits = self._of_class(class_)
        hits = hits.where("express_id IS NOT NULL") if filters else hits
        for name, wanted in (filters or {}).items():
            any_of = wanted if isinstance(wanted, list | tuple | set) else [wanted]
            match = lambda text, number: reduce(or_, [relational.compare("eq", w, text, number) for w in any_of])  # noqa: B023,E731
            column = lookups.COLUMNS.get(name.lower().replace("_", ""))
            if column:
                own = self.tables.elements
                text, number = (F.lit(None).cast("string"), F.col(column).cast("double")) if column == "express_id" else (F.col(column), F.lit(None).cast("double"))
                hits = hits.join(own.where(match(text, number)).select("dataset", "express_id"), ["dataset", "express_id"], "left_semi")
                continue
            rows = lookups.nested(self.tables, name).where(match(F.col("text"), F.col("number")))
            hits = hits.join(rows.select("dataset", "express_id"), ["dataset", "express_id"], "left_semi")
        hits = hits.select("id", "global_id", "label", "class_")
        return self._bounded(staged(hits) if filters else hits, max_results)

    def find_described(self, class_: str, filters: dict | None = None, max_results: int = SCAN) -> DataFrame:
        """find_nodes for a class as people write it: several words are looked up by likeness, one word means the class most like it."""
        if " " in class_.strip():
            return self.fuzzy_find_nodes(class_, top_k=max_results)
        return self.find_nodes(search.like_class(self.nodes, class_) or class_, filters, max_results)

    def overlays(self, most: int = 8) -> DataFrame:
        """(src, dst, relation) for display only: up to so many aligned shapes of each, containers that a point lies in, and elements of the same level."""
        line = spatial.top_aligned(spatial.aligned(spatial.main_axes(self.shapes)), most).select(F.least("own", "other").alias("src"), F.greatest("own", "other").alias("dst"), F.lit("aligned_with").alias("relation")).distinct()
        rooms = self.shapes.where(F.col("class_") == "IfcSpace").select("dataset", "id", "lo", "hi", "points")
        points = self.shapes.where(~graph.is_container(F.col("class_"))).select("dataset", "id", F.col("centre")[0].alias("x"), F.col("centre")[1].alias("y"))
        inside = spatial.inside_footprint(points, rooms).select(F.col("id").alias("src"), F.col("area").alias("dst"), F.lit("inside_footprint_of").alias("relation"))
        # a star on the level's first element, not all pairs
        level = self.nodes.where("level_key IS NOT NULL").select("dataset", "level_key", "id")
        first = level.groupBy("dataset", "level_key").agg(F.min("id").alias("dst"))
        same = level.join(first, ["dataset", "level_key"]).where("id <> dst").select(F.col("id").alias("src"), "dst", F.lit("same_storey_as").alias("relation"))
        return line.unionByName(inside).unionByName(same)

    def find_elements_inside_footprint(self, container: str, class_: str | None = None, max_results: int = SCAN) -> DataFrame:
        own = self.resolve(container)
        area = self.shapes.where(F.col("id") == own).select("dataset", "id", "lo", "hi", "points")
        points = self.shapes.where(~graph.is_container(F.col("class_"))).select("dataset", "id", F.col("centre")[0].alias("x"), F.col("centre")[1].alias("y"))
        inside = spatial.inside_footprint(points, area).select("id").join(self.shapes.select("id", "point_method"), "id")
        return self._bounded(self._shown(inside, class_), max_results)

    def find_same_storey_elements(self, anchor: str, class_: str | None = None, max_results: int = SCAN) -> DataFrame:
        """Elements of the storey above an element, or where none is stated those of the same level."""
        own = self.resolve(anchor)
        n = self.nodes.select("id", "class_")
        if graph.container_of(n, self.stated, self._ids([own]), "IfcBuildingStorey").isEmpty():
            level = self.nodes.where((F.col("id") == own) & F.col("level_key").isNotNull()).select("dataset", "level_key")
            same = self.nodes.where(~graph.is_container(F.col("class_")) & (F.col("id") != own)).join(F.broadcast(level), ["dataset", "level_key"], "left_semi").select("id")
        else:
            same = graph.same_container(n, self.stated, self._ids([own])).select("id").distinct()
        return self._bounded(self._shown(same, class_), max_results)

    def resolve_element_set(self, query: str, class_: str | None = None, match_mode: str = "set", max_results: int = NEAR) -> DataFrame:
        n = self.nodes.withColumn("materials", F.array_join("Materials", " "))
        more = [c for c in ("type_name", "object_type", "description") if c in self.nodes.columns]
        hits = search.element_set(n, query, ("label", "class_", "materials", *more))
        if match_mode == "singular" and hits.limit(2).count() != 1:
            raise ValueError("the query does not name exactly one element")
        return self._bounded(self._shown(hits.drop("label"), class_), max_results, F.desc("exact_fields"), F.desc("matched_fields"), F.asc("extra_terms"))

    def relate_element_set(self, anchors: list[str], relation: str, max_results: int = NEAR) -> DataFrame:
        """Neighbours of any of some elements, with the anchors that each was matched by and the best of what the edges measure; those nearest first."""
        names = self._ids(self.resolve_all(anchors))
        rows = self._shown(graph.related(self.edges, names, graph.known_relations(relation)[0], details=True))
        return self._bounded(rows, max_results, *[F.asc_nulls_last(c) for c in ("distance", "gap") if c in rows.columns])

    def anchors_without(self, anchors: list[str], relation: str) -> DataFrame:
        """Which of some elements have no neighbour by a relation."""
        rows = graph.unmatched(self.edges, self._ids(self.resolve_all(anchors)), graph.known_relations(relation)[0])
        return self._bounded(self._shown(rows), HARD_CAP)

    def _measured(self, anchor: str, relations, mode: str) -> DataFrame:
        """Neighbours with what the edges measure, the best of parallel ones."""
        own = self.resolve(anchor)
        e = self.edges.where(F.col("relation").isin(*relations))
        out = e.where(F.col("src") == own).withColumn("id", F.col("dst"))
        if mode == "any":
            out = out.unionByName(e.where(F.col("dst") == own).withColumn("id", F.col("src")))
        return out.groupBy("id", "relation").agg(F.min("distance").alias("distance"), F.min("gap").alias("gap"), F.max("area").alias("area"))

    def get_adjacent_elements(self, element: str, max_results: int = NEAR) -> DataFrame:
        return self._bounded(self._shown(self._measured(element, graph.SPATIAL, "any")), max_results, F.asc_nulls_last("distance"))

    def spatial_query(self, near: str, max_distance: float, class_: str | None = None, max_results: int = SCAN) -> DataFrame:
        return self._bounded(self._shown(self._measured(near, graph.SPATIAL, "any").where(F.col("distance") <= max_distance), class_), max_results, F.asc_nulls_last("distance"))

    def get_topology_neighbors(self, element: str, relation: str, max_results: int = NEAR) -> DataFrame:
        """Outgoing for directional relations: `above` lists what the element is above."""
        (name,) = graph.known_relations(relation)
        if name == "aligned_with":
            own = self.resolve(element)
            home = self.shapes.where(F.col("id") == own).select("dataset")
            line = spatial.aligned_to(spatial.main_axes(self.shapes.join(F.broadcast(home), "dataset", "left_semi")), own).select(F.col("b").alias("id"), F.bround("angle", 6).alias("angle"), F.bround("offset", 6).alias("offset"))
            level = self.nodes.where(F.col("id") == own).select("level_key").first()
            away = self.nodes.select("id", (~F.col("level_key").eqNullSafe(F.lit(level.level_key if level else None))).cast("int").alias("other_level"))
            return self._bounded(self._shown(line.join(away, "id")), max_results, F.asc("other_level"), F.asc("angle"), F.asc("offset"))
        rows = self._shown(self._measured(element, (name,), "out" if name in graph.DIRECTIONAL else "any"))
        return self._bounded(rows, max_results, F.asc_nulls_last("gap"), F.desc_nulls_last("area"))

    def get_intersections_3d(self, element: str, max_results: int = NEAR) -> DataFrame:
        """Stated exact intersections; none are derived, as solids aren't modelled."""
        return self.get_topology_neighbors(element, "intersects_3d", max_results)

    def _vertical(self, element: str, relation: str, max_gap: float | None, limit: int) -> DataFrame:
        rows = self._measured(element, (relation,), "out")
        return self._bounded(self._shown(rows if max_gap is None else rows.where(F.col("gap") <= max_gap)), limit, F.asc_nulls_last("gap"))

    def find_elements_above(self, element: str, max_gap: float | None = None, max_results: int = NEAR) -> DataFrame:
        return self._vertical(element, "below", max_gap, max_results)

    def find_elements_below(self, element: str, max_gap: float | None = None, max_results: int = NEAR) -> DataFrame:
        return self._vertical(element, "above", max_gap, max_results)

    def traverse(self, start: str, relation: str | None = None, depth: int = 1, max_results: int = NEAR) -> DataFrame:
        rows = graph.traverse(self.edges, self._one(start), depth, relation).select(F.col("to_id").alias("id"), "from_id", "relation", "depth")
        return self._bounded(self._shown(rows), max_results, F.asc("depth"), F.asc("from_id"), F.asc("relation"))

    def list_property_keys(self, class_: str | None = None) -> DataFrame:
        if class_ is None:
            return relational.attribute_keys(self.tables).orderBy("key")
        own = self.tables.elements.where(F.lower("ifc_class") == ("ifc" + class_.lower().removeprefix("ifc"))).select("dataset", F.col("express_id").alias("element_id"))
        only = lambda df: df.join(own, ["dataset", "element_id"], "left_semi")
        return relational.attribute_keys(Tables(self.tables.elements, only(self.tables.properties), only(self.tables.quantities))).orderBy("key")

    def get_element_properties(self, element: str) -> DataFrame:
        """(set_name, name, value, is_official) of one element; names that its node states without a value are filled from the tables, as all values lie there."""
        own = self.nodes.where(F.col("id") == self.resolve(element)).select("dataset", F.col("express_id").alias("element_id"))
        p = self.tables.properties.select("dataset", "element_id", F.col("pset_name").alias("set_name"), F.col("property_name").alias("name"), "value", "is_official")
        q = self.tables.quantities.select("dataset", "element_id", F.col("qto_name").alias("set_name"), F.col("quantity_name").alias("name"), F.col("value").cast("string").alias("value"), "is_official")
        return p.unionByName(q).join(own, ["dataset", "element_id"], "left_semi").drop("dataset", "element_id").orderBy(F.desc("is_official"), "set_name", "name")

    def _values(self, elements: list[str], field: Field) -> DataFrame:
        ids = kept(self.nodes.join(F.broadcast(self._ids(self.resolve_all(elements))), "id", "left_semi").select("dataset", "express_id"))
        return ids.join(relational.first_values(self.tables, field, ids), ["dataset", "express_id"], "left")

    def aggregate_elements(self, elements: list[str], metric: str, field: Field | None = None) -> DataFrame:
        """value, matched_count, missing_count and non_numeric over exactly these elements."""
        if field is None:
            if metric != "count":
                raise ValueError("this metric needs a field")
            return self._ids(self.resolve_all(elements)).agg(F.count("*").cast("double").alias("value"), F.count("*").alias("matched_count"), F.lit(0).cast("long").alias("missing_count"), F.lit(0).cast("long").alias("non_numeric"))
        there = F.col("text").isNotNull() | F.col("number").isNotNull()
        how = {"count": lambda c: F.count(F.when(there, 1)).cast("double"), "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
        if metric not in how:
            raise ValueError(f"no such metric: {metric}")
        bad = F.count_if(F.col("text").isNotNull() | relational.is_bool(F.col("raw"))) if metric != "count" else F.lit(0).cast("long")
        return self._values(elements, field).agg(how[metric]("number").alias("value"), F.count(F.when(there, 1)).alias("matched_count"), F.count(F.when(~there, 1)).alias("missing_count"), bad.alias("non_numeric"))

    def group_elements_by_property(self, elements: list[str], field: Field, max_groups: int = 20) -> DataFrame:
        """Groups by canonical JSON, so that equal values of other spellings are one group; stored texts without json: are texts."""
        rows = self._values(elements, field).where("raw IS NOT NULL").withColumn("raw", F.coalesce(F.concat(F.lit("json:"), values.canonical(F.col("raw"))), F.col("raw")))
        return rows.groupBy(F.col("raw").alias("value")).agg(F.count("*").alias("count"), F.slice(F.array_sort(F.collect_list("express_id")), 1, 2).alias("samples")).orderBy(F.desc("count"), "value").limit(min(max_groups, 50))

    def trace_distribution_network(self, start: str, max_depth: int = 3, max_results: int = NEAR, relations=graph.NETWORK) -> DataFrame:
        """What the network reaches, with the way to it: path, its steps with relation and source, and the last step's parent and relation."""
        depth = min(max_depth, 6)
        rows = paths.paths(kept(graph.walk(graph.steps(self.edges, relations, "any"), self._one(start), depth)), depth).where("depth > 0").select("id", "depth", "path")
        shown = paths.grounded(self._bounded(self._shown(rows), min(max_results, 50), F.asc("depth")), self.edges, ["id"], relations)
        last = F.element_at("steps", -1)
        return shown.withColumns({"parent": last["from_id"], "relation": last["relation"], "source": last["source"]}).orderBy("depth", F.coalesce("label", F.lit("")), "id")

    def find_shortest_path(self, start: str, end: str, max_path_length: int = 8, relations=None) -> DataFrame:
        """(hop, from_id, to_id, relation, source, direction) of a shortest way; NoPath, with its code, if there is none or it is longer than asked for (20 at most)."""
        if max_path_length < 1:
            raise ValueError("a path has at least one step")
        own = paths.between(self.edges, self.resolve(start), self.resolve(end), relations, min(max_path_length, 20))
        way = self.spark.createDataFrame([(0, own)], "n int, path array<string>")
        return paths.grounded(way, self.edges, ["n"], relations).select(F.explode("steps").alias("s")).select("s.*").orderBy("hop")

    def find_by_classification(self, classification: str, max_results: int = NEAR) -> DataFrame:
        return self._bounded(self._shown(graph.by_classification(self.nodes, self.stated, classification)), min(max_results, 50), F.desc("score"))

    def find_equipment_serving_space(self, space: str, max_depth: int = 4, max_results: int = 10) -> DataFrame:
        own = self._one(space)
        rows = kept(graph.serving(self.nodes.select("id", "class_"), self.edges, own, max_depth, seed=True))
        shown = self._bounded(self._shown(rows), min(max_results, 20), F.asc("kind"), F.desc("score"), F.asc("hops"))
        # the best way: from the space to its seed, and on over the network
        walk = kept(graph.serving_walk(self.edges, rows.select(F.col("seed").alias("id")), max_depth))
        ways = paths.paths(walk, min(max_depth, 6)).select("seed", "id", "path")
        shown = shown.join(ways, ["seed", "id"]).withColumn("path", F.concat(F.array("space"), F.col("path")))
        return paths.grounded(shown, self.edges, ["id"]).orderBy("kind", F.desc("score"), "hops", F.coalesce("label", F.lit("")), "id")

    def fuzzy_find_nodes(self, query: str, class_filter: str | None = None, top_k: int = 10) -> DataFrame:
        n = self.nodes if class_filter is None else self.nodes.where(F.lower("class_") == class_filter.lower())
        return self._bounded(search.fuzzy_nodes(n, query), min(top_k, 25), F.desc("score"))

    def find_container_elements_excluding(self, container: str, exclude: list[str] = (), depth: int = 4, max_results: int = SCAN) -> DataFrame:
        rows = graph.excluding(self.stated, self._one(container), self._ids(self.resolve_all(list(exclude))), depth)
        return self._bounded(self._shown(rows), max_results)

    def search_nodes(self, query: str = "", class_: str | None = None, page: int = 1, page_size: int = 25) -> DataFrame:
        n = self.nodes if class_ is None else self.nodes.where(F.col("class_") == class_)
        hits = search.search(n, query) if query.strip() else n.select("id", "label", "class_", F.lit(0.0).alias("score"))
        if page_size < 1:
            raise ValueError("a page has at least one row")
        return search.page(hits, max(1, page), page_size)

    def get_element(self, element: str) -> DataFrame:
        return self.nodes.where(F.col("id") == self.resolve(element))

    def summary(self) -> DataFrame:
        return graph.summary(self.nodes, self.edges)


ACTIONS = tuple(n for n, f in vars(Model).items() if callable(f) and not n.startswith("_") and n not in ("ask", "run", "answer", "answer_each", "act", "resolve", "resolve_all", "read", "of_records", "read_step", "load", "save", "update", "with_classes"))
