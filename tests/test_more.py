"""Class hierarchies from JSON, requests that are refused, likeness of classes, display overlays."""

import json

import pytest

from spandrel.operators import search
from spandrel.operators.request import Field, Filter, Request
from spandrel.plans.model import Model
from spandrel.plans.router import route
from spandrel.sources import ontology

from .test_model import element


def test_ontology(spark, tmp_path):
    (tmp_path / "many.json").write_text(json.dumps({"IfcWall": ["IfcBuiltElement", "IfcElement"], "IfcDoor": ["IfcBuiltElement"]}))
    (tmp_path / "one.json").write_text(json.dumps({"IfcPump": "IfcFlowMovingDevice"}, indent=2))
    (tmp_path / "none.json").write_text("no json")
    got = {tuple(r) for r in ontology.read(spark, str(tmp_path)).collect()}
    assert got == {("IfcWall", "IfcBuiltElement"), ("IfcBuiltElement", "IfcElement"), ("IfcDoor", "IfcBuiltElement"), ("IfcPump", "IfcFlowMovingDevice")}
    assert ontology.read(spark).count() == 0


def test_requests_are_refused():
    for bad in (
        lambda: Request("count", group_by=Field("element", "name")), lambda: Request("list", aggregate_op="sum"), lambda: Field("property", "a'b"), lambda: Field("property", " "),
        lambda: Filter("property", "a\nb", "eq", 1), lambda: Filter("property", "a", "is", 1),
    ):
        with pytest.raises(ValueError):
            bad()


def test_inflected_cues_go_to_the_graph():
    for q in ("List overlapping walls", "How many walls are touching", "List intersecting beams"):
        assert route(q).kind == "graph"
    two = route("Count elements with property Pset_A.X >= 2.5 and quantity NetVolume < 7").request
    assert [(f.source, f.name, f.op, f.value) for f in two.filters] == [("property", "Pset_A.X", "gte", 2.5), ("quantity", "NetVolume", "lt", 7)]
    assert route("List doors predefined type GATE on level 2").request.predefined_type == "GATE"
    assert route("What is the average of walls?").kind == "graph"


def test_described_classes_and_overlays(spark, tmp_path):
    box = lambda x, y: ([x, y, 0], [x + 4, y + 0.2, 3])
    rows = [element(1, "A", "IfcWall", "north wall", None, box(0, 0), level="Level 1"), element(2, "B", "IfcWall", "far wall", None, box(900, 0.1), level="Level 1"), element(3, "SP", "IfcSpace", "hall", None, ([-1, -1, 0], [6, 6, 3]))]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, rows)))
    m = Model.read(spark, str(tmp_path))
    assert search.like_class(m.nodes, "walls") == "IfcWall" and search.like_class(m.nodes, "qqq") is None
    assert [r.global_id for r in m.find_described("Walls").collect()] == ["B", "A"]
    assert m.find_described("north wall").first().label == "north wall"
    got = {(r.src.split("::")[-1], r.dst.split("::")[-1], r.relation) for r in m.overlays().collect()}
    assert got == {("A", "B", "aligned_with"), ("A", "SP", "inside_footprint_of"), ("B", "A", "same_storey_as")}


def test_groups_and_rooms_by_words(spark):
    from pyspark.sql import functions as F

    from spandrel.plans import router

    asked = {
        "Group walls by level": (True, False), "break  down\ndoors by type": (True, False), "breakdown by type": (False, False), "Grouped by level?": (True, False), "what kinds of doors": (True, False), "which kinds of doors": (False, False),
        "Which types of walls": (True, False), "by group": (False, False), "group, then by": (True, False), "What is in the kitchen?": (False, True), "inside room 12": (False, True), "within the space -x": (False, True), "in the room?": (False, False),
        "in, the kitchen": (False, False), "begin the office": (False, False), "in office": (False, True), "in the": (False, False), "": (False, False),
    }
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    got = {r.q: (r.intent == "group", r.graph == "containment") for r in df.select("q", *[c.alias(n) for n, c in router.intent_columns(F.col("q")).items()]).collect()}
    both = "Which material is near the kitchen? In the kitchen, compare systems"
    assert router.route(both).categories == router.categories(both) == ("containment", "spatial", "system", "material", "comparison") and router.route(both).reason == "containment"
    assert spark.createDataFrame([(both,)], "q string").select(router.intent_columns(F.col("q"))["categories"]).first()[0] == list(router.categories(both))
    assert got == asked == {q: (router.asks_for_groups(q), router.names_a_room(q)) for q in asked}


def test_leaves_of_nested_values(spark):
    from spandrel.operators import relational

    rows = [
        (1, "P", "A", 'json:{"x": {"y": 1, "z": {"w": "deep"}}, "l": [1, {"k": 2}], "n": null, "e": {}}'), (2, "P", "A", 'json:{"x": {"y": 2.5}}'), (3, "P", "A", 'json:"text"'), (4, "P", "B", "json:{broken"), (5, "P", "B", "plain"), (6, "Q", "A.B", 'json:{"y": true}'),
    ]
    df = spark.createDataFrame(rows, "element_id long, pset_name string, property_name string, value string")
    got = {(r.element_id, r.path, r.value) for r in relational.leaves(df, []).collect()}
    assert got == {(1, "P.A.x.y", "json:1"), (1, "P.A.x.z.w", 'json:"deep"'), (1, "P.A.l", 'json:[1,{"k":2}]'), (1, "P.A.n", "json:null"), (1, "P.A.e", "json:{}"), (2, "P.A.x.y", "json:2.5"), (6, "Q.A.B.y", "json:true")}
    assert relational.leaves(df.limit(0), []).count() == 0
    none = spark.createDataFrame([], "element_id long, qto_name string, quantity_name string, value double")
    keys = {r.key: (r.n_elements, r.samples) for r in relational.attribute_keys(relational.Tables(df, df, none)).collect()}
    assert keys["P.A.x.y"] == (2, ["json:1", "json:2.5"]) and keys["A"][0] == keys["P.A"][0] == 3


def test_room_cues_of_long_questions_need_no_list_of_places(spark):
    from spandrel.plans import router

    plan = spark.createDataFrame([("x",)], "text string").transform(router.routed)
    assert "exists(sequence" not in plan._jdf.queryExecution().optimizedPlan().toString()
    words = " ".join(f"word{k}" for k in range(60_000))
    asked = [f"{words} in the kitchen", f"{words} inside room 4", f"{words} in the the kitchen", f"{words} within space ,", f"in the room .{words}", "in", "in the", ""]
    got = [r.graph == "containment" for r in router.routed(spark.createDataFrame([(q,) for q in asked], "text string").coalesce(1)).collect()]
    assert got == [router.names_a_room(q) for q in asked] == [True, True, False, False, True, False, False, False]
