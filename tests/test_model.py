"""Questions and actions on a small model read from records."""

import json

import pytest

from pyspark.sql import functions as F

from spandrel.operators.request import Field, Request
from spandrel.plans.model import ACTIONS, Model, Policy
from spandrel.sources import store


def element(k, gid, cls, name, parent=None, box=None, relations=None, psets=None, qtos=None, level=None):
    r = {"ExpressId": k, "GlobalId": gid, "IfcType": cls, "Name": name, "Hierarchy": {"ParentId": parent, "Level": level}, "Relationships": relations or {}, "PropertySets": {"Official": psets or {}, "Custom": {}}, "Quantities": qtos or {}}
    if box:
        r["Geometry"] = {"BoundingBox": {"min": box[0], "max": box[1]}}
    return r


ROWS = [
    element(1, "B", "IfcBuilding", "House"),
    element(2, "S1", "IfcBuildingStorey", "Ground Floor", "B"),
    element(3, "S2", "IfcBuildingStorey", "Level 1", "B"),
    element(4, "W1", "IfcWall", "Brick wall", "S1", ([0, 0, 0], [5, 0.2, 3]), {"hosts": ["D1"]}, {"Pset_WallCommon": {"FireRating": "EI 60", "UValue": 0.28}}, {"Qto_W": {"NetVolume": 12.5}}, "Ground Floor"),
    element(5, "W2", "IfcWall", "Timber wall", "S1", ([5, 0, 0], [5.2, 4, 3]), None, {"Pset_WallCommon": {"FireRating": "EI 90", "UValue": 0.35}}, {"Qto_W": {"NetVolume": 7.5}}, "Ground Floor"),
    element(6, "D1", "IfcDoor", "Front door", "S1", ([1, 0, 0], [2, 0.2, 2]), {"hosted_by": ["W1"]}, level="Ground Floor"),
    element(7, "R", "IfcRoof", "Roof", "S2", ([-1, -1, 3.5], [6, 6, 4])),
    element(8, "SP", "IfcSpace", "Room 101", "S1", ([0.2, 0.2, 0], [4.8, 3.8, 3])),
    element(9, "T", "IfcAirTerminal", "Outlet", "SP", ([2, 2, 2.5], [2.2, 2.2, 2.7]), {"belongs_to_system": ["Supply Air"]}),
    element(11, "W3", "IfcWall", "Far wall", None, ([30, 0.05, 0], [35, 0.25, 3]), level="Ground Floor"),
    element(10, "A", "IfcUnitaryEquipment", "Air unit", "S2", ([20, 20, 3], [22, 22, 5]), {"belongs_to_system": ["Supply Air"], "classified_as": ["Pr_70_70"]}),
]


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("m") / "house.jsonl"
    path.write_text("\n".join(map(json.dumps, ROWS)))
    m = Model.read(spark, str(path), policy=Policy(threshold=0.6))
    m.nodes.cache()
    m.stated.cache()
    m.edges.cache()
    return m


def gids(df):
    return [r.global_id for r in df.collect()]


def test_questions(model):
    to, plan = model.ask("How many walls are on the ground floor?")
    assert to.kind == "sql" and plan.first()[0] == 3
    assert model.ask("What is adjacent to the door?")[1] is None
    assert model.ask("What is the total net volume of walls?")[1].first().value == 20.0


def test_containment_actions(model):
    assert gids(model.act("get_elements_in_storey", storey="ground floor")) == ["W1", "D1", "T", "W2"]
    assert gids(model.find_same_storey_elements("W1", "wall")) == ["W2"]
    assert gids(model.find_container_elements_excluding("B", ["S1"])) == ["A", "S2", "R"]
    assert gids(model.find_elements_by_class("wall")) == ["W1", "W3", "W2"]
    row = model.find_elements_by_class("wall", 1).first()
    assert (row.total_found, row.returned_count, row.truncated) == (3, 1, True)


def test_space_actions(model):
    assert gids(model.get_adjacent_elements("W2")) == ["W1", "SP", "R"]
    assert "R" in gids(model.find_elements_above("W1")) and gids(model.find_elements_above("W1", max_gap=0.1)) == []
    assert set(gids(model.find_elements_below("R"))) >= {"W1", "W2", "D1", "T", "SP"}
    assert set(gids(model.find_elements_inside_footprint("SP"))) == {"T", "R"}
    assert "D1" in gids(model.get_topology_neighbors("W1", "intersects_bbox"))
    assert gids(model.spatial_query("W2", 0.1)) == ["W1"]
    assert gids(model.get_intersections_3d("W1")) == []
    assert gids(model.get_topology_neighbors("W1", "aligned_with")) == ["W3"]
    assert set(gids(model.find_same_storey_elements("W3"))) == {"W1", "W2", "D1"}


def test_network_actions(model):
    assert gids(model.find_equipment_serving_space("SP")) == ["A"]
    assert gids(model.find_by_classification("pr 70 70")) == ["A"]
    path = model.find_shortest_path("T", "A", relations=["belongs_to_system"]).collect()
    assert [p.hop for p in path] == [1, 2]
    assert {(p.relation, p.source) for p in path} == {("belongs_to_system", "ifc")}
    served = model.find_equipment_serving_space("SP").first()
    assert served.path[0].endswith("SP") and served.path[-1].endswith("A") and len(served.steps) == len(served.path) - 1
    with pytest.raises(ValueError, match="no way"):
        model.find_shortest_path("T", "A", relations=["typed_by"])
    assert gids(model.traverse("W1", "hosts")) == ["D1"]
    assert gids(model.relate_element_set(["W1", "W2"], "hosts")) == ["D1"]
    assert [r.label for r in model.trace_distribution_network("T", 2, relations=("belongs_to_system",)).collect()] == ["Supply Air", "Air unit"]


def test_property_actions(model):
    assert gids(model.find_nodes("wall", {"FireRating": "EI 60"})) == ["W1"]
    assert model.aggregate_elements(["W1", "W2", "D1"], "sum", Field("quantity", "NetVolume")).first().value == 20.0
    assert model.aggregate_elements(["W1", "W1"], "count").first().value == 1.0
    assert model.aggregate_elements(["W1"], "avg", Field("property", "FireRating")).first().non_numeric == 1
    assert [(r.value, r["count"]) for r in model.group_elements_by_property(["W1", "W2"], Field("property", "FireRating")).collect()] == [('json:"EI 60"', 1), ('json:"EI 90"', 1)]
    assert {r.name for r in model.get_element_properties("W1").collect()} == {"FireRating", "UValue", "NetVolume"}
    assert "Qto_W.NetVolume" in {r.key for r in model.list_property_keys("wall").collect()}


def test_search_actions(model):
    assert gids(model.resolve_element_set("timber wall")) == ["W2"]
    with pytest.raises(ValueError):
        model.resolve_element_set("wall", match_mode="singular")
    assert model.fuzzy_find_nodes("Frnt door").first().label == "Front door"
    page = model.search_nodes("wall", page_size=1, page=2).collect()
    assert [(r.rank, r.pages == r.total) for r in page] == [(2, True)]
    assert model.get_element("4").first().global_id == "W1"


def test_answers_come_with_totals_and_evidence(model):
    got = model.answer(Request("list", "wall", limit=1))
    assert (got["rows"].count(), got["totals"].first().total_count, got["evidence"].count()) == (1, 3, 3)
    by = model.answer(Request("group", "wall", group_by=Field("property", "FireRating")))["totals"].first()
    assert (by.total_count, by.matched_count, by.missing_count) == (3, 2, 1)
    with pytest.raises(Exception, match="not numeric"):
        model.run(Request("aggregate", "wall", aggregate_op="sum", aggregate_field=Field("property", "FireRating"))).collect()


def test_saved_models_are_read_again(model, spark, tmp_path):
    folder = str(tmp_path / "store")
    model.save(folder)
    again = Model.load(spark, folder)
    assert store.datasets_of(spark, folder) == ["house"]
    assert again.nodes.count() == model.nodes.count() and again.edges.count() == model.edges.count()
    assert gids(again.find_elements_by_class("wall")) == ["W1", "W3", "W2"]
    assert again.run(Request("count", "wall")).first()[0] == 3
    with pytest.raises(ValueError):
        Model.load(spark, folder, "nothing")


def test_two_models_never_meet(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, ROWS)))
    m = Model.read(spark, str(tmp_path), policy=Policy(overlap="top_k", top_k=1))
    assert m.edges.where(F.split("src", "::")[1] != F.split("dst", "::")[1]).count() == 0
    one = Model.read(spark, str(tmp_path / "a.jsonl"), policy=Policy(overlap="top_k", top_k=1))
    assert m.edges.count() == 2 * one.edges.count()
    with pytest.raises(ValueError):
        m.resolve("W1")
    assert [r.id for r in m.find_elements_inside_footprint("Element::a::SP").collect()] == ["Element::a::T", "Element::a::R"]
    done, failed = m.answer_each(Request("aggregate", "wall", aggregate_op="sum", aggregate_field=Field("property", "FireRating")), strict=False)
    assert not done and set(failed) == {"a", "b"}


def test_stated_polygons_and_hierarchy(spark, tmp_path):
    space = element(1, "SP", "IfcSpace", "L room", None, ([0, 0, 0], [10, 10, 3]))
    space["Geometry"]["FootprintPolygon2D"] = [[0, 0], [10, 0], [10, 2], [2, 2], [2, 10], [0, 10], [0, 0]]
    rows = [space, element(2, "IN", "IfcFurniture", "in", None, ([1, 1, 0], [1.2, 1.2, 1])), element(3, "OUT", "IfcFurniture", "out", None, ([8, 8, 0], [8.2, 8.2, 1])), element(4, "S", "IfcBuildingStorey", "Level 1")]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, rows)))
    m = Model.read(spark, str(tmp_path))
    found = m.find_elements_inside_footprint("SP").collect()
    assert [(r.global_id, r.point_method) for r in found] == [("IN", "bbox_center_fallback")]
    assert [r.id for r in m.find_container_elements_excluding("Building::m").collect()] == ["Storey::m::S"]
    assert m.anchors_without(["IN", "S"], "hosts").count() == 2


def test_nested_filters(spark, tmp_path):
    rows = [element(1, "W", "IfcWall", "a", psets={"Pset_X": {"Perf": {"U": 0.3, "Ext": True}}}), element(2, "V", "IfcWall", "b", psets={"Pset_X": {"Perf": {"U": 0.4, "Ext": False}}})]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, rows)))
    m = Model.read(spark, str(tmp_path))
    assert gids(m.find_nodes("wall", {"Pset_X.Perf.U": 0.3})) == ["W"]
    assert gids(m.find_nodes("wall", {"Perf.Ext": False})) == ["V"]
    assert gids(m.find_nodes("wall", {"Name": ["a", "b"]})) == ["W", "V"]
    assert gids(m.find_nodes("wall", {"Perf.None": None})) == []


def test_refusals(model):
    assert len(ACTIONS) >= 26
    for bad in (lambda: model.act("drop"), lambda: model.resolve("nobody"), lambda: model.traverse("W1", "likes"), lambda: model.find_elements_by_class("wall", 0), lambda: model.aggregate_elements(["W1"], "sum")):
        with pytest.raises(ValueError):
            bad()
