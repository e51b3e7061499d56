"""Records are parsed once, and what reads them many times reads columns."""

import json

import pytest

from spandrel.operators import lookups
from spandrel.plans.model import Model
from spandrel.sources import records


def line(k, gid, cls="IfcWall", parent=None, **more):
    return json.dumps({"ExpressId": k, "GlobalId": gid, "IfcType": cls, "Name": gid, "Hierarchy": {"ParentId": parent}, **more})


SETS = {"Official": {"Pset_B": {"Z": {"a": 1}, "id": 7}, "Pset_A": {"Y": "x", "X": None}, "Pset_N": None}, "Custom": {"Aaa": {"Z": 2.5}}}
LINES = [
    line(1, "S", "IfcBuildingStorey"),
    line(2, "W", parent="S", PropertySets=SETS, Quantities={"Own": {"V": 1.5}, "Qto_W": {"U": 2}}),
    line(2, "LATE", parent="S", PropertySets={"Official": {"P": {"lost": 1}}}),
    json.dumps({"ExpressId": 3, "Name": "no identifier", "PropertySets": {"Official": {"P": {"none": 1}}}}),
    json.dumps({"ExpressId": 4, "Name": "no class yet", "PropertySets": {"Official": {"P": {"early": 1}}}}),
    line(4, "D", "IfcDoor", "W"),
    line(5, "D", "IfcWindow", "S", PropertySets={"Official": {"P": {"second": 1}}}),
]


@pytest.fixture(scope="module")
def rows(spark):
    lines = spark.createDataFrame([("m", k, x) for k, x in enumerate(LINES)], "dataset string, line long, value string")
    return records.parsed(lines)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_parsed_once(rows):
    t, (nodes, edges) = records.tables(rows), records.graph(rows)
    for df in (t.elements, t.properties, t.quantities, nodes, edges):
        assert "from_json" not in plan(df) and "Window" not in plan(df)


def test_records_that_come_again(rows):
    t, (nodes, edges) = records.tables(rows), records.graph(rows)
    assert sorted((r.express_id, r.global_id) for r in t.elements.collect()) == [(1, "S"), (2, "W"), (4, "D")]
    # 4's attributes are those of its first record, 3 and 5 have no element
    assert {(r.element_id, r.property_name) for r in t.properties.collect()} == {(2, "Z"), (2, "Y"), (2, "X"), (4, "early")}
    last = {r.global_id: r.class_ for r in nodes.where("global_id IS NOT NULL").collect()}
    assert last == {"S": "IfcBuildingStorey", "W": "IfcWall", "LATE": "IfcWall", "D": "IfcWindow"}
    down = {(r.src, r.dst) for r in edges.where("relation = 'contains'").collect()}
    assert down == {("Storey::m::S", f"Element::m::{x}") for x in ("W", "LATE", "D")}


def test_attributes_are_numbered_in_their_row(rows):
    t = records.tables(rows)
    p = t.properties.where("element_id = 2").orderBy("id").collect()
    assert [(r.id, r.is_official, r.pset_name, r.property_name, r.value) for r in p] == [(1, 1, "Pset_A", "X", "json:null"), (2, 1, "Pset_A", "Y", 'json:"x"'), (3, 1, "Pset_B", "Z", 'json:{"a":1}'), (4, 0, "Aaa", "Z", "json:2.5")]
    q = t.quantities.orderBy("id").collect()
    assert [(r.id, r.is_official, r.qto_name, r.quantity_name, r.value) for r in q] == [(1, 1, "Qto_W", "U", 2.0), (2, 0, "Own", "V", 1.5)]


def test_all_readings_of_a_name_are_one_scan(rows):
    found = lookups.nested(records.tables(rows), "Pset_B.Z.a")
    assert "Union" not in plan(found) and [(r.express_id, r.number) for r in found.collect()] == [(2, 1.0)]


def test_nodes_are_read_once_for_all_names(rows):
    model = Model.of_records(rows)
    assert model.resolve_all(["S", "W", "Element::m::D"]) == ["Storey::m::S", "Element::m::W", "Element::m::D"]
    # both nodes of express id 2
    assert [r[0] for r in model.find_nodes(filters={"Y": "x"}).select("global_id").collect()] == ["LATE", "W"]
