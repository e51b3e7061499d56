"""Requests over eleven elements written as records, and the tables made of them."""

import json

import pytest

from spandrel.functions import text as tx
from spandrel.operators import relational as r
from spandrel.operators.request import Field, Filter, Request
from spandrel.sources import records

ROWS = [
    (1, "IfcWall", "Wall L2 A", "Generic Wall A", "Level 2", {"Qto_WallBaseQuantities": {"NetVolume": 10.0, "NetArea": 12.0}}, {}),
    (2, "IfcWall", "Wall L2 B", "Generic Wall B", "Level 2", {"Qto_WallBaseQuantities": {"NetVolume": 15.5, "NetArea": 14.0}}, {}),
    (3, "IfcWall", "Wall Ground A", "Curtain Wall:Exterior Curtain Wall", "Ground Floor", {"Qto_WallBaseQuantities": {"NetVolume": 7.0, "NetArea": 9.0}}, {}),
    (4, "IfcDoor", "Door L1 A", "Single Flush 900 x 2100", "Level 1", {}, {"Pset_DoorCommon": {"FireRating": "EI30"}}),
    (5, "IfcDoor", "Door L1 B", "Double Glass 1800 x 2100", "Level 1", {}, {"Pset_DoorCommon": {"FireRating": "EI60"}}),
    (6, "IfcDoor", "Door L1 C", "Single Flush 900 x 2100", "Level 1", {}, {"Pset_DoorCommon": {"FireRating": "EI30", "IsExternal": True, "id": 7}}),
    (7, "IfcWindow", "Window Ground A", "Fixed 1200 x 1500", "Ground Floor", {}, {"Pset_WindowCommon": {"UValue": 1.2}}),
    (8, "IfcWindow", "Window Ground B", "Sliding 1800 x 1500", "Ground Floor", {}, {"Pset_WindowCommon": {"UValue": 0.8}}),
    (9, "IfcWindow", "Window L2 A", "Fixed 1200 x 1500", "Level 2", {}, {"Pset_WindowCommon": {"UValue": 1.5}}),
    (10, "IfcWall", "Curtain Wall Ground B", "Curtain Wall:Exterior Curtain Wall", "Ground Floor", {}, {}),
    (11, "IfcWall", "Curtain Wall Ground C", "Curtain Wall:Storefront", "Ground Floor", {}, {}),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("model") / "model-a.jsonl"
    lines = [json.dumps({"GlobalId": f"gid-{i}", "ExpressId": i, "IfcType": c, "Name": n, "TypeName": t, "Hierarchy": {"Level": lv}, "Quantities": q, "PropertySets": {"Official": p, "Custom": {}}}) for i, c, n, t, lv, q, p in ROWS]
    lines += ["", "not json", json.dumps({"GlobalId": "no-express"}), json.dumps({"GlobalId": "gid-1", "ExpressId": 99, "IfcType": "IfcWall"}), json.dumps({"GlobalId": "again", "ExpressId": 1, "IfcType": "IfcSlab"})]
    path.write_text("\n".join(lines))
    t = records.tables(records.read(spark, str(path)))
    return r.Tables(t.elements.cache(), t.properties.cache(), t.quantities.cache())


def value(t, **k):
    return r.aggregate(t, Request("aggregate", **k)).first()


def test_first_record_of_a_key_wins(tables):
    assert tables.elements.count() == 11
    assert tables.elements.where("express_id = 1").first().ifc_class == "IfcWall"
    assert not tables.properties.where("property_name = 'id'").count()


def test_sum_matches_and_misses(tables):
    row = value(tables, ifc_class="IfcWall", level="Level 2", aggregate_op="sum", aggregate_field=Field("quantity", "NetVolume"))
    assert (row.value, row.matched_count, row.missing_count) == (25.5, 2, 0)


def test_group_by_property(tables):
    rows = r.group(tables, Request("group", "IfcDoor", "Level 1", group_by=Field("property", "FireRating"))).collect()
    assert [tuple(x) for x in rows] == [("EI30", 2), ("EI60", 1)]


def test_average_of_a_level(tables):
    row = value(tables, ifc_class="window", level="ground floor", aggregate_op="avg", aggregate_field=Field("property", "Pset_WindowCommon.UValue"))
    assert (row.value, row.matched_count) == (1.0, 2)


def test_attribute_filters(tables):
    low = Request("count", "IfcWindow", "ground floor", filters=(Filter("property", "UValue", "lte", 1.0),))
    big = Request("count", "IfcWall", "Level 2", filters=(Filter("quantity", "Qto_WallBaseQuantities.NetVolume", "gte", 12),))
    assert r.count(tables, low).first()[0] == 1
    assert r.count(tables, big).first()[0] == 1


def test_text_that_is_no_number(tables):
    with pytest.raises(ValueError, match="not numeric"):
        r.checked(r.aggregate(tables, Request("aggregate", "IfcDoor", aggregate_op="avg", aggregate_field=Field("property", "FireRating"))))
    # a text without numeric prefix counts as 0 where it is compared with a number
    assert r.count(tables, Request("count", filters=(Filter("property", "FireRating", "eq", 0),))).first()[0] == 3


def test_text_match_and_name_filter(tables):
    assert r.count(tables, Request("count", text_match="exterior CURTAIN")).first()[0] == 2
    assert r.count(tables, Request("count", filters=(Filter("element", "name", "like", "%ground%"),))).first()[0] == 5
    assert r.count(tables, Request("count", filters=(Filter("element", "express_id", "gt", 9),))).first()[0] == 2


def test_list_is_ordered_and_bounded(tables):
    rows = r.execute(tables, Request("list", "IfcDoor", limit=2)).collect()
    assert [x.name for x in rows] == ["Door L1 A", "Door L1 B"]


def test_bool_is_one_in_comparison(tables):
    assert r.count(tables, Request("count", filters=(Filter("property", "IsExternal", "eq", True),))).first()[0] == 1


def test_requests_are_checked():
    for bad in (dict(intent="sum"), dict(intent="group"), dict(intent="aggregate", aggregate_op="avg"), dict(intent="list", limit=-1)):
        with pytest.raises(ValueError):
            Request(**bad)
    with pytest.raises(ValueError):
        Filter("element", "name", "between", 1)


def test_attribute_keys(tables):
    keys = {x.key: (x.n_elements, x.samples) for x in r.attribute_keys(tables).collect()}
    assert keys["FireRating"] == (3, ['json:"EI30"', 'json:"EI60"'])
    assert keys["Qto_WallBaseQuantities.NetArea"][0] == 3


@pytest.mark.parametrize("raw,key", [("Level 02", "level 2"), ("floor 2", "level 2"), ("Ground Level", "ground floor"), ("GROUND-FLOOR", "ground floor"), ("Basement_01", "basement 1"), ("basement", "basement"), ("Roof!", "roof"), ("  ", None), (None, None), ("level2a 3", "level2a 3"), ("x Level02", "level 2"), ("storey 00", "level 0"), ("00 groundfloor", "ground floor"), ("sublevel 3 floor 7", "level 7"), ("basement 3b", "basement"), ("Floor", "floor"), ("level level 4", "level 4")])
def test_levels(spark, raw, key):
    assert tx.level_key_of(raw) == key
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(raw,)], "a string").select(tx.level_key(F.col("a"))).first()[0] == key


def test_tokens_are_not_substrings(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("round street",), ("ground tree",), (None,)], "a string")
    assert [x[0] for x in d.where(tx.has_all_terms("tree", F.col("a"))).collect()] == ["ground tree"]
    assert d.where(tx.has_all_terms("!!", F.col("a"))).count() == 0


def test_numeric_prefix(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("EI30",), ("12abc",), (" 3.5e1x",), ("-.5",), (None,)], "a string")
    assert [x[0] for x in d.select(tx.numeric_prefix(F.col("a"))).collect()] == [0.0, 12.0, 35.0, -0.5, None]


def test_field_key():
    assert tx.field_key("Net Volume") == "NetVolume"
    assert tx.field_key("Pset_WallCommon.fire rating") == "Pset_WallCommon.FireRating"
