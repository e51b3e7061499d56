"""Walks and neighbourhoods on small graphs, and graphs made of records."""

import json

from pyspark.sql import functions as F

import pytest

from spandrel.operators import graph as g
from spandrel.sources import records


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), "src string, dst string, relation string")


def nodes(spark, **classes):
    return spark.createDataFrame([(k, v, k) for k, v in classes.items()], "id string, class_ string, label string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_traverse_keeps_parallel_edges(spark):
    e = edges(spark, ("a", "b", "hosts"), ("a", "b", "typed_by"), ("a", "c", "hosts"), ("c", "a", "hosts"))
    got = rows(g.traverse(e, ids(spark, "a"), 1).select("to_id", "relation"))
    assert got == [("b", "hosts"), ("b", "typed_by"), ("c", "hosts")]


def test_walk_goes_back_over_symmetric_edges_only(spark):
    e = edges(spark, ("b", "a", "adjacent_to"), ("c", "a", "hosts"))
    assert rows(g.traverse(e, ids(spark, "a"), 2).select("to_id")) == [("b",)]


def test_related_counts_anchors(spark):
    e = edges(spark, ("w1", "d1", "adjacent_to"), ("w1", "win", "adjacent_to"), ("w2", "d1", "adjacent_to"), ("d2", "w2", "adjacent_to"))
    got = rows(g.related(e, ids(spark, "w1", "w2"), "adjacent_to"))
    assert got == [("d1", 2, "w1"), ("d2", 1, "w2"), ("win", 1, "w1")]


def test_above_is_seen_from_the_anchor(spark):
    e = edges(spark, ("wall", "sand", "above"), ("sand", "wall", "below"))
    assert rows(g.related(e, ids(spark, "sand"), "above").select("id")) == [("wall",)]
    assert rows(g.neighbours(e, ids(spark, "wall"), "above", "out").select("id")) == [("sand",)]


def test_containers_and_storeys(spark):
    n = nodes(spark, b="IfcBuilding", s1="IfcBuildingStorey", s2="IfcBuildingStorey", w1="IfcWall", w2="IfcWall", d="IfcDoor", sand="IfcSlab")
    e = g.containment(spark.createDataFrame([("s1", "b"), ("s2", "b"), ("w1", "s1"), ("w2", "s1"), ("d", "s2"), ("sand", "b")], "id string, parent string"))
    assert rows(g.elements_below(n, e, ids(spark, "b")).select("id")) == [("d",), ("sand",), ("w1",), ("w2",)]
    assert rows(g.same_container(n, e, ids(spark, "w1"))) == [("w1", "w2")]
    assert rows(g.container_of(n, e, ids(spark, "d"), "IfcBuilding")) == [("d", "b")]
    assert rows(g.excluding(e, ids(spark, "b"), ids(spark, "s1"))) == [("d",), ("s2",), ("sand",)]


def test_shortest_path_and_trace(spark):
    e = edges(spark, ("p1", "p2", "ifc_connected_to"), ("p2", "t", "ifc_connected_to"), ("p1", "x", "hosts"), ("x", "t", "typed_by"), ("p2", "t", "hosts"))
    path = rows(g.shortest_path(e, "p1", "t", relations=("ifc_connected_to", "hosts")))
    assert path == [(1, "p1", "p2", "ifc_connected_to"), (2, "p2", "t", "hosts")]
    assert rows(g.shortest_path(e, "p1", "nowhere")) == []
    assert rows(g.trace(e, ids(spark, "t")).select("id", "depth")) == [("p1", 2), ("p2", 1)]


def test_cycles_end(spark):
    e = edges(spark, ("a", "b", "contains"), ("b", "a", "contains"))
    assert rows(g.descendants(e, ids(spark, "a"))) == [("a", "b", 1)]


def test_classification(spark):
    n = spark.createDataFrame([("c1", "Classification", "Pr_70_70_63"), ("c2", "Classification", "Uniclass:Pr_70_70_63:Fans")], "id string, class_ string, label string")
    e = edges(spark, ("ahu", "c1", "classified_as"), ("fan", "c2", "classified_as"))
    assert rows(g.by_classification(n, e, "pr 70 70 63").select("id", "score")) == [("ahu", 2), ("fan", 1)]
    assert rows(g.by_classification(n, e, "PR_70_70_63").select("id", "score")) == [("ahu", 3), ("fan", 1)]


def test_serving_prefers_equipment(spark):
    n = nodes(spark, room="IfcSpace", term="IfcAirTerminal", pipe="IfcPipeSegment", ahu="IfcUnitaryEquipment", far="IfcPump")
    e = edges(spark, ("room", "term", "contains"), ("term", "sys", "belongs_to_system"), ("ahu", "sys", "belongs_to_system"), ("far", "q", "hosts"))
    got = [tuple(r) for r in g.serving(n, e, ids(spark, "room")).collect()]
    assert got == [("room", "ahu", 6, 2, "equipment", "strong")]
    only = edges(spark, ("room", "term", "contains"))
    assert [tuple(r)[1:] for r in g.serving(n, only, ids(spark, "room")).collect()] == [("term", 5, 0, "terminal", "moderate")]


def test_counts(spark):
    e = edges(spark, ("a", "b", "adjacent_to"), ("b", "a", "adjacent_to"), ("a", "b", "above"), ("b", "a", "below"), ("a", "a", "hosts"))
    assert rows(g.relation_counts(e)) == [("above", 1), ("adjacent_to", 1), ("below", 1)]
    assert rows(g.inverse_pair_counts(e)) == [("above/below", 1), ("hosts/hosted_by", 1)]
    assert g.relation_table(spark).count() == 23
    assert rows(g.top_degrees(e, 1)) == [("a", 6)]


def test_shared_boundaries(spark):
    e = edges(spark, ("wall", "s1", "bounds_space"), ("wall", "s2", "bounds_space"), ("slab", "s2", "bounds_space"))
    assert rows(g.shared_boundaries(e)) == [("s1", "s2", ["wall"])]


def test_graph_of_two_datasets(spark, tmp_path):
    record = {"GlobalId": "W", "ExpressId": 1, "IfcType": "IfcWall", "Hierarchy": {"ParentId": "S"}, "Relationships": {"belongs_to_system": ["Supply  Air"], "ifc_connected_to": ["W", "S", "gone"]}}
    storey = {"GlobalId": "S", "ExpressId": 2, "IfcType": "IfcBuildingStorey", "Name": "Ground"}
    for name in ("model-a", "model-b"):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps(record) + "\n" + json.dumps(storey))
    n, e = records.graph(records.read(spark, str(tmp_path)))
    got = rows(e)
    # of each model: containment both ways, a system, a connection, and a project, a building and its storey, whether records state them or not
    assert len(got) == 12 and n.count() == 10
    assert {("Project::model-a", "Building::model-a", "aggregates"), ("Building::model-a", "Storey::model-a::S", "aggregates")} <= set(got)
    assert all(src.split("::")[1] == dst.split("::")[1] for src, dst, _ in got)
    assert ("Element::model-a::W", "System::model-a::Supply Air", "belongs_to_system") in got
    assert n.where(F.col("global_id") == "W").count() == 2


def test_boundaries_from_either_side_of_spaces_alone(spark):
    e = edges(spark, ("wall", "s1", "bounds_space"), ("s2", "wall", "space_bounded_by"), ("s1", "wall", "space_bounded_by"), ("hole", "s1", "bounds_space"), ("hole", "s3", "bounds_space"), ("wall", "zone", "bounds_space"), ("s1", "s1", "bounds_space"))
    assert rows(g.shared_boundaries(e)) == [("s1", "s2", ["wall"]), ("s1", "s3", ["hole"]), ("s1", "zone", ["wall"]), ("s2", "zone", ["wall"])]
    n = spark.createDataFrame([("s1", "IfcSpace"), ("s2", "IfcSpace"), ("s3", "IfcSpace"), ("hole", "IfcOpeningElement"), ("wall", "IfcWall"), ("zone", "IfcZone")], "id string, class_ string")
    assert rows(g.shared_boundaries(e, n)) == [("s1", "s2", ["wall"])]


def test_ways_meet_in_the_middle(spark):
    import random

    from spandrel.operators import paths

    rnd = random.Random(3)
    links = {(rnd.randrange(60), rnd.randrange(60)) for _ in range(75)} | {(k, k + 1) for k in range(100, 117)} | {(200, 201)}
    links = {(a, b) for a, b in links if a != b}
    e = edges(spark, *[(f"n{a}", f"n{b}", rnd.choice(("hosts", "contains"))) for a, b in sorted(links)])
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def hops(start):
        seen, front = {start: 0}, [start]
        while front:
            front = [n for m in front for n in near[m] if n not in seen and not seen.update({n: seen[m] + 1})]
        return seen

    for start, end in ((0, 31), (100, 117), (5, 59), (103, 104), (7, 7), (0, 200), (200, 117)):
        want = hops(start).get(end) if start in near else None
        if want is None:
            with pytest.raises(paths.NoPath) as error:
                paths.between(e, f"n{start}", f"n{end}")
            assert error.value.code == "no_path"
            continue
        way = paths.between(e, f"n{start}", f"n{end}")
        assert (way[0], way[-1], len(way)) == (f"n{start}", f"n{end}", want + 1)
        assert all(int(b[1:]) in near[int(a[1:])] for a, b in zip(way, way[1:]))
    with pytest.raises(paths.NoPath) as error:
        paths.between(e, "n100", "n117", longest=16)
    assert error.value.code == "path_too_long"
    with pytest.raises(paths.NoPath):
        paths.between(e, "n100", "n117", relations=("typed_by",))


def test_all_ways_at_once_with_their_evidence(spark):
    from spandrel.operators import paths

    e = edges(spark, *[(f"{k:02}", f"{k + 1:02}", "ifc_connected_to") for k in range(6)], ("03", "02", "hosts"), ("02", "03", "above"), ("00", "x", "adjacent_to"))
    walk = g.walk(g.steps(e, None, "any"), ids(spark, "00"), 6)
    got = {r.id: r for r in paths.grounded(paths.paths(walk, 6), e, ["id"]).collect()}
    assert {k: r.path for k, r in got.items()} == {f"{k:02}": [f"{j:02}" for j in range(k + 1)] for k in range(7)} | {"x": ["00", "x"]}
    assert [(s.relation, s.source, s.direction) for s in got["04"].steps] == [("ifc_connected_to", "ifc", "forward")] * 4
    assert [(s.relation, s.source) for s in got["x"].steps] == [("adjacent_to", "heuristic")] and got["00"].steps == []
    back = paths.grounded(spark.createDataFrame([(1, ["03", "02"]), (2, ["05", "04"]), (3, ["00", "gone"])], "id int, path array<string>"), e, ["id"])
    assert {r.id: [(s.relation, s.direction) for s in r.steps] for r in back.collect()} == {1: [("hosts", "forward")], 2: [("ifc_connected_to", "backward")], 3: [(None, "backward")]}


def test_unions_with_their_anchors_and_best_measures(spark):
    rows_ = [("a", "x", "adjacent_to", 2.0), ("x", "b", "adjacent_to", 1.0), ("a", "x", "adjacent_to", 5.0), ("a", "y", "above", 3.0), ("y", "a", "below", 3.0), ("c", "z", "adjacent_to", None)]
    e = spark.createDataFrame(rows_, "src string, dst string, relation string, distance double")
    assert rows(g.related(e, ids(spark, "a", "b", "c", "a"), "adjacent_to", details=True)) == [("x", 2, "a", ["a", "b"], 1.0), ("z", 1, "c", ["c"], None)]
    assert rows(g.related(e, ids(spark, "y"), "above", details=True).select("id", "distance")) == [("a", 3.0)]
