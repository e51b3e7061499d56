"""How a level of a walk is joined, and what anchors without a match are compared with."""

from pyspark.sql import functions as F

from spandrel.operators import graph, paths


def test_levels_do_not_go_through_the_driver(spark):
    rows = spark.createDataFrame([(k, k + 1) for k in range(8)] + [(3, 4)], "a long, b long")
    move = graph.moves(rows)
    level = spark.range(5).join(move, F.col("id") == F.col("a"))
    # the plan that ran, not the one before
    assert level.count() == 5 and level.collect() and "Broadcast" not in level._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.depth for r in graph.walk(rows, spark.range(1), None).collect()} == {k: k for k in range(9)}


def test_anchors_without_a_match_are_compared_with_ends(spark):
    e = spark.createDataFrame([("a", "b", "hosts"), ("c", "a", "hosts"), ("d", "e", "above"), ("f", "f", "in_zone")], "src string, dst string, relation string")
    anchors = spark.createDataFrame([(x,) for x in "abcdeff"], "id string")
    left = graph.unmatched(e, anchors, "hosts")
    assert left._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert sorted(r.id for r in left.collect()) == ["d", "e", "f"]
    # below is what an edge above starts from
    assert sorted(r.id for r in graph.unmatched(e, anchors, "below").collect()) == ["a", "b", "c", "e", "f"]


def plan_of(rows):
    rows.collect()
    return rows._jdf.queryExecution().executedPlan().toString()


def test_moves_stay_where_they_are_for_few(spark, monkeypatch):
    move = graph.moves(spark.range(2000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), again=True)
    front = spark.range(5)
    few = plan_of(move.join(graph.sent(front, graph.counted(front)), F.col("id") == F.col("a")))
    assert "BroadcastHashJoin" in few and "hashpartitioning" not in few
    monkeypatch.setattr(graph, "SENT", 3)
    assert "SortMergeJoin" in plan_of(move.join(graph.sent(front, graph.counted(front)), F.col("id") == F.col("a")))


def test_walks_and_ways_are_the_same_by_broadcast_and_by_merge(spark, monkeypatch):
    edges = spark.range(300).select(F.col("id").alias("src"), F.floor(F.col("id") / 3).alias("dst"), F.lit("hosts").alias("relation"))
    edges = edges.unionByName(edges.where("src % 3 = 0")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("typed_by").alias("relation")).where("src % 5 = 0"))
    found = []
    for most in (graph.SENT, 1):
        monkeypatch.setattr(graph, "SENT", most)
        reach = graph.walk(graph.steps(edges, None, "any"), spark.createDataFrame([(0,), (9,)], "id long"), 5).localCheckpoint()
        way = paths.between(edges, 0, 17)
        rows = paths.grounded(paths.paths(reach, 5).where("depth > 0"), edges, ["seed", "id"])
        found.append((sorted(map(tuple, reach.collect()), key=str), way, sorted(map(str, rows.collect()))))
    assert found[0] == found[1] and len(found[0][0]) > 10 and found[0][1][0] == 0 and found[0][1][-1] == 17
