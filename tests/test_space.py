"""Geometry, adjacency and plan topology."""

import math

import pytest
from pyspark.sql import functions as F

from spandrel.functions import geometry as geo
from spandrel.operators import spatial


def boxes(spark, **b):
    rows = [(k, list(v[0]), list(v[1]), [(x + y) / 2 for x, y in zip(*v, strict=True)]) for k, v in b.items()]
    return spark.createDataFrame([(k, [float(x) for x in lo], [float(x) for x in hi], c) for k, lo, hi, c in rows], "id string, lo array<double>, hi array<double>, centre array<double>")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_overlap_policies(spark):
    s = boxes(spark, a=((0, 0, 0), (10, 10, 1)), b=((1, 0, 0), (11, 10, 1)), c=((6, 0, 0), (16, 10, 1)))
    o = spatial.plan_overlaps(s)
    assert rows(spatial.overlap_edges(o, "top_k", top_k=1).select("a", "b")) == [("a", "b"), ("b", "c")]
    assert spatial.overlap_edges(o, "full").count() == 3
    assert spatial.overlap_edges(o).count() == 0
    with pytest.raises(ValueError):
        spatial.overlap_edges(o, "some")


def test_threshold_drops_slivers_but_keeps_above(spark):
    s = boxes(spark, roof=((0, 0, 2), (10, 10, 3)), floor=((9, 0, 0), (19, 10, 1)))
    o = spatial.plan_overlaps(s)
    assert tuple(spatial.overlap_statistics(o).first()) == (1, 0, 1)
    assert rows(spatial.above_below(o).select("src", "dst", "relation", "gap")) == [("floor", "roof", "below", 1.0), ("roof", "floor", "above", 1.0)]


def test_adjacency_by_boxes(spark):
    s = boxes(spark, a=((0, 0, 0), (1, 1, 1)), b=((1, 0, 0), (2, 1, 1)), c=((2.4, 0, 0), (3, 1, 1)), d=((50, 0, 0), (51, 1, 1)))
    got = rows(spatial.adjacency(s, 0.5).select("a", "b", "relation"))
    assert got == [("a", "b", "connected_to"), ("b", "c", "adjacent_to")]


def test_threshold_of_few_points(spark):
    assert spatial.adjacency_threshold(boxes(spark, a=((0, 0, 0), (1, 1, 1)))).first()[0] == 1.0
    far = boxes(spark, a=((0, 0, 0), (0, 0, 0)), b=((100, 0, 0), (100, 0, 0)), c=((101, 0, 0), (101, 0, 0)))
    assert spatial.adjacency_threshold(far).first()[0] == 1.5


def test_pairs_equal_brute_force(spark):
    import random

    rnd = random.Random(3)
    b = {}
    for k in range(60):
        lo = [rnd.uniform(0, 12) for _ in range(3)]
        b[f"b{k:02d}"] = (lo, [x + rnd.uniform(0.1, 2.5) for x in lo])
    s = boxes(spark, **b)
    gap = lambda p, q: math.sqrt(sum(max(p[0][k] - q[1][k], q[0][k] - p[1][k], 0) ** 2 for k in range(3)))
    want = sorted((x, y) for x in b for y in b if x < y and gap(b[x], b[y]) <= 0.7)
    assert rows(spatial.adjacency(s, 0.7).select("a", "b")) == want
    plan = sorted((x, y) for x in b for y in b if x < y and all(b[x][0][k] < b[y][1][k] and b[y][0][k] < b[x][1][k] for k in (0, 1)))
    assert rows(spatial.plan_overlaps(s).select("a", "b")) == plan


def test_polygons(spark):
    square = [{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}, {"x": 10.0, "y": 10.0}, {"x": 0.0, "y": 10.0}]
    d = spark.createDataFrame([(5.0, 5.0, square), (10.0, 4.0, square), (10.5, 4.0, square)], "x double, y double, p array<struct<x:double,y:double>>")
    assert [r[0] for r in d.select(geo.in_polygon(F.col("x"), F.col("y"), F.col("p"))).collect()] == [True, True, False]
    assert d.select(geo.polygon_area(F.col("p"))).first()[0] == 100.0
    assert geo.clip_area([(0, 0), (2, 0), (2, 2), (0, 2)], [(1, -1), (3, 1), (1, 3), (-1, 1)]) == pytest.approx(4.0)
    assert geo.clip_area([(0, 0), (1, 0), (1, 1)], [(5, 5), (6, 5), (6, 6)]) == 0.0
    assert geo.hull([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5)]) == [(0, 0), (1, 0), (1, 1), (0, 1)]


def test_footprints(spark):
    area = boxes(spark, room=((0, 0, 0), (10, 10, 3))).select("id", "lo", "hi", geo.rectangle(F.col("lo"), F.col("hi")).alias("points"))
    points = spark.createDataFrame([("chair", 5.0, 5.0), ("table", 1.5, 1.5), ("cabinet", 10.5, 10.5)], "id string, x double, y double")
    assert rows(spatial.inside_footprint(points, area)) == [("room", "chair"), ("room", "table")]


def test_alignment(spark):
    turned = math.radians(30)
    axes = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 0.0, 0.2), ("b", 5.0, 0.15, -1.0, 0.0, 0.2), ("c", 5.0, 0.0, math.cos(turned), math.sin(turned), 0.2), ("d", 4.0, 0.6, 1.0, 0.0, 0.2)], "id string, x double, y double, dx double, dy double, short double")
    assert rows(spatial.aligned(axes).select("a", "b")) == [("a", "b")]


def test_missing_places_are_filled(spark):
    n = spark.createDataFrame([("a", None), ("b", [1.0, 2.0, 3.0]), ("c", [3.0, 2.0, 1.0]), ("z", None)], "id string, centre array<double>")
    e = spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string")
    assert dict(rows(spatial.centroid_fill(n, e)))["a"] == [2.0, 2.0, 2.0]


def test_nearest_ends_where_places_are_missing(spark):
    nan = float("nan")
    rows = [("a", [0.0, 0.0, 0.0]), ("b", [0.0, 0.0, 9.0]), ("c", [nan, 0.0, 0.0]), ("d", None), ("e", [0.0, float("inf"), 1.0]), ("f", [None, 1.0, 1.0]), ("g", [1.0])]
    df = spark.createDataFrame(rows, "id string, centre array<double>")
    assert {r.id: r.nearest for r in spatial.nearest(df).collect()} == {"a": 9.0, "b": 9.0} | dict.fromkeys("cdefg")
    assert spatial.adjacency_threshold(df).first()[0] == 13.5
    assert spatial.adjacency_threshold(df.where("id > 'b'")).first()[0] == 1.0
    boxes_ = spark.createDataFrame([("a", [0.0] * 3, [1.0] * 3), ("b", [1.0] * 3, [2.0] * 3), ("c", [nan] * 3, [1.0] * 3)], "id string, lo array<double>, hi array<double>")
    assert rows_of(spatial.adjacency(boxes_, 0.5)) == [("a", "b", 0.0, "connected_to", "bbox")]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_distances_of_vertices_boxes_and_centres(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    clouds = {f"m{k}": rng.normal(size=(n, 3)) + [3 * k, 0, 0] for k, n in enumerate((1, 16, 17, 700))}
    rows = [(k, c.min(axis=0).tolist(), c.max(axis=0).tolist(), c.mean(axis=0).tolist(), c.tolist(), True) for k, c in clouds.items()]
    rows += [("box", [1.0, 1.0, 1.0], [2.0, 2.0, 2.0], [1.5, 1.5, 1.5], None, True), ("empty", [1.5, 1.5, 1.5], [2.5, 2.5, 2.5], [2.0, 2.0, 2.0], [], True), ("bare", [0.0, 1.0, 1.0], [0.0, 1.0, 1.0], [0.0, 1.0, 1.0], None, False)]
    df = spark.createDataFrame(rows, "id string, lo array<double>, hi array<double>, centre array<double>, mesh array<array<double>>, boxed boolean")
    got = {(r.a, r.b): (r.distance, r.distance_method) for r in spatial.adjacency(df, 6.0).collect()}
    want = {}
    for i, a in enumerate(sorted(rows)):
        for b in sorted(rows)[i + 1 :]:
            if a[0] in clouds and b[0] in clouds:
                p, q = (c if len(c) <= 256 else c[np.linspace(0, len(c) - 1, 256, dtype=int)] for c in (clouds[a[0]], clouds[b[0]]))
                d = (np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2)).min(), "mesh_vertices")
            elif a[5] and b[5]:
                d = (np.sqrt(sum(max(a[1][k] - b[2][k], b[1][k] - a[2][k], 0) ** 2 for k in range(3))), "bbox")
            else:
                d = (np.sqrt(sum((x - y) ** 2 for x, y in zip(a[3], b[3]))), "centroid")
            if d[0] <= 6:
                want[a[0], b[0]] = d
    assert set(got) == set(want) and {m for _, m in want.values()} == {"mesh_vertices", "bbox", "centroid"}
    assert all(np.isclose(got[k][0], want[k][0]) and got[k][1] == want[k][1] for k in want)
