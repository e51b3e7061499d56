"""Crowded places: one cell's boxes are met in blocks, by several tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spandrel.functions import geometry
from spandrel.operators import spatial
from spandrel.plans import driver_queries

N, SF = 2000, "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def crowd(spark):
    """Boxes that all lie in one or two cells, of two datasets with the same ids, and the same as arrays."""
    rng = np.random.default_rng(3)
    lo = rng.random((N, 3)) * 1.5
    hi = lo + rng.choice([0.3, 0.45, 0.6], (N, 1))
    rows = [(f"m{k % 2}", f"{k // 2:05}", lo[k].tolist(), hi[k].tolist(), ((lo[k] + hi[k]) / 2).tolist()) for k in range(N)]
    df = spark.createDataFrame(rows, "dataset string, id string, lo array<double>, hi array<double>, centre array<double>").localCheckpoint()
    return df, lo, hi


def tasks(df):
    return df.groupBy(F.spark_partition_id()).count().count()


def brute(lo, hi, axes, test):
    out = set()
    for m in range(2):
        own = np.arange(m, N, 2)
        gap = np.maximum(lo[own][:, None] - hi[own][None], lo[own][None] - hi[own][:, None])
        i, j = np.nonzero(np.triu(test(gap[:, :, :axes]), 1))
        out |= {(f"m{m}", f"{a:05}", f"{b:05}") for a, b in zip(i, j, strict=True)}
    return out


def test_plans_of_a_crowd(crowd):
    df, lo, hi = crowd
    pairs = spatial.plan_overlaps(df).localCheckpoint()
    assert tasks(pairs) > 1
    got = [tuple(r) for r in pairs.select("dataset", "a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(lo, hi, 2, lambda gap: (gap < 0).all(axis=2))


def test_neighbours_of_a_crowd(crowd):
    df, lo, hi = crowd
    pairs = spatial.adjacency(df, 0.05).localCheckpoint()
    assert tasks(pairs) > 1
    want = [p[1:] for p in brute(lo, hi, 3, lambda gap: (np.maximum(gap, 0) ** 2).sum(axis=2) <= 0.05**2)]
    assert sorted((r.a, r.b) for r in pairs.collect()) == sorted(want)


def test_meshes_of_a_crowd(crowd):
    df, lo, hi = crowd
    corners = F.array("lo", "hi")
    pairs = spatial.adjacency(df.withColumn("mesh", F.when(F.col("id") < "00700", corners)), 0.1).localCheckpoint()
    assert tasks(pairs) > 1 and {r[0] for r in pairs.select("distance_method").distinct().collect()} == {"bbox", "mesh_vertices"}
    near = lambda p, q: np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2))
    want = 0
    for m in range(2):
        a, b = lo[m::2], hi[m::2]
        vertices = np.minimum(np.minimum(near(a, a), near(a, b)), np.minimum(near(b, a), near(b, b)))
        gap = np.maximum(np.maximum(a[:, None] - b[None], a[None] - b[:, None]), 0)
        meshed = np.arange(len(a)) < 700
        want += np.triu(np.where(meshed[:, None] & meshed[None], vertices, np.sqrt((gap * gap).sum(axis=2))) <= 0.1, 1).sum()
    assert pairs.count() == want


def test_above_and_below_read_the_overlaps_once(crowd):
    both = spatial.above_below(spatial.plan_overlaps(crowd[0]))
    assert both._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    n = {r.relation: r["count"] for r in both.groupBy("relation").count().collect()}
    assert n["above"] == n["below"] > 0


def test_the_largest_of_a_crowd_are_found_in_the_tasks(crowd):
    df, lo, hi = crowd
    one = df.where("dataset = 'm0'").drop("dataset")
    every, few = spatial.plan_overlaps(one).localCheckpoint(), spatial.plan_overlaps(one, 3).localCheckpoint()
    assert few.count() * 5 < every.count()
    want = sorted(map(tuple, spatial.overlap_edges(every, "top_k", top_k=3).collect()))
    assert sorted(map(tuple, spatial.overlap_edges(few, "top_k", top_k=3).collect())) == want


def test_equal_areas_are_not_all_kept(spark):
    same = spark.range(900).select("id", F.array(*[F.lit(0.0)] * 3).alias("lo"), F.array(*[F.lit(1.0)] * 3).alias("hi"))
    few = spatial.plan_overlaps(same, 2).localCheckpoint()
    assert few.count() < 20_000
    got = {(r.a, r.b) for r in spatial.overlap_edges(few, "top_k", top_k=2).collect()}
    assert got == {(0, 1), (0, 2), (1, 2)} | {(a, b) for a in (0, 1) for b in range(2, 900)}


def test_points_in_crowded_areas(crowd):
    df, lo, hi = crowd
    areas = df.select("dataset", "id", "lo", "hi", F.when(F.col("id") < "00500", geometry.rectangle(F.col("lo"), F.col("hi"))).alias("points"))
    points = df.select("dataset", "id", F.col("centre")[0].alias("x"), F.col("centre")[1].alias("y"))
    got = spatial.inside_footprint(points, areas).localCheckpoint()
    centre, want = (lo + hi) / 2, 0
    for m in range(2):
        c, a, b = centre[m::2], lo[m::2], hi[m::2]
        want += (((c[:, None, :2] >= a[None, :, :2]) & (c[:, None, :2] <= b[None, :, :2])).all(axis=2)).sum() - len(c)
    assert tasks(got) > 1 and got.count() == want


def test_polygons_are_clipped_many_at_once():
    rng = np.random.default_rng(5)

    def polygons(m):
        turn = np.sort(rng.random((200, m)) * 2 * np.pi, axis=1)
        return np.stack([np.cos(turn), np.sin(turn)], axis=2) * rng.uniform(0.2, 1.5, (200, 1, 1)) + rng.uniform(-1, 1, (200, 1, 2))

    for m, n in ((3, 3), (4, 6), (7, 5)):
        p, q = polygons(m), polygons(n)
        q[:20] = p[:20, [0, 1, 2] + [2] * (n - 3)] if n >= 3 else q[:20]
        want = [geometry.clip_area([tuple(c) for c in a], [tuple(c) for c in b]) for a, b in zip(p, q, strict=True)]
        assert spatial.clip_areas(p, q) == pytest.approx(want, abs=1e-12)
        assert 0 < sum(w > 0 for w in want) < 200


def test_polygons_of_a_crowd_go_with_their_boxes(crowd):
    df, _, _ = crowd
    one = df.where("dataset = 'm0'").withColumn("poly", geometry.rectangle(F.col("lo"), F.col("hi")))
    pairs = spatial.polygon_overlaps(one)
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    pairs, boxes = pairs.localCheckpoint(), spatial.plan_overlaps(one).where("area > 1e-6").localCheckpoint()
    both = pairs.join(boxes.select("a", "b", F.col("area").alias("box")), ["a", "b"])
    assert tasks(pairs) > 1 and both.where("abs(area - box) < 1e-9").count() == pairs.count() == boxes.count()


def crossing(df):
    """The columns that tasks give for each pair."""
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "MapInArrow":
            return {a.name(): a.dataType().simpleString() for a in (node.output().apply(k) for k in range(node.output().size()))}
        nodes += [node.children().apply(k) for k in range(node.children().size())]


def test_above_below_takes_pairs_with_a_gap_only(spark, crowd):
    assert crossing(driver_queries.QUERIES["above_below"](spark, SF)) == {"a": "bigint", "b": "bigint", "gap": "double", "up": "boolean"}
    one = crowd[0].where("dataset = 'm0'")
    want = sorted(map(tuple, spatial.above_below(spatial.plan_overlaps(one)).collect()))
    assert want and sorted(map(tuple, spatial.levels(one).collect())) == want
    flat = one.select("id", F.transform("lo", lambda x, k: F.when(k < 2, x).otherwise(0.0)).alias("lo"), F.transform("hi", lambda x, k: F.when(k < 2, x).otherwise(1.0)).alias("hi"))
    assert spatial.levels(flat).isEmpty() and not spatial.plan_overlaps(flat).isEmpty()


def test_overlap_threshold_takes_pairs_of_the_ratio_only(spark, crowd):
    assert crossing(driver_queries.QUERIES["overlap_threshold"](spark, SF)) == {"a": "bigint", "b": "bigint", "area": "double", "ratio": "double"}
    one = crowd[0].where("dataset = 'm0'")
    few, every = spatial.plan_overlaps(one, min_ratio=0.3).localCheckpoint(), spatial.plan_overlaps(one).localCheckpoint()
    assert few.count() < every.count()
    ends = lambda rows: sorted(map(tuple, spatial.overlap_edges(rows, "threshold", 0.3).collect()))
    assert ends(few) == ends(every) and few.count() == len(ends(few))


def test_box_adjacency_sends_no_text_for_a_pair(spark):
    assert crossing(driver_queries.QUERIES["box_adjacency"](spark, SF)) == {"a": "bigint", "b": "bigint", "distance": "double", "method": "tinyint"}


def test_above_below_takes_little_room(crowd, tmp_path):
    one = crowd[0].where("dataset = 'm0'").withColumn("id", F.col("id").cast("long"))
    spatial.levels(one, 6).write.parquet(f"{tmp_path}/new")
    got, want = one.sparkSession.read.parquet(f"{tmp_path}/new"), spatial.above_below(spatial.plan_overlaps(one)).withColumn("gap", F.round("gap", 6))
    assert got.exceptAll(want.select(*got.columns)).isEmpty() and got.count() == want.count() > 50_000
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 8 * got.count()


def test_crowded_cells_have_few_blocks(crowd, monkeypatch):
    # blocks as small as if the cells were far more crowded
    df, cells, kept = crowd[0].where("dataset = 'm0'"), [], spatial.kept
    want = spatial.plan_overlaps(df, min_ratio=0.3).select("a", "b").localCheckpoint()
    monkeypatch.setattr(spatial, "kept", lambda rows: cells.append(kept(rows)) or cells[-1])
    got = spatial._box_pairs(df, 0.0, 2, spatial._shared(0.3), "area double, ratio double", per_block=8).localCheckpoint()
    n = cells[0].agg(F.max(F.greatest("ns", "nl")).alias("n"), F.max(F.greatest("bs", "bl")).alias("b")).first()
    assert n.n > 64 and n.b == 8
    assert tasks(got) > 1 and got.select("a", "b").exceptAll(want).isEmpty() and got.count() == want.count()
