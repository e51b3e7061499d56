"""Adjacency and plan topology of boxes by grid cells: equi-joins on cells, then exact tests. Shapes are (id, lo, hi, centre), arrays of three."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import quantiles
from .graph import SENT, top_per_node
from .staging import kept

LEAST_THRESHOLD = 0.5
# Tolerances and default policies.
TOUCHING, EXCLUDED = 1e-9, ("IfcMember", "IfcPlate")
MIN_RATIO, TOP_K = 0.2, 5
ALIGNED = ("IfcWall", "IfcBeam", "IfcMember", "IfcCurtainWall", "IfcRailing")


def _key(shapes: DataFrame) -> list[str]:
    """Shapes of different datasets never meet."""
    return [c for c in ("dataset",) if c in shapes.columns]


def _cells(points: DataFrame, size: float, axes: int, spread: bool) -> DataFrame:
    """Points with the cell they lie in, or with all cells around it."""
    out = points
    for k in range(axes):
        own = F.floor(F.col("centre")[k] / F.lit(size))
        out = out.withColumn(f"c{k}", F.explode(F.sequence(own - 1, own + 1)) if spread else own)
    return out


def within(shapes: DataFrame, radius: float) -> DataFrame:
    """(a, b, distance) of pairs a < b whose centres are at most radius apart. Each point is copied to the 27 cells around it on one side only."""
    names = [*_key(shapes), "c0", "c1", "c2"]
    a = _cells(shapes, radius, 3, False).select(F.col("id").alias("a"), F.col("centre").alias("pa"), *names)
    b = _cells(shapes, radius, 3, True).select(F.col("id").alias("b"), F.col("centre").alias("pb"), *names)
    return a.join(b, names).where("a < b").withColumn("distance", g.point_distance(F.col("pa"), F.col("pb"))).where(F.col("distance") <= radius).select("a", "b", "distance")


def finite(point: Column) -> Column:
    """Whether an array has three numbers, none of them missing, infinite or NaN."""
    return F.coalesce((F.size(point) == 3) & F.forall(point, lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False))), F.lit(False))


def nearest(shapes: DataFrame, start: float = LEAST_THRESHOLD) -> DataFrame:
    """(id, nearest), with dataset if there is one: distance of each point to its nearest other one of the dataset. Cells double until every point has found one within a cell's width; each round
    works on what is left only. A point alone in its dataset has none, nor has one whose place is missing or not finite: it is no one's neighbour either."""
    key = _key(shapes)
    lost = shapes.where(~finite(F.col("centre"))).select(*key, "id", F.lit(None).cast("double").alias("nearest"))
    everyone = kept(shapes.where(finite(F.col("centre"))).select(*key, "id", "centre"))
    # a point without another one would look for ever
    crowd = everyone.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    left = everyone.join(crowd, key, "left_semi") if key else everyone if everyone.limit(2).count() == 2 else everyone.limit(0)
    alone = everyone.join(left.select("id"), "id", "left_anti").select(*key, "id", F.lit(None).cast("double").alias("nearest"))
    done, size = alone.unionByName(lost), start
    names = [*key, "c0", "c1", "c2"]
    while not left.isEmpty():
        a = _cells(left, size, 3, True).select(F.col("id").alias("a"), F.col("centre").alias("pa"), *names)
        b = _cells(everyone, size, 3, False).select(F.col("id").alias("b"), F.col("centre").alias("pb"), *names)
        best = a.join(b, names).where("a <> b").groupBy(*key, F.col("a").alias("id")).agg(F.min(g.point_distance(F.col("pa"), F.col("pb"))).alias("nearest"))
        best = kept(best.where(F.col("nearest") <= size))
        done = done.unionByName(best)
        left = kept(left.join(best, "id", "left_anti"))
        size *= 2
    return done


def adjacency_threshold(shapes: DataFrame) -> DataFrame:
    """One row, or one for each dataset: 1.5 times the median distance to the nearest other point, at least 0.5; 1.0 for fewer than two points."""
    key = _key(shapes)
    # read twice: by the median, and for datasets without one
    found = kept(nearest(shapes))
    middle = quantiles.median(found, key, "nearest")
    threshold = F.when(F.col("value").isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(LEAST_THRESHOLD), 1.5 * F.col("value"))).alias("threshold")
    if key:
        return found.select(*key).distinct().join(middle, key, "left").select(*key, threshold)
    return found.sparkSession.range(1).crossJoin(F.broadcast(middle.agg(F.min("value").alias("value")))).select(threshold)


#: Vertices of a mesh that distances are taken from, evenly chosen, and how many lie in one tile.
VERTICES, TILE = 256, 16


def _tiles(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Points in order of their longest axis, where tiles of them begin, and the tiles' bounds."""
    points = points[np.argsort(points[:, np.argmax(np.ptp(points, axis=0))], kind="stable")]
    first = np.arange(0, len(points), TILE)
    return points, first, np.minimum.reduceat(points, first), np.maximum.reduceat(points, first)


def least_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Distance of the nearest two points: pairs of tiles in order of the distance of their boxes, until no box can hold nearer ones."""
    (p, f, lp, hp), (q, g_, lq, hq) = _tiles(a), _tiles(b)
    gap = np.maximum(np.maximum(lp[:, None] - hq[None], lq[None] - hp[:, None]), 0)
    bound = (gap * gap).sum(axis=2)
    best = np.inf
    for k in np.argsort(bound, axis=None, kind="stable"):
        i, j = divmod(int(k), len(g_))
        if bound[i, j] >= best:
            break
        d = p[f[i] : f[i] + TILE, None] - q[None, g_[j] : g_[j] + TILE]
        best = min(best, float((d * d).sum(axis=2).min()))
    return float(np.sqrt(best))


#: Pairs of meshes with at most so many pairs of vertices are compared whole, many at once.
WHOLE = 1024


def _points(meshes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The points of all meshes, where each mesh begins among them, and how many it has."""
    size = np.asarray(pc.fill_null(pc.list_value_length(meshes), 0)).astype(np.int64)
    return np.asarray(meshes.flatten().flatten(), float).reshape(-1, 3), np.cumsum(size) - size, size


def mesh_distances(meshes: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least distance between the vertices of meshes i and j, which all have some. Small meshes of equal sizes are compared together, larger ones tile by tile."""
    points, first, size = _points(meshes)
    out = np.empty(len(i))
    (fp, m_), (fq, n_) = (first[i], size[i]), (first[j], size[j])
    small = m_ * n_ <= WHOLE
    for key in np.unique(m_[small] << 32 | n_[small]):
        m, n = int(key >> 32), int(key & 0xFFFFFFFF)
        rows = np.flatnonzero(small & (m_ == m) & (n_ == n))
        for k in range(0, len(rows), max(1, (1 << 18) // (m * n))):
            part = rows[k : k + max(1, (1 << 18) // (m * n))]
            p, q = points[fp[part][:, None] + np.arange(m)], points[fq[part][:, None] + np.arange(n)]
            d = 0.0
            for axis in range(3):
                gap = p[:, :, None, axis] - q[:, None, :, axis]
                d = d + gap * gap
            out[part] = np.sqrt(d.min(axis=(1, 2)))
    for k in np.flatnonzero(~small):
        out[k] = least_distance(points[fp[k] : fp[k] + m_[k]], points[fq[k] : fq[k] + n_[k]])
    return out


def adjacency(shapes: DataFrame, threshold: float | None = None, excluded=EXCLUDED) -> DataFrame:
    """(a, b, distance, relation, distance_method): shapes at most threshold apart, connected_to where they touch, else adjacent_to. The threshold is taken over all shapes of a dataset, pairs over those whose
    class isn't excluded.

    Distances are those of vertices (mesh_vertices) where both have a mesh (a column of shapes, if it is there), else of boxes (bbox), else, where one is marked as not boxed, of centres (centroid). Boxes choose the
    pairs that are looked at: no vertices are nearer than the boxes around them. A box lies in all cells it spans, widened by the threshold on one side.
    """
    key = _key(shapes)
    rows = shapes.where(~F.col("class_").isin(*excluded)) if "class_" in shapes.columns else shapes
    if threshold is not None:
        limits, widest = None, threshold
    else:
        limits = kept(adjacency_threshold(shapes))
        widest = limits.agg(F.max("threshold")).first()[0] or 1.0
    if limits is None or not key:
        rows = rows.withColumn("limit", F.lit(float(widest)))
    else:  # one row a dataset
        rows = rows.join(limits.select(*key, F.col("threshold").alias("limit")), key)
    if "mesh" in rows.columns:
        whole = F.forall("mesh", lambda p: F.coalesce(F.size(p) == 3, F.lit(False)))
        rows = rows.withColumn("mesh", F.when(whole, g.thinned(F.col("mesh"), VERTICES).cast("array<array<double>>")))
    more = [c for c in ("limit", "mesh", "boxed", *(["centre"] if "boxed" in rows.columns else [])) if c in rows.columns]
    pairs = _box_pairs(rows, widest, 3, _near, "distance double, method tinyint", more)
    relation = F.when(F.col("distance") <= TOUCHING, "connected_to").otherwise("adjacent_to").alias("relation")
    method = F.when(F.col("method") == 0, METHODS[0]).when(F.col("method") == 1, METHODS[1]).otherwise(METHODS[2]).alias("distance_method")
    return pairs.select("a", "b", "distance", relation, method)


#: What distances are taken of; tasks give the place in this list, as a text for each pair costs more than the pair.
METHODS = ("bbox", "centroid", "mesh_vertices")


#: Boxes of one cell are met in blocks of about so many; a block, not a cell, is what one task holds. A cell has no more than so many blocks while these are not larger than WIDE, as each box goes to all blocks of
#: the other side: what is written for that would grow with the square of the density.
BLOCK, BLOCKS, WIDE = 1024, 8, 1 << 14
#: Pairs of boxes that are looked at at once, and rows of a batch that goes out.
AT_ONCE, BATCH = 1 << 18, 1 << 17


def _box_pairs(rows: DataFrame, margin: float, axes: int, measure, schema: str, more: list[str] | None = None, points: DataFrame | None = None, per_block: int = BLOCK) -> DataFrame:
    """(dataset, a, b, measures): pairs a < b of boxes of a dataset that are at most margin apart along each of the axes, each once: in the first cell that both lie in.

    Boxes are of size classes, powers of two; a pair meets in cells of the larger one's class, where either lies in a few cells. So a huge box among small ones
    meets all that lie in its cells, but doesn't make those meet one another. Crowded cells are cut into blocks, and pairs of blocks are spread over the tasks, where `measure` takes the figures of many pairs
    at once from the columns and `more`. With points (id, x, y) the pairs are of a point a and a box b instead; these have no ids that are compared.
    """
    key, spark = _key(rows), rows.sparkSession
    if points is not None:
        own = F.array(F.col("x").cast("double"), F.col("y").cast("double"), F.lit(0.0))
        points = points.withColumn("lo", own).where(finite(F.col("lo"))).select(*key, "id", *[F.col("lo")[k].alias(f"{s}{k}") for s in ("lo", "hi") for k in range(3)], F.lit(0).alias("own"))
    extent = F.greatest(*[F.col("hi")[k] - F.col("lo")[k] for k in range(axes)], F.lit(0.0)) + F.lit(max(margin, 1e-6))
    bounds = [F.col(s)[k].cast("double").alias(f"{s}{k}") for s in ("lo", "hi") for k in range(3)]
    rows = rows.where(finite(F.col("lo")) & finite(F.col("hi"))).select(*key, "id", *bounds, F.ceil(F.log2(extent)).cast("int").alias("own"), *(more or []))
    classes = F.lit(sorted(r.own for r in rows.select("own").distinct().collect())).cast("array<int>")  # at most some dozens
    names = [*key, "class", *[f"c{k}" for k in range(axes)]]

    def spanned(frame: DataFrame, by: float) -> DataFrame:
        size = F.pow(F.lit(2.0), F.col("class"))
        for k in range(axes):
            first, last = F.floor((F.col(f"lo{k}") - by) / size), F.floor((F.col(f"hi{k}") + by) / size)
            frame = frame.withColumn(f"f{k}", first).withColumn(f"c{k}", F.explode(F.sequence(first, last)))
        return frame

    if points is None:
        small = spanned(rows.withColumn("class", F.explode(F.filter(classes, lambda c: c >= F.col("own")))), 0.0)
    else:
        blank = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in more or []]
        small = spanned(points.select("*", *blank).withColumn("class", F.explode(classes)), 0.0)
    large = spanned(rows.withColumn("class", F.col("own")), margin)
    n = [side.groupBy(*names).agg(F.count("*").alias(name)) for side, name in ((small, "ns"), (large, "nl"))]
    blocks = lambda count: F.least(F.ceil(F.col(count) / per_block), F.greatest(F.lit(BLOCKS), F.ceil(F.col(count) / WIDE)))
    cells = kept(n[0].join(n[1], names).select(*names, "ns", "nl", blocks("ns").alias("bs"), blocks("nl").alias("bl")))
    copies, tests, many = cells.agg(F.sum(F.col("ns") * F.col("bl") + F.col("nl") * F.col("bs")), F.sum(F.col("ns").cast("double") * F.col("nl")), F.count("*")).first()
    # boxes stay where they are while cells are few
    cells = F.broadcast(cells) if many <= SENT else cells
    # so many tasks that none has much to hold or to test; not more than usual for few tests
    usual = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tasks = min(max(min(usual, 1 + int((tests or 0) // 250_000)), 1 + (copies or 0) // 200_000, 1 + int((tests or 0) // 50_000_000)), 20_000)
    block = lambda count: F.pmod(F.xxhash64("id"), count)
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    small = small.join(cells, names).withColumn("sb", block(F.col("bs"))).withColumn("lb", every("bl")).withColumn("large", F.lit(False))
    large = large.join(cells, names).withColumn("lb", block(F.col("bl"))).withColumn("sb", every("bs")).withColumn("large", F.lit(True))
    columns = [*names, "sb", "lb", "large", "id", *[f"{s}{k}" for s in ("lo", "hi") for k in range(3)], "own", *[f"f{k}" for k in range(axes)], *(more or [])]
    both = small.select(*columns).unionByName(large.select(*columns)).withColumn("part", F.pmod(F.xxhash64(*names, "sb", "lb"), F.lit(tasks * 16)))
    both = both.repartition(tasks, "part").sortWithinPartitions("part")
    kind = rows.schema["id"].dataType.simpleString()
    out = ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in key] + [f"a {kind}", f"b {kind}", *([schema] if schema else [])])
    return both.mapInArrow(_met(key, names, axes, margin, measure, points is not None), out)


class _Boxes:
    """The boxes of a few cells as columns."""

    def __init__(self, table: pa.Table):
        self.table = table
        number = lambda c: np.asarray(table[c].combine_chunks())
        self.lo, self.hi = ([number(f"{s}{k}") for k in range(3)] for s in ("lo", "hi"))
        self.own = number("own")
        ids = table["id"].combine_chunks()
        self.rank = np.asarray(ids if pa.types.is_integer(ids.type) else pc.rank(ids, tiebreaker="dense"))
        # by size class, then by id; copies of a shape have one place
        order = np.lexsort((self.rank, self.own))
        rank, own = self.rank[order], self.own[order]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(np.r_[False, (rank[1:] != rank[:-1]) | (own[1:] != own[:-1])][: len(order)])


def _met(key: list[str], names: list[str], axes: int, margin: float, measure, two: bool):
    """A function of batches sorted by part: the pairs of each part's blocks with their measures."""

    def pairs(table: pa.Table):
        x = _Boxes(table)
        code = np.zeros(len(table), np.int64)
        for c in (*names, "sb", "lb"):
            own = np.unique(np.asarray(pc.dictionary_encode(table[c].combine_chunks()).indices), return_inverse=True)[1]
            code = np.unique(code * (own.max() + 1) + own, return_inverse=True)[1].astype(np.int64)
        large = np.asarray(table["large"].combine_chunks().cast("int8"))
        order = np.lexsort((large, code))
        n = np.bincount(code * 2 + large, minlength=2 * (code.max() + 1)).reshape(-1, 2)
        first = np.cumsum(n.ravel()).reshape(-1, 2) - n
        # bounds that are compared, with room for rounding; measures test again
        reach = [x.hi[k] + (margin + 1e-9 * np.maximum(np.abs(x.hi[k]), 1.0) if margin else 0.0) for k in range(axes)]
        start = [np.asarray(table[f"f{k}"].combine_chunks()) == np.asarray(table[f"c{k}"].combine_chunks()) for k in range(axes)]

        def near(i, j):
            keep = (x.lo[0][i] <= reach[0][j]) & (x.lo[0][j] <= reach[0][i])
            for k in range(1, axes):
                keep &= (x.lo[k][i] <= reach[k][j]) & (x.lo[k][j] <= reach[k][i])
            if two:
                return keep
            for k in range(axes):
                keep &= start[k][i] | start[k][j]
            return keep & (x.place[i] < x.place[j])

        def told(i, j):
            swap = x.rank[i] > x.rank[j]
            a, b = (i, j) if two else (np.where(swap, j, i), np.where(swap, i, j))
            keep, figures = measure(x, a, b)
            a, b = a[keep], b[keep]
            swap = figures.pop("swap", None)
            return (a, b, figures) if swap is None else (np.where(swap, b, a), np.where(swap, a, b), figures)

        work = n[:, 0] * n[:, 1]
        few = np.flatnonzero((work > 0) & (work <= 4096))
        # pairs of scarce cells, many cells at once
        for k in range(0, len(few), 512):
            at = few[k : k + 512]
            cell = np.repeat(at, work[at])
            within_ = np.arange(len(cell)) - np.repeat(np.cumsum(work[at]) - work[at], work[at])
            i, j = order[first[cell, 0] + within_ // n[cell, 1]], order[first[cell, 1] + within_ % n[cell, 1]]
            keep = near(i, j)
            yield told(i[keep], j[keep])
        for cell in np.flatnonzero(work > 4096):
            i, j = order[first[cell, 0] : first[cell, 0] + n[cell, 0]], order[first[cell, 1] : first[cell, 1] + n[cell, 1]]
            rows_ = max(1, AT_ONCE // len(j))
            for k in range(0, len(i), rows_):
                at, to = np.nonzero(near(i[k : k + rows_, None], j[None, :]))
                yield told(i[k : k + rows_][at], j[to])

    def batches(table: pa.Table):
        own = [table[c].combine_chunks() for c in (*key, "id")]
        held, size = [], 0

        def made():
            a, b = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            values = [*[c.take(pa.array(a)) for c in own[:-1]], own[-1].take(pa.array(a)), own[-1].take(pa.array(b))]
            figures = {name: np.concatenate([h[2][name] for h in held]) for name in held[0][2]}
            # a missing number of these is -1
            values += [own[-1].take(pa.array(v, mask=v < 0)) if name == "upper" else pa.array(v) for name, v in figures.items()]
            return pa.RecordBatch.from_arrays(values, names=[*key, "a", "b", *figures])

        for piece in pairs(table):
            if len(piece[0]):
                held.append(piece)
                size += len(piece[0])
            if size >= BATCH:
                yield made()
                held, size = [], 0
        if held:
            yield made()

    def run(source):
        rest = None
        for batch in source:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            part = np.asarray(t["part"].combine_chunks())
            ends = np.flatnonzero(part[1:] != part[:-1]) + 1
            begin = 0
            for end in ends:
                yield from batches(t.slice(begin, end - begin))
                begin = int(end)
            rest = t.slice(begin)
        if rest is not None and len(rest):
            yield from batches(rest)

    return run


def _box_gap(x: _Boxes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of boxes, 0 where they overlap."""
    total = 0.0
    for k in range(3):
        gap = np.maximum(np.maximum(x.lo[k][a] - x.hi[k][b], x.lo[k][b] - x.hi[k][a]), 0.0)
        total = total + gap * gap
    return np.sqrt(total)


def _near(x: _Boxes, a: np.ndarray, b: np.ndarray):
    """distance and method (a place in METHODS) of pairs no farther apart than the limit: of vertices, of centres where there is no box, else of boxes."""
    if not hasattr(x, "limit"):
        whole = {c: x.table[c].combine_chunks() for c in ("limit", "mesh", "boxed", "centre") if c in x.table.column_names}
        x.limit = np.asarray(whole["limit"])
        x.bare = ~np.asarray(whole["boxed"].fill_null(True)) if "boxed" in whole else None
        x.centre = None if x.bare is None else np.asarray([[math.nan] * 3 if c is None else (*c, *[math.nan] * 3)[:3] for c in whole["centre"].to_pylist()], float).reshape(-1, 3)
        x.mesh = whole.get("mesh")
        x.has = None if x.mesh is None else np.asarray(pc.fill_null(pc.list_value_length(x.mesh), 0)) > 0
    distance = _box_gap(x, a, b)
    keep = np.flatnonzero(distance <= x.limit[a])
    a, b, distance = a[keep], b[keep], distance[keep]
    method = np.zeros(len(a), np.int8)
    if x.bare is not None:
        bare = np.flatnonzero(x.bare[a] | x.bare[b])
        d = x.centre[a[bare]] - x.centre[b[bare]]
        distance[bare], method[bare] = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]), 1
    if x.has is not None:
        both = np.flatnonzero(x.has[a] & x.has[b])
        distance[both], method[both] = mesh_distances(x.mesh, a[both], b[both]), 2
    last = distance <= x.limit[a]
    return keep[last], {"distance": distance[last], "method": method[last]}


def _plan(x: _Boxes, a: np.ndarray, b: np.ndarray):
    """The pairs whose plans overlap, and by how much."""
    side = [np.minimum(x.hi[k][a], x.hi[k][b]) - np.maximum(x.lo[k][a], x.lo[k][b]) for k in range(2)]
    area = np.maximum(side[0], 0.0) * np.maximum(side[1], 0.0)
    keep = np.flatnonzero(area > 0)
    return keep, area[keep]


def _overlap(x: _Boxes, a: np.ndarray, b: np.ndarray):
    keep, area = _plan(x, a, b)
    a, b = a[keep], b[keep]
    plan = lambda i: (x.hi[0][i] - x.lo[0][i]) * (x.hi[1][i] - x.lo[1][i])
    over, under = x.lo[2][a] - x.hi[2][b], x.lo[2][b] - x.hi[2][a]
    upper = np.where(over > 0, a, np.where(under > 0, b, -1))
    figures = {"area": area, "ratio": area / np.minimum(plan(a), plan(b)), "touching": (over <= 0) & (under <= 0), "gap": np.maximum(np.maximum(over, under), 0.0), "upper": upper}
    return keep, figures


def _shared(least: float):
    """area and ratio of the pairs whose plans overlap by at least a share of the smaller one."""

    def run(x: _Boxes, a: np.ndarray, b: np.ndarray):
        if not hasattr(x, "plan"):
            x.plan = (x.hi[0] - x.lo[0]) * (x.hi[1] - x.lo[1])
        keep, area = _plan(x, a, b)
        ratio = area / np.minimum(x.plan[a[keep]], x.plan[b[keep]])
        good = ratio >= least
        return keep[good], {"area": area[good], "ratio": ratio[good]}

    return run


#: So many pairs one way, then the same the other way: near enough for compression to find the gaps again.
RUN = 16


def _levels(digits: int | None):
    """gap of the pairs whose plans overlap with a vertical gap, each pair twice: the upper one first (up), and the lower one first. Pairs of one upper box follow one another, then the same pairs the other way, so
    that ends and gaps take little room in files by columns."""

    def run(x: _Boxes, a: np.ndarray, b: np.ndarray):
        over, under = x.lo[2][a] - x.hi[2][b], x.lo[2][b] - x.hi[2][a]
        apart = np.flatnonzero((over > 0) | (under > 0))
        inner, _ = _plan(x, a[apart], b[apart])
        keep = apart[inner]
        keep = keep[np.argsort(x.rank[np.where(over[keep] > 0, a[keep], b[keep])], kind="stable")]
        gap, first = np.maximum(over[keep], under[keep]), over[keep] > 0
        if digits is not None:
            # half away from zero, as SQL has it
            scaled = gap * 10.0**digits
            whole = np.floor(scaled)
            gap = (whole + (scaled - whole >= 0.5)) / 10.0**digits
        place = np.arange(len(keep))
        above = place + place // RUN * RUN
        below = above + np.minimum(RUN, len(keep) - place // RUN * RUN)
        row, up = np.empty(2 * len(keep), np.int64), np.ones(2 * len(keep), bool)
        row[above], row[below], up[below] = place, place, False
        return keep[row], {"gap": gap[row], "up": up, "swap": first[row] != up}

    return run


def _largest(k: int):
    """As _overlap, without pairs that are not among the k largest of either end as far as the task has seen. A pair among an end's k largest of all is among those of any part of them, so none of these goes."""

    def best(x: _Boxes, own: np.ndarray, other: np.ndarray, area: np.ndarray) -> np.ndarray:
        rows = np.flatnonzero((area > x.least[own]) | ((area == x.least[own]) & (x.rank[other] <= x.last[own])))
        rows = rows[np.lexsort((x.rank[other[rows]], -area[rows], own[rows]))]
        new = np.flatnonzero(np.r_[True, own[rows][1:] != own[rows][:-1]])[: len(rows)]
        place = np.arange(len(rows)) - np.repeat(new, np.diff(np.r_[new, len(rows)]))
        rows, place = rows[place < k], place[place < k]
        at, back = np.unique(own[rows], return_inverse=True)
        found, ranks = np.full((len(at), 2 * k), -1.0), np.full((len(at), 2 * k), x.most)
        found[:, :k], ranks[:, :k] = x.area[at], x.other[at]
        found[back, k + place], ranks[back, k + place] = area[rows], x.rank[other[rows]]
        order = np.lexsort((ranks, -found))[:, :k]
        x.area[at], x.other[at] = np.take_along_axis(found, order, 1), np.take_along_axis(ranks, order, 1)
        x.least[at], x.last[at] = x.area[at, -1], x.other[at, -1]
        return rows

    def run(x: _Boxes, a: np.ndarray, b: np.ndarray):
        if not hasattr(x, "least"):
            n, x.most = len(x.rank), np.iinfo(np.int64).max
            x.rank = x.rank.astype(np.int64)
            x.area, x.other = np.full((n, k), -1.0), np.full((n, k), x.most)
            x.least, x.last = np.full(n, -1.0), np.full(n, x.most)
            # copies of a shape in several cells are one end
            codes = [np.asarray(pc.dictionary_encode(x.table[c].combine_chunks()).indices).astype(np.int64) for c in ("dataset", "id") if c in x.table.column_names]
            x.end = np.unique(codes[0] if len(codes) == 1 else codes[0] * n + codes[1], return_inverse=True)[1]
        keep, area = _plan(x, a, b)
        i, j = a[keep], b[keep]
        if not len(keep):
            return keep, _overlap(x, i, j)[1]
        either = np.union1d(best(x, x.end[i], j, area), best(x, x.end[j], i, area))
        return keep[either], _overlap(x, i[either], j[either])[1]

    return run


def _inside(x: _Boxes, a: np.ndarray, b: np.ndarray):
    """The pairs of a point in a polygon of at least three corners, its edges counted in, or else in a box."""
    ids = x.rank
    px, py = x.lo[0][a], x.lo[1][a]
    keep = (ids[a] != ids[b]) & (px >= x.lo[0][b] - g.EPSILON) & (px <= x.hi[0][b] + g.EPSILON) & (py >= x.lo[1][b] - g.EPSILON) & (py <= x.hi[1][b] + g.EPSILON)
    keep = np.flatnonzero(keep)
    if not hasattr(x, "corners"):
        x.corners = _corners(x.table["points"].combine_chunks())
    corners, first, size = x.corners
    good = np.ones(len(keep), bool)
    of = b[keep]
    for n in np.unique(size[of]):
        if n < 3:
            continue
        rows = np.flatnonzero(size[of] == n)
        u, v, at = px[keep[rows]], py[keep[rows]], first[of[rows]]
        odd, edge = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
        for k in range(n):
            (x1, y1), (x2, y2) = corners[at + k].T, corners[at + (k + 1) % n].T
            cross = (u - x1) * (y2 - y1) - (v - y1) * (x2 - x1)
            edge |= (np.abs(cross) <= g.EPSILON) & (u >= np.minimum(x1, x2) - g.EPSILON) & (u <= np.maximum(x1, x2) + g.EPSILON) & (v >= np.minimum(y1, y2) - g.EPSILON) & (v <= np.maximum(y1, y2) + g.EPSILON)
            odd ^= ((y1 > v) != (y2 > v)) & (u < (x2 - x1) * (v - y1) / np.where(y1 == y2, 1.0, y2 - y1) + x1)
        good[rows] = odd | edge
    return keep[good], {}


def _corners(polygons: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The corners of all polygons, where each begins among them, and how many it has."""
    size = np.asarray(pc.fill_null(pc.list_value_length(polygons), 0)).astype(np.int64)
    flat = polygons.flatten()
    return np.stack([np.asarray(flat.field(c), float) for c in ("x", "y")], axis=1), np.cumsum(size) - size, size


def clip_areas(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """geometry.clip_area of many pairs of convex counter-clockwise polygons of equal numbers of corners, arrays (pair, corner, 2)."""
    x, y, count = p[:, :, 0], p[:, :, 1], np.full(len(p), p.shape[1])
    for k in range(q.shape[1]):
        (ax, ay), (bx, by) = q[:, k].T[:, :, None], q[:, (k + 1) % q.shape[1]].T[:, :, None]
        place = np.arange(x.shape[1])[None]
        live = place < count[:, None]
        after = np.where(place + 1 < count[:, None], place + 1, 0)
        side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        far, fx, fy = (np.take_along_axis(c, after, 1) for c in (side, x, y))
        cross = live & (((side > g.EPSILON) & (far < -g.EPSILON)) | ((side < -g.EPSILON) & (far > g.EPSILON)))
        f = side / np.where(cross, side - far, 1.0)
        put = np.stack([live & (side >= -g.EPSILON), cross], axis=2).reshape(len(p), -1)
        xs, ys = (np.stack([own, own + f * (to - own)], axis=2).reshape(len(p), -1) for own, to in ((x, fx), (y, fy)))
        to = np.cumsum(put, axis=1) - 1
        count = np.where(put.sum(axis=1) < 3, 0, put.sum(axis=1))
        row, column = np.nonzero(put)
        x, y = np.zeros((2, len(p), max(int(to.max(initial=0)) + 1, 1)))
        x[row, to[row, column]], y[row, to[row, column]] = xs[row, column], ys[row, column]
    place = np.arange(x.shape[1])[None]
    after = np.where(place + 1 < count[:, None], place + 1, 0)
    terms = x * np.take_along_axis(y, after, 1) - np.take_along_axis(x, after, 1) * y
    return np.abs(np.where(place < count[:, None], terms, 0.0).sum(axis=1)) / 2


def _plain(x: _Boxes) -> np.ndarray:
    """Which polygons are their boxes' plans: four corners of the box, each next to those that it shares a side with."""
    corners, first, size = x.corners
    four = np.flatnonzero(size == 4)
    points, out = corners[first[four][:, None] + np.arange(4)], np.zeros(len(size), bool)
    low, high = (np.stack([side[0][four], side[1][four]], axis=1)[:, None] for side in (x.lo, x.hi))
    at = points == high
    next_ = np.roll(at, -1, axis=1)
    out[four] = (at | (points == low)).all(axis=(1, 2)) & ((at != next_).sum(axis=2) == 1).all(axis=1) & (at != np.roll(at, -2, axis=1)).all(axis=(1, 2)) & (low < high).all(axis=(1, 2))
    return out


def _common(least: float):
    """The common area of the polygons of pairs whose boxes' plans overlap by more than the least area. Polygons that are their boxes' plans have that of the boxes, others are clipped."""

    def run(x: _Boxes, a: np.ndarray, b: np.ndarray):
        if not hasattr(x, "corners"):
            x.corners = _corners(x.table["poly"].combine_chunks())
            x.plain = _plain(x)
        corners, first, size = x.corners
        keep, area = _plan(x, a, b)
        keep, out = keep[area > least], area[area > least]
        a, b = a[keep], b[keep]
        clipped = np.flatnonzero(~(x.plain[a] & x.plain[b]))
        for m, n in np.unique(np.stack([size[a[clipped]], size[b[clipped]]]), axis=1).T:
            rows = clipped[(size[a[clipped]] == m) & (size[b[clipped]] == n)]
            for k in range(0, len(rows), 1 << 14):
                part = rows[k : k + (1 << 14)]
                out[part] = clip_areas(corners[first[a[part]][:, None] + np.arange(m)], corners[first[b[part]][:, None] + np.arange(n)])
        return keep, {"area": out}

    return run


def _touch(x: _Boxes, a: np.ndarray, b: np.ndarray):
    keep = np.ones(len(a), bool)
    for k in range(3):
        keep &= (x.lo[k][a] <= x.hi[k][b]) & (x.lo[k][b] <= x.hi[k][a])
    return np.flatnonzero(keep), {"touching": keep[keep]}


def plan_overlaps(shapes: DataFrame, top_k: int | None = None, min_ratio: float | None = None) -> DataFrame:
    """(a, b, area, ratio, touching, gap, upper): pairs whose plans overlap; ratio to the smaller plan, touching if the closed boxes meet, gap between them, upper the one above. With top_k, pairs that can't
    be among the top_k largest of either end are left out where they are found. With min_ratio, pairs are (a, b, area, ratio) of at least that ratio, others are left out likewise."""
    if min_ratio is not None:
        return _box_pairs(shapes, 0.0, 2, _shared(min_ratio), "area double, ratio double")
    kind = shapes.schema["id"].dataType.simpleString()
    schema = f"area double, ratio double, touching boolean, gap double, upper {kind}"
    return _box_pairs(shapes, 0.0, 2, _overlap, schema) if top_k is None else _box_pairs(shapes, 0.0, 2, _largest(top_k), schema, per_block=8 * BLOCK)


def polygon_overlaps(shapes: DataFrame, least: float = 1e-6) -> DataFrame:
    """(a, b, area): pairs whose boxes' plans overlap by more than the least area, with the common area of their polygons: poly, convex and counter-clockwise arrays of (x, y)."""
    return _box_pairs(shapes, 0.0, 2, _common(least), "area double", ["poly"]).select("a", "b", "area")


def intersections(shapes: DataFrame) -> DataFrame:
    """(a, b): closed boxes that meet in all axes, plans that only touch included."""
    return _box_pairs(shapes, 0.0, 3, _touch, "touching boolean").select("a", "b")


def above_below(overlaps: DataFrame) -> DataFrame:
    """(src, dst, relation, gap): above and below for plan overlaps with a vertical gap; both are made of one reading of the overlaps."""
    lower = F.when(F.col("upper") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    way = lambda src, dst, relation: F.struct(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"))
    rows = overlaps.where("upper IS NOT NULL").withColumn("w", F.explode(F.array(way(F.col("upper"), lower, "above"), way(lower, F.col("upper"), "below"))))
    return rows.select("w.src", "w.dst", "gap", "w.relation")


def levels(shapes: DataFrame, digits: int | None = None) -> DataFrame:
    """above_below of the plan overlaps of shapes, where these serve nothing else: pairs without a gap are dropped where they are found. Gaps are rounded, if so, once for both relations."""
    ends = _box_pairs(shapes, 0.0, 2, _levels(digits), "gap double, up boolean")
    return ends.select(F.col("a").alias("src"), F.col("b").alias("dst"), "gap", F.when(F.col("up"), "above").otherwise("below").alias("relation"))


def overlap_edges(overlaps: DataFrame, mode: str = "none", min_ratio: float = MIN_RATIO, top_k: int = TOP_K) -> DataFrame:
    """(a, b, area) that a policy keeps: none, full, threshold (of the ratio) or top_k (among the largest of either end)."""
    if mode == "full":
        return overlaps.select("a", "b", "area")
    if mode == "threshold":
        return overlaps.where(F.col("ratio") >= min_ratio).select("a", "b", "area")
    if mode == "top_k":
        return top_per_node(overlaps.select("a", "b", "area"), "area", top_k)
    if mode != "none":
        raise ValueError("mode must be none, full, threshold or top_k")
    return overlaps.select("a", "b", "area").where(F.lit(False))


def overlap_statistics(overlaps: DataFrame, min_ratio: float = MIN_RATIO, mode: str = "threshold", top_k: int = TOP_K) -> DataFrame:
    """One row: candidates, emitted and rejected of a policy."""
    if mode == "threshold":
        good = F.count_if(F.col("ratio") >= min_ratio)
        return overlaps.agg(F.count("*").alias("candidates"), good.alias("emitted"), (F.count("*") - good).alias("rejected"))
    emitted = overlap_edges(overlaps, mode, min_ratio, top_k).agg(F.count("*").alias("emitted"))
    return overlaps.agg(F.count("*").alias("candidates")).crossJoin(F.broadcast(emitted)).withColumn("rejected", F.col("candidates") - F.col("emitted"))


def top_aligned(pairs: DataFrame, k: int = 8) -> DataFrame:
    """(own, other, angle, offset, rank): each shape's k best aligned others, by angle, offset and id."""
    ends = pairs.select(F.col("a").alias("own"), F.col("b").alias("other"), "angle", "offset").unionByName(pairs.select(F.col("b").alias("own"), F.col("a").alias("other"), "angle", "offset"))
    w = Window.partitionBy("own").orderBy("angle", "offset", "other")
    return ends.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def inside_footprint(points: DataFrame, areas: DataFrame) -> DataFrame:
    """(area, id): points (id, x, y) in areas (id, lo, hi, points) of the same dataset, if both have one: in the polygon of at least three corners, else in the box."""
    key = [c for c in _key(points) if c in areas.columns]
    areas = areas.select(*key, "id", "lo", "hi", "points")
    return _box_pairs(areas, 2 * g.EPSILON, 2, _inside, "", ["points"], points.select(*key, "id", "x", "y")).select(F.col("b").alias("area"), F.col("a").alias("id"))


def aligned(axes: DataFrame, degrees: float = 10.0, least_offset: float = 0.25) -> DataFrame:
    """(a, b, angle, offset): pairs (id, x, y, dx, dy, short) of a dataset with almost parallel unit axes, whose centre of one lies beside the other's axis by max(0.25, the smaller short extent)
    at most, however far apart along it.

    Directions are cut into bins so narrow that across the whole plan a line of a bin leaves its middle direction by no more than the widest offset allowed. A shape lies in all bins that hold the bisector of
    its axis and another one, and there in a strip along the direction; a pair is tested in its bisector's bin and in strips side by side.
    """
    key = _key(axes)
    x, y, wide = (F.max(c) - F.min(c) if c in ("x", "y") else F.max(c) for c in ("x", "y", "short"))
    spread = axes.agg(F.sqrt(x * x + y * y), F.greatest(F.lit(least_offset), F.coalesce(wide, F.lit(0.0)))).first()
    across, limit = float(spread[0] or 0.0), float(spread[1])
    bins = max(18, min(100_000, math.ceil(math.pi * max(across, limit) / limit)))
    step = 180.0 / bins
    strip = limit + across * math.sin(math.radians(step) / 2) + 1e-9
    own = F.pmod(F.degrees(F.atan2("dy", "dx")), F.lit(180.0))
    near = degrees / 2 / step
    rows = axes.withColumn("turn", own).withColumn("k", F.explode(F.sequence(F.floor(own / step - near).cast("int") - 1, F.floor(own / step + near).cast("int") + 1)))
    rows = rows.withColumn("k", F.pmod("k", F.lit(bins))).distinct()
    middle = F.radians((F.col("k") + 0.5) * step)
    rows = rows.withColumn("s", F.floor((F.col("y") * F.cos(middle) - F.col("x") * F.sin(middle)) / strip))
    names = (("x", "x"), ("y", "y"), ("dx", "u"), ("dy", "v"), ("short", "s"), ("turn", "t"))
    left = rows.select(*key, "k", F.col("s").alias("strip"), F.col("id").alias("a"), *[F.col(n).alias(m + "a") for n, m in names])
    right = rows.withColumn("strip", F.explode(F.sequence(F.col("s") - 1, F.col("s") + 1))).select(*key, "k", "strip", F.col("id").alias("b"), *[F.col(n).alias(m + "b") for n, m in names])
    pairs = left.join(right, [*key, "k", "strip"]).where("a < b")
    # the bisector of two directions up to a half turn apart
    turn = F.pmod(F.col("tb") - F.col("ta") + 90.0, F.lit(180.0)) - 90.0
    bisector = F.pmod(F.floor(F.pmod(F.col("ta") + turn / 2, F.lit(180.0)) / step), F.lit(bins))
    return _in_line(pairs.where(bisector == F.col("k")), degrees, least_offset)


def _in_line(pairs: DataFrame, degrees: float, least_offset: float) -> DataFrame:
    dot = F.col("ua") * F.col("ub") + F.col("va") * F.col("vb")
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    u, v = F.col("ua") + sign * F.col("ub"), F.col("va") + sign * F.col("vb")
    offset = F.abs((F.col("xb") - F.col("xa")) * v - (F.col("yb") - F.col("ya")) * u) / F.sqrt(u * u + v * v)
    pairs = pairs.withColumns({"angle": F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dot)))), "offset": offset})
    return pairs.where((F.col("angle") <= degrees) & (F.col("offset") <= F.greatest(F.lit(least_offset), F.least("sa", "sb")))).select("a", "b", "angle", "offset")


def aligned_to(axes: DataFrame, anchor: str, degrees: float = 10.0, least_offset: float = 0.25) -> DataFrame:
    """(a, b, angle, offset) of all shapes in line with one, however far along its axis; the one row is what is sent around."""
    names = ("x", "y", "dx", "dy", "short")
    own = axes.where(F.col("id") == anchor).limit(1).select(F.col("id").alias("a"), *[F.col(n).alias(m) for n, m in zip(names, ("xa", "ya", "ua", "va", "sa"), strict=True)])
    others = axes.where(F.col("id") != anchor).select(F.col("id").alias("b"), *[F.col(n).alias(m) for n, m in zip(names, ("xb", "yb", "ub", "vb", "sb"), strict=True)])
    return _in_line(others.crossJoin(F.broadcast(own)), degrees, least_offset)


def main_axes(shapes: DataFrame) -> DataFrame:
    """(id, x, y, dx, dy, short) of boxes of the classes that lie in line: along the longer plan side."""
    wide, deep = F.col("hi")[0] - F.col("lo")[0], F.col("hi")[1] - F.col("lo")[1]
    along = wide >= deep
    rows = shapes.where(F.col("class_").isin(*ALIGNED))
    return rows.select(*_key(shapes), "id", F.col("centre")[0].alias("x"), F.col("centre")[1].alias("y"), F.when(along, 1.0).otherwise(0.0).alias("dx"), F.when(along, 0.0).otherwise(1.0).alias("dy"), F.least(wide, deep).alias("short"))


def centroid_fill(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, centre): a node without a place takes the mean of its successors' stated places, else the origin."""
    of = edges.join(nodes.select(F.col("id").alias("dst"), "centre"), "dst").where("centre IS NOT NULL")
    mean = of.groupBy(F.col("src").alias("id")).agg(F.array(*[F.avg(F.col("centre")[k]) for k in range(3)]).alias("mean"))
    origin: Column = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return nodes.join(mean, "id", "left").select("id", F.coalesce("centre", "mean", origin).alias("centre"))
