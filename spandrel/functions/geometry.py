"""Geometry as Column expressions over boxes (arrays of three minima and three maxima) and points (arrays of three)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def axis_gap(lo1: Column, hi1: Column, lo2: Column, hi2: Column, k: int) -> Column:
    return F.greatest(lo1[k] - hi2[k], lo2[k] - hi1[k], F.lit(0.0))


def box_distance(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Distance of two boxes, 0 where they overlap."""
    total = F.lit(0.0)
    for k in range(3):
        gap = axis_gap(lo1, hi1, lo2, hi2, k)
        total = total + gap * gap
    return F.sqrt(total)


def point_distance(a: Column, b: Column) -> Column:
    total = F.lit(0.0)
    for k in range(3):
        total = total + (a[k] - b[k]) * (a[k] - b[k])
    return F.sqrt(total)


def xy_overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Area of the plan overlap of two boxes."""
    side = lambda k: F.greatest(F.least(hi1[k], hi2[k]) - F.greatest(lo1[k], lo2[k]), F.lit(0.0))
    return side(0) * side(1)


def boxes_touch(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Whether two closed boxes share a point."""
    out = F.lit(True)
    for k in range(3):
        out = out & (lo1[k] <= hi2[k]) & (lo2[k] <= hi1[k])
    return out


def box_volume(lo: Column, hi: Column) -> Column:
    return (hi[0] - lo[0]) * (hi[1] - lo[1]) * (hi[2] - lo[2])


def polygon_area(points: Column) -> Column:
    """Area of a simple polygon, an array of (x, y) structs, by the sum of its edges' cross products."""
    n = F.size(points)
    edge = lambda i: points[i]["x"] * points[(i + 1) % n]["y"] - points[(i + 1) % n]["x"] * points[i]["y"]
    return F.when(n >= 3, F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + edge(i))) / 2).otherwise(F.lit(0.0))


def footprint_area(points: Column, lo: Column, hi: Column) -> Column:
    """Area of a plan polygon of at least three corners, else of the box's plan."""
    box = F.greatest(hi[0] - lo[0], F.lit(0.0)) * F.greatest(hi[1] - lo[1], F.lit(0.0))
    return F.when(F.size(points) >= 3, polygon_area(points)).otherwise(box)


def point_box_distance(p: Column, lo: Column, hi: Column) -> Column:
    """Distance of a point to a box, 0 inside."""
    total = F.lit(0.0)
    for k in range(3):
        gap = F.greatest(lo[k] - p[k], p[k] - hi[k], F.lit(0.0))
        total = total + gap * gap
    return F.sqrt(total)


def in_box_xy(x: Column, y: Column, lo: Column, hi: Column) -> Column:
    return x.between(lo[0] - EPSILON, hi[0] + EPSILON) & y.between(lo[1] - EPSILON, hi[1] + EPSILON)


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Whether a point lies in a polygon; its edges count as inside."""
    n = F.size(points)
    index = F.sequence(F.lit(0), n - 1)
    at = lambda i: (points[i]["x"], points[i]["y"], points[(i + 1) % n]["x"], points[(i + 1) % n]["y"])

    def on_edge(i):
        x1, y1, x2, y2 = at(i)
        cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        return (F.abs(cross) <= EPSILON) & x.between(F.least(x1, x2) - EPSILON, F.greatest(x1, x2) + EPSILON) & y.between(F.least(y1, y2) - EPSILON, F.greatest(y1, y2) + EPSILON)

    def crosses(i):
        x1, y1, x2, y2 = at(i)
        return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / F.when(y1 == y2, F.lit(1.0)).otherwise(y2 - y1) + x1)

    odd = F.aggregate(index, F.lit(False), lambda s, i: s != crosses(i))
    return F.when(n >= 3, F.exists(index, on_edge) | odd).otherwise(F.lit(False))


def rectangle(lo: Column, hi: Column) -> Column:
    """A box's plan as a counter-clockwise polygon."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(lo[0], lo[1]), corner(hi[0], lo[1]), corner(hi[0], hi[1]), corner(lo[0], hi[1]))


def thinned(points: Column, most: int = 256) -> Column:
    """At most so many points, evenly chosen in their order, first and last included."""
    return F.when(F.size(points) > most, F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: points[F.floor(k * (F.size(points) - 1) / (most - 1)).cast("int")])).otherwise(points)


def vertex_distance(a: Column, b: Column, most: int = 256) -> Column:
    """Least distance between two sets of points (arrays of arrays of three), each thinned evenly to `most` of them."""
    return F.array_min(F.transform(thinned(a, most), lambda x: F.array_min(F.transform(thinned(b, most), lambda y: point_distance(x, y)))))


def centroid(points: Column) -> Column:
    """Mean of an array of points."""
    n = F.size(points)
    mean = lambda k: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[k]) / n
    return F.when(n > 0, F.array(*map(mean, range(3))))


def bounds(points: Column) -> tuple[Column, Column]:
    """Least and greatest coordinates of an array of points."""
    axis = lambda k: F.transform(points, lambda p: p[k])
    return F.array(*[F.array_min(axis(k)) for k in range(3)]), F.array(*[F.array_max(axis(k)) for k in range(3)])


def plan_axis(points: Column) -> Column:
    """Direction (x, y) of the widest spread of points in plan, from the closed form of a 2 x 2 covariance."""
    c, n = centroid(points), F.size(points)
    moment = lambda i, j: F.aggregate(points, F.lit(0.0), lambda s, p: s + (p[i] - c[i]) * (p[j] - c[j])) / n
    angle = F.atan2(2 * moment(0, 1), moment(0, 0) - moment(1, 1)) / 2
    return F.struct(F.cos(angle).alias("x"), F.sin(angle).alias("y"))


def clip_area(p: list, q: list) -> float:
    """Common area of two convex counter-clockwise polygons, lists of (x, y): p is cut by each edge of q in turn."""
    for k in range(len(q)):
        (ax, ay), (bx, by) = q[k], q[(k + 1) % len(q)]
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in p]
        out = []
        for i, (here, s) in enumerate(zip(p, side, strict=True)):
            j = (i + 1) % len(p)
            if s >= -EPSILON:
                out.append(here)
            if (s > EPSILON and side[j] < -EPSILON) or (s < -EPSILON and side[j] > EPSILON):
                f = s / (s - side[j])
                out.append((here[0] + f * (p[j][0] - here[0]), here[1] + f * (p[j][1] - here[1])))
        p = out
        if len(p) < 3:
            return 0.0
    return abs(sum(p[i][0] * p[(i + 1) % len(p)][1] - p[(i + 1) % len(p)][0] * p[i][1] for i in range(len(p)))) / 2


def hull(points: list) -> list:
    """Convex hull of (x, y) points, counter-clockwise, rounded to 6 digits."""
    pts = sorted({(round(x, 6), round(y, 6)) for x, y in points})
    if len(pts) < 3:
        return pts

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return half(pts)[:-1] + half(reversed(pts))[:-1]
