"""Records of the elements in STEP files, with geometry in metres: placements, profiles and meshes become vertices in the model's coordinates.

Matrices are arrays of twelve numbers, three rows of four. Each placement knows the one that it is relative to; chains are composed by pointer doubling, so that a chain of n takes about log2(n) joins.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import geometry as g
from ..functions import text as tx
from ..operators.graph import is_container
from ..operators.staging import kept
from . import records, step, step_check
from .step import ref, refs

_NUMBERS, _POINTS = ArrayType(DoubleType()), ArrayType(ArrayType(DoubleType()))
# Powers of ten of prefixes of units.
PREFIXES = {"EXA": 18, "PETA": 15, "TERA": 12, "GIGA": 9, "MEGA": 6, "KILO": 3, "HECTO": 2, "DECA": 1, "DECI": -1, "CENTI": -2, "MILLI": -3, "MICRO": -6, "NANO": -9, "PICO": -12, "FEMTO": -15, "ATTO": -18}
#: Corners of a circle's profile.
ROUND = 32
# Representations that are not bodies, and where entities have their predefined type if not in the ninth place.
NOT_BODIES = ("Axis", "FootPrint", "Box", "Annotation", "Profile", "CoG", "Clearance", "Lighting", "Reference", "Surface")
KIND_AT = {"IFCDOOR": 11, "IFCWINDOW": 11, "IFCSPACE": 10, "IFCSTAIRFLIGHT": 13}
NO_KIND = ("IFCPROJECT", "IFCSITE", "IFCBUILDING", "IFCBUILDINGSTOREY")


def numbers(c: Column, kind: str = "array<double>") -> Column:
    """Numbers in parentheses, nested as kind has it."""
    return F.from_json(F.translate(F.regexp_replace(c, r"\.(?![0-9])", ".0"), "()", "[]"), kind)


def _rows(lists: pa.Array, width: int, default=0.0) -> np.ndarray:
    """Lists of numbers as rows of one matrix: short ones and nulls are filled up with the default's numbers."""
    out = np.tile(np.broadcast_to(np.asarray(default, float), (width,)), (len(lists), 1))
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    flat = np.asarray(pc.fill_null(lists.flatten(), np.nan), float)
    row = np.repeat(np.arange(len(lists)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    inside = at < width
    out[row[inside], at[inside]] = flat[inside]
    # a plan vector has no third number
    short = (size > 0) & (size < width)
    for k in range(width):
        out[short & (size <= k), k] = 0.0
    return out


def _lists(matrix: np.ndarray, none: np.ndarray) -> pa.Array:
    width = matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, width, dtype=np.int32)), pa.array(matrix.reshape(-1)), mask=pa.array(none))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)


@F.arrow_udf(_NUMBERS)
def frame(at: pa.Array, axis: pa.Array, across: pa.Array) -> pa.Array:
    """The matrix of a placement: z along axis, x along what of across is square to it, y square to both; where across has nothing square to axis, x turns to the plan's y."""
    z = _unit(_rows(axis, 3, (0.0, 0.0, 1.0)))
    square = lambda v: v - (v * z).sum(axis=1, keepdims=True) * z
    x = square(_rows(across, 3, (1.0, 0.0, 0.0)))
    lost = (x * x).sum(axis=1) < 1e-24
    x[lost] = square(np.tile([0.0, 1.0, 0.0], (len(x), 1)))[lost]
    x = _unit(x)
    return _lists(np.stack([x, np.cross(z, x), z, _rows(at, 3)], axis=2).reshape(-1, 12), np.zeros(len(x), bool))


def _null(*columns: pa.Array) -> np.ndarray:
    return reduce(np.logical_or, [np.asarray(pc.is_null(c)) for c in columns])


@F.arrow_udf(_NUMBERS)
def compose(a: pa.Array, b: pa.Array) -> pa.Array:
    """The matrix that does b, then a; null if either is."""
    p, q = _rows(a, 12).reshape(-1, 3, 4), _rows(b, 12).reshape(-1, 3, 4)
    out = p[:, :, :3] @ q
    out[:, :, 3] += p[:, :, 3]
    return _lists(out.reshape(-1, 12), _null(a, b))


@F.arrow_udf(_NUMBERS)
def turned_back(m: pa.Array) -> pa.Array:
    """The inverse of a matrix that turns and shifts."""
    p = _rows(m, 12).reshape(-1, 3, 4)
    back = np.swapaxes(p[:, :, :3], 1, 2)
    return _lists(np.concatenate([back, -back @ p[:, :, 3:]], axis=2).reshape(-1, 12), _null(m))


@F.arrow_udf(_POINTS)
def moved(m: pa.Array, points: pa.Array) -> pa.Array:
    """Points (of two or three numbers) by a matrix, all of a batch at once; points as they are, in space, where there is no matrix."""
    size = np.asarray(pc.fill_null(pc.list_value_length(points), 0))
    p = _rows(points.flatten(), 3)
    own = _rows(m, 12, [float(k in (0, 5, 10)) for k in range(12)]).reshape(-1, 3, 4)[np.repeat(np.arange(len(size)), size)]
    out = np.einsum("nij,nj->ni", own[:, :, :3], p) + own[:, :, 3]
    inner = _lists(out, np.zeros(len(out), bool))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), inner, mask=pa.array(_null(points)))


def _once(all_: DataFrame, *entities: str) -> DataFrame:
    return all_.where(F.col("entity").isin(*entities))


#: What more rows than this refer to is sent to them; others meet it by its number.
SHARED = 10_000


def _looked_up(rows: DataFrame, key: list[str], table: DataFrame, counted: DataFrame | None = None, **columns: str) -> DataFrame:
    """rows (id, ...) with what a table (id, v) holds for references: columns gives names by the columns that refer. counted: rows as they were before joins, where that is cheaper to read.

    Many rows may refer to one instance, or to none. The former are few instances, which are broadcast; the latter are spread by their own ids, so that neither gather in a task.
    """
    ends = (rows if counted is None else counted).select(*key, F.explode(F.array(*columns.values())).alias("id")).where("id IS NOT NULL")
    often = ends.groupBy(*key, "id").agg(F.count("*").alias("n")).where(F.col("n") > SHARED).select(*key, "id")
    shared = kept(table.join(often, [*key, "id"], "left_semi").select(*key, "id", "v"))
    some = not shared.isEmpty()
    for name, by in columns.items():
        if some:
            rows = rows.join(F.broadcast(shared.select(*key, F.col("id").alias(by), F.col("v").alias("_v"))), [*key, by], "left")
        own = F.when(F.col("_v").isNull(), F.col(by)) if some else F.col(by)
        # no instance has a number below 0
        rows = rows.withColumn("_to", F.coalesce(own, -1 - F.pmod(F.xxhash64("id"), F.lit(1 << 40))))
        rows = rows.join(table.select(*key, F.col("id").alias("_to"), F.col("v").alias(name)), [*key, "_to"], "left").drop("_to")
        if some:
            rows = rows.withColumn(name, F.coalesce("_v", name)).drop("_v")
    return rows


def frames(all_: DataFrame) -> DataFrame:
    """(dataset, id, m) of axis placements in space and in the plan."""
    key = ["dataset"]
    vectors = _once(all_, "IFCCARTESIANPOINT", "IFCDIRECTION").select(*key, "id", numbers(step.arg(1)).alias("v"))
    flat = F.col("entity") == "IFCAXIS2PLACEMENT2D"
    rows = _once(all_, "IFCAXIS2PLACEMENT3D", "IFCAXIS2PLACEMENT2D").select(*key, "id", ref(1).alias("p"), F.when(~flat, F.get(F.col("args"), F.lit(1))).alias("a"), F.when(flat, F.get(F.col("args"), F.lit(1))).otherwise(F.get(F.col("args"), F.lit(2))).alias("x"))
    rows = rows.withColumns({c: F.regexp_extract(c, r"^#(\d+)$", 1).try_cast("long") for c in ("a", "x")})
    rows = _looked_up(rows, key, vectors, at="p", axis="a", across="x")
    return rows.select(*key, "id", frame("at", "axis", "across").alias("m"))


def placements(all_: DataFrame, axes: DataFrame | None = None) -> DataFrame:
    """(dataset, id, m): local placements in the model's coordinates, in the file's unit. One that is relative to itself, by whatever way, has none."""
    key = ["dataset"]
    rows = _once(all_, "IFCLOCALPLACEMENT").select(*key, "id", ref(1).alias("up"), ref(2).alias("f"))
    identity = F.array(*[F.lit(1.0 if k in (0, 5, 10) else 0.0) for k in range(12)])
    # a reference to a placement that isn't there ends the chain
    known = _looked_up(rows, key, rows.select(*key, "id", F.lit(True).alias("v")), known="up").select(*key, "id", "f", F.when(F.col("known"), F.col("up")).alias("up"))
    made = (frames(all_) if axes is None else axes).withColumnRenamed("m", "v")
    rows = kept(_looked_up(known, key, made, rows, m="f").select(*key, "id", "up", F.coalesce("m", identity).alias("m")))
    n = rows.count()
    for _ in range(max(1, n).bit_length()):
        if rows.where("up IS NOT NULL").isEmpty():
            break
        # what is above what is above: chains are half as long after each round
        above = rows.select(*key, "id", F.struct("up", "m").alias("v"))
        rows = kept(_looked_up(rows, key, above, above="up").select(*key, "id", F.col("above.up").alias("up"), F.coalesce(compose("above.m", "m"), "m").alias("m")))
    return rows.select(*key, "id", F.when(F.col("up").isNull(), F.col("m")).alias("m"))


def scales(all_: DataFrame) -> DataFrame:
    """(dataset, scale): metres in the file's unit of length; of several units the first by id, none is metres."""
    key = ["dataset"]
    power = F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])
    units = _once(all_, "IFCSIUNIT").where(step.arg(2) == ".LENGTHUNIT.").select(*key, "id", F.pow(F.lit(10.0), F.coalesce(power[F.trim(F.translate(step.arg(3), ".", " "))], F.lit(0))).alias("v"))
    # 0.001 is nearer to a thousandth than 10 to the power of -3 may be
    units = units.withColumn("v", F.round("v", 18))
    measures = _once(all_, "IFCMEASUREWITHUNIT").select(*key, "id", F.regexp_extract(step.arg(1), r"\(?(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\)?$", 1).try_cast("double").alias("n"), ref(2).alias("u"))
    measures = _looked_up(measures, key, units, base="u").select(*key, "id", (F.col("n") * F.coalesce("base", F.lit(1.0))).alias("v"))
    other = _once(all_, "IFCCONVERSIONBASEDUNIT").where(step.arg(2) == ".LENGTHUNIT.").select(*key, "id", ref(4).alias("u"))
    other = _looked_up(other, key, measures, v="u").select(*key, "id", "v")
    assigned = _once(all_, "IFCUNITASSIGNMENT").select(*key, F.explode(refs(1)).alias("id"))
    found = assigned.join(other.unionByName(units), [*key, "id"]).groupBy(*key).agg(F.min_by("v", "id").alias("scale"))
    return all_.select(*key).distinct().join(found, key, "left").select(*key, F.coalesce("scale", F.lit(1.0)).alias("scale"))


def _gathered(rows: DataFrame, key: list[str], by: str) -> DataFrame:
    """(dataset, id, points): points in order, of (dataset, by, n, p)."""
    return rows.groupBy(*key, F.col(by).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "p"))), lambda x: x["p"]).alias("points"))


def _point(key: list[str], all_: DataFrame) -> DataFrame:
    return _once(all_, "IFCCARTESIANPOINT").select(*key, F.col("id").alias("q"), numbers(step.arg(1)).alias("p"))


def profiles(all_: DataFrame, axes: DataFrame) -> DataFrame:
    """(dataset, id, points): outlines, in the plane z = 0, of rectangles, circles (ROUND corners) and closed lines of straight parts."""
    key = ["dataset"]
    lines = _once(all_, "IFCPOLYLINE").select(*key, "id", F.posexplode(refs(1)).alias("n", "q")).join(_point(key, all_), [*key, "q"])
    lists = _once(all_, "IFCCARTESIANPOINTLIST2D").select(*key, "id", numbers(step.arg(1), "array<array<double>>").alias("v"))
    curves = _looked_up(_once(all_, "IFCINDEXEDPOLYCURVE").select(*key, "id", ref(1).alias("l")), key, lists, points="l").select(*key, "id", "points")
    curves = _gathered(lines, key, "id").unionByName(curves).withColumnRenamed("points", "v")
    free = _once(all_, "IFCARBITRARYCLOSEDPROFILEDEF", "IFCARBITRARYPROFILEDEFWITHVOIDS").select(*key, "id", ref(3).alias("c"))
    free = _looked_up(free, key, curves, points="c").select(*key, "id", "points", F.lit(None).cast("long").alias("f"))
    size = lambda k: step.arg(k).try_cast("double")
    half = [(1, 1), (1, -1), (-1, -1), (-1, 1)]
    box = _once(all_, "IFCRECTANGLEPROFILEDEF", "IFCRECTANGLEHOLLOWPROFILEDEF", "IFCROUNDEDRECTANGLEPROFILEDEF").select(*key, "id", F.array(*[F.array(size(4) / 2 * a, size(5) / 2 * b) for a, b in half]).alias("points"), ref(3).alias("f"))
    turns = [2 * math.pi * k / ROUND for k in range(ROUND)]
    disc = _once(all_, "IFCCIRCLEPROFILEDEF", "IFCCIRCLEHOLLOWPROFILEDEF").select(*key, "id", F.array(*[F.array(size(4) * math.cos(t), size(4) * math.sin(t)) for t in turns]).alias("points"), ref(3).alias("f"))
    rows = _looked_up(free.unionByName(box).unionByName(disc), key, axes.withColumnRenamed("m", "v"), box.unionByName(disc), m="f")
    return rows.select(*key, "id", moved("m", "points").alias("points"))


def items(all_: DataFrame, axes: DataFrame) -> DataFrame:
    """(dataset, id, points): vertices of tessellations, extrusions and facetted bodies, as their own coordinates have them."""
    key = ["dataset"]
    lists = _once(all_, "IFCCARTESIANPOINTLIST3D").select(*key, "id", numbers(step.arg(1), "array<array<double>>").alias("v"))
    meshes = _looked_up(_once(all_, "IFCTRIANGULATEDFACESET", "IFCTRIANGULATEDIRREGULARNETWORK", "IFCPOLYGONALFACESET").select(*key, "id", ref(1).alias("l")), key, lists, points="l").select(*key, "id", "points")
    solids = _once(all_, "IFCEXTRUDEDAREASOLID").select(*key, "id", ref(1).alias("o"), ref(2).alias("f"), ref(3).alias("d"), step.arg(4).try_cast("double").alias("depth"))
    ways = _once(all_, "IFCDIRECTION").select(*key, "id", numbers(step.arg(1)).alias("v"))
    drawn = profiles(all_, axes).select(*key, "id", F.col("points").alias("v"))
    placed = _looked_up(_looked_up(solids, key, ways, way="d"), key, axes.withColumnRenamed("m", "v"), solids, m="f")
    solids = _looked_up(placed, key, drawn, solids, points="o").where("points IS NOT NULL")
    w = [F.coalesce(F.get("way", F.lit(i)), F.lit(float(i == 2))) for i in range(3)]
    solids = solids.withColumn("f", F.col("depth") / F.sqrt(w[0] * w[0] + w[1] * w[1] + w[2] * w[2])).withColumn("s", F.array(*[c * F.col("f") for c in w]))
    upper = F.transform("points", lambda p: F.zip_with(p, "s", lambda a, b: a + b))
    solids = solids.select(*key, "id", moved("m", F.concat("points", upper)).alias("points"))
    # bodies, shells, faces, bounds, loops, points
    down = _once(all_, "IFCFACETEDBREP").select(*key, F.col("id").alias("item"), ref(1).alias("k")).unionByName(_once(all_, "IFCFACEBASEDSURFACEMODEL", "IFCSHELLBASEDSURFACEMODEL").select(*key, F.col("id").alias("item"), F.explode(refs(1)).alias("k")))
    for entities in (("IFCCLOSEDSHELL", "IFCOPENSHELL", "IFCCONNECTEDFACESET"), ("IFCFACE", "IFCFACESURFACE"), ("IFCFACEOUTERBOUND", "IFCFACEBOUND"), ("IFCPOLYLOOP",)):
        down = down.join(_once(all_, *entities).select(*key, F.col("id").alias("k"), F.explode(refs(1)).alias("next")), [*key, "k"]).select(*key, "item", F.col("next").alias("k")).distinct()
    faces = _gathered(down.join(_point(key, all_).withColumnRenamed("q", "k"), [*key, "k"]).withColumn("n", F.col("k")), key, "item")
    return reduce(DataFrame.unionByName, (meshes, solids, faces)).where(F.size("points") > 0)


def _mapped(all_: DataFrame, axes: DataFrame, shapes: DataFrame) -> DataFrame:
    """(dataset, id, points) of mapped items: the items of another representation, from its origin to a target."""
    key = ["dataset"]
    vectors = _once(all_, "IFCCARTESIANPOINT", "IFCDIRECTION").select(*key, "id", numbers(step.arg(1)).alias("v"))
    to = _once(all_, "IFCCARTESIANTRANSFORMATIONOPERATOR3D", "IFCCARTESIANTRANSFORMATIONOPERATOR3DNONUNIFORM")
    to = to.select(*key, "id", ref(1).alias("x"), ref(3).alias("p"), ref(5).alias("a"), F.coalesce(step.arg(4).try_cast("double"), F.lit(1.0)).alias("scale"))
    to = _looked_up(to, key, vectors, across="x", at="p", axis="a")
    # rotation times scale; the shift isn't scaled
    to = to.select(*key, F.col("id").alias("t"), frame("at", "axis", "across").alias("m"), "scale").select(*key, "t", F.transform("m", lambda x, k: F.when(k % 4 == 3, x).otherwise(x * F.col("scale"))).alias("to"))
    maps = _once(all_, "IFCREPRESENTATIONMAP").select(*key, F.col("id").alias("r"), ref(1).alias("f"), ref(2).alias("shape")).join(axes.withColumnRenamed("id", "f").withColumnRenamed("m", "origin"), [*key, "f"], "left")
    maps = maps.select(*key, "r", "shape", turned_back("origin").alias("back"))
    of = _once(all_, "IFCSHAPEREPRESENTATION").select(*key, F.col("id").alias("shape"), F.explode(refs(4)).alias("id"))
    rows = _once(all_, "IFCMAPPEDITEM").select(*key, F.col("id").alias("item"), ref(1).alias("r"), ref(2).alias("t")).join(maps, [*key, "r"]).join(to, [*key, "t"]).join(of, [*key, "shape"]).join(shapes, [*key, "id"])
    rows = rows.withColumn("m", F.coalesce(compose("to", "back"), "to")).select(*key, "item", F.col("id").alias("n"), moved("m", "points").alias("p"))
    return _gathered(rows, key, "item").select(*key, "id", F.flatten("points").alias("points"))


def vertices(all_: DataFrame) -> DataFrame:
    """(dataset, express_id, vertices, placement): distinct vertices of products with a body, in metres, and the placement, in the file's unit.

    Products with a placement alone have no vertices. The body is that of the representation called so, else of those that aren't axes, plans or the like. Openings are not cut out.
    """
    key = ["dataset"]
    axes = kept(frames(all_))
    own = kept(items(all_, axes))
    shapes = own.unionByName(kept(_mapped(all_, axes, own)))
    products = all_.where(F.col("entity").rlike("^IFC") & ~F.col("entity").rlike("^IFC(REL|PROPERTY|QUANTITY|ELEMENTQUANTITY)|TYPE$|STYLE$") & (F.size("args") >= 7)).select(*key, F.col("id").alias("express_id"), ref(6).alias("place"), ref(7).alias("shape"))
    placed = products.where("place IS NOT NULL").join(placements(all_, axes).select(*key, F.col("id").alias("place"), "m"), [*key, "place"])
    bodies = _once(all_, "IFCPRODUCTDEFINITIONSHAPE").select(*key, F.col("id").alias("shape"), F.explode(refs(3)).alias("r"))
    name = step._text(2)
    kinds = _once(all_, "IFCSHAPEREPRESENTATION").select(*key, F.col("id").alias("r"), F.when(name == "Body", 0).when(~F.coalesce(name, F.lit("")).isin(*NOT_BODIES), 1).alias("rank"), F.explode(refs(4)).alias("id")).where("rank IS NOT NULL")
    rows = placed.where("m IS NOT NULL").select(*key, "express_id", "m", "shape").join(bodies, [*key, "shape"]).join(kinds, [*key, "r"]).join(shapes, [*key, "id"])
    rows = rows.groupBy(*key, "express_id", "rank").agg(F.first("m").alias("m"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("r", "id", "points"))), lambda x: x["points"])).alias("points"))
    best = rows.groupBy(*key, "express_id").agg(F.min_by(F.struct("m", "points"), "rank").alias("b")).select(*key, "express_id", "b.*")
    best = best.join(scales(all_), key).select(*key, "express_id", F.array_distinct(F.transform(moved("m", "points"), lambda p: F.transform(p, lambda x: x * F.col("scale")))).alias("vertices"))
    return placed.select(*key, "express_id", F.col("m").alias("placement")).distinct().join(best, [*key, "express_id"], "left")


_MEASURES = "centre lo hi center extents"
_MEASURED = StructType([*(StructField(n, _NUMBERS) for n in _MEASURES.split()), *(StructField(n, _POINTS) for n in ("axes", "corners_xy", "footprint"))])


@F.arrow_udf(_MEASURED)
def measured(vertices: pa.Array) -> pa.Array:
    """Mean, bounds, oriented box and convex plan of the vertices of each row, all sums, bounds and directions of a batch at once; null without vertices.

    The oriented box is turned in plan to the direction of the widest spread; its extents are halves. Under three vertices it is null. The plan is counter-clockwise from the leftmost corner, its coordinates
    rounded to 6 digits, null under three corners.
    """
    size = np.asarray(pc.fill_null(pc.list_value_length(vertices), 0))
    some = np.flatnonzero(size)
    n = size[some]
    names = [f.name for f in _MEASURED.fields]
    kinds = [pa.list_(pa.float64())] * 5 + [pa.list_(pa.list_(pa.float64()))] * 3
    values = [[None] * len(size) for _ in names]
    if len(some):
        p = _rows(vertices.flatten(), 3)
        first = np.cumsum(n) - n
        row = np.repeat(np.arange(len(n)), n)
        over = lambda how, x: how.reduceat(x, first, axis=0)
        centre = over(np.add, p) / n[:, None]
        lowest, highest = over(np.minimum, p), over(np.maximum, p)
        d = p - centre[row]
        spread = over(np.add, np.stack([d[:, 0] ** 2, d[:, 1] ** 2, d[:, 0] * d[:, 1]], axis=1))
        turn = np.arctan2(2 * spread[:, 2], spread[:, 0] - spread[:, 1]) / 2
        u = np.stack([np.cos(turn), np.sin(turn)], axis=1)
        v = np.stack([-u[:, 1], u[:, 0]], axis=1)
        local = np.stack([(d[:, :2] * u[row]).sum(axis=1), (d[:, :2] * v[row]).sum(axis=1), p[:, 2]], axis=1)
        low, high = over(np.minimum, local), over(np.maximum, local)
        middle = (low + high) / 2
        at = lambda s, t: centre[:, :2] + u * s[:, None] + v * t[:, None]
        box = np.concatenate([at(middle[:, 0], middle[:, 1]), middle[:, 2:]], axis=1)
        corners = np.stack([at(s[:, 0], t[:, 1]) for s, t in ((high, high), (high, low), (low, low), (low, high))], axis=1)
        flat = np.zeros((len(n), 1))
        axes = np.stack([np.hstack([u, flat]), np.hstack([v, flat]), np.tile([0.0, 0.0, 1.0], (len(n), 1))], axis=1)
        for k, at_row in enumerate(some):
            plan = g.hull(p[first[k] : first[k] + n[k], :2].tolist())
            turned = (box[k].tolist(), ((high - low) / 2)[k].tolist(), axes[k].tolist(), corners[k].tolist()) if n[k] >= 3 else (None,) * 4
            both = (centre[k].tolist(), lowest[k].tolist(), highest[k].tolist(), *turned, [list(c) for c in plan] if len(plan) >= 3 else None)
            for name, value in zip(range(len(names)), both, strict=True):
                values[name][at_row] = value
    return pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names, mask=pa.array(size == 0))


def _names(all_: DataFrame, entity: str, place: int) -> DataFrame:
    return _once(all_, entity).select("dataset", "id", step._text(place).alias("v"))


def materials(all_: DataFrame) -> DataFrame:
    """(dataset, express_id, materials): names of the materials of elements, of those of their layers, constituents and profiles, in order, each once."""
    key = ["dataset"]
    given = _once(all_, "IFCRELASSOCIATESMATERIAL").select(*key, F.explode(refs(5)).alias("express_id"), ref(6).alias("id"))
    # usages and sets lead to parts, parts to materials; which argument points on
    on = {"IFCMATERIALLAYERSETUSAGE": 1, "IFCMATERIALPROFILESETUSAGE": 1, "IFCMATERIALLAYERSET": 1, "IFCMATERIALLIST": 1, "IFCMATERIALCONSTITUENTSET": 3, "IFCMATERIALPROFILESET": 3, "IFCMATERIALLAYER": 1, "IFCMATERIALCONSTITUENT": 3, "IFCMATERIALPROFILE": 3}
    links = reduce(DataFrame.unionByName, [_once(all_, e).select(*key, "id", F.posexplode(refs(k)).alias("n", "next")) for e, k in on.items()])
    found = names = given.withColumn("order", F.array().cast("array<int>"))
    for _ in range(3):
        names = names.join(links, [*key, "id"]).select(*key, "express_id", F.col("next").alias("id"), F.concat("order", F.array("n")).alias("order"))
        found = found.unionByName(names)
    rows = found.join(_names(all_, "IFCMATERIAL", 1), [*key, "id"]).where(F.trim("v") != "")
    return rows.groupBy(*key, "express_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("order", "id", F.trim("v").alias("v")))), lambda x: x["v"])).alias("materials"))


def labels(all_: DataFrame) -> DataFrame:
    """(dataset, id, label): what elements refer to by name: groups by name, else by identifier; classification references by source, identification and name."""
    key = ["dataset"]
    source = _names(all_, "IFCCLASSIFICATION", 4)
    reference = _once(all_, "IFCCLASSIFICATIONREFERENCE").select(*key, "id", ref(4).alias("s"), step._text(2).alias("number"), step._text(3).alias("name"))
    reference = _looked_up(reference, key, source, source="s").select(*key, "id", F.concat_ws(":", *[F.when(F.col(c) != "", F.col(c)) for c in ("source", "number", "name")]).alias("label"))
    groups = _once(all_, "IFCGROUP", "IFCSYSTEM", "IFCDISTRIBUTIONSYSTEM", "IFCBUILDINGSYSTEM", "IFCZONE").select(*key, "id", F.coalesce(tx.blank_to_null(step._text(3)), step._text(1)).alias("label"))
    return reference.unionByName(groups).unionByName(source.withColumnRenamed("v", "label")).where("label <> ''")


def _attributes(all_: DataFrame, group: str, name: str, read) -> DataFrame:
    """(dataset, id, set, name, v) of elements' sets, with those of their types that they don't have themselves; values as JSON."""
    key = ["dataset"]
    # a type lists its own sets; as if relations gave them to it
    none = F.lit("$")
    listed = _typed(all_).select(*key, "id", F.lit("IFCRELDEFINESBYPROPERTIES").alias("entity"), F.array(none, none, none, none, F.concat(F.lit("#"), F.col("id").cast("string")), step.arg(6)).alias("args"), "line")
    own = read(all_.unionByName(listed)).select(*key, F.col("element_id").alias("id"), group, name, F.regexp_replace(F.col("value").cast("string"), "^json:", "").alias("v"))
    held = _once(all_, "IFCRELDEFINESBYTYPE").select(*key, F.explode(refs(5)).alias("occurrence"), ref(6).alias("id"))
    lent = own.join(held, [*key, "id"]).drop("id").withColumnRenamed("occurrence", "id")
    lent = lent.join(own.select(*key, "id", group, name).distinct(), [*key, "id", group, name], "left_anti")
    rows = own.unionByName(lent.select(*own.columns)).where("v IS NOT NULL")
    return rows.groupBy(*key, "id", F.col(group).alias("set"), F.col(name).alias("name")).agg(F.min("v").alias("v"))


def _nested(rows: DataFrame, called: str) -> DataFrame:
    """(dataset, id, called): maps of sets to maps of names to values."""
    inner = rows.groupBy("dataset", "id", "set").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "v")))).alias("members"))
    outer = inner.groupBy("dataset", "id").agg(F.map_from_entries(F.collect_list(F.struct("set", "members"))).alias("sets"))
    return outer.select("dataset", "id", F.transform_values("sets", lambda _, m: F.transform_values(m, lambda __, v: F.try_parse_json(v))).alias(called))


def _typed(all_: DataFrame) -> DataFrame:
    """Type objects: entities whose name ends so, with an identifier."""
    return all_.where(F.col("entity").rlike("TYPE$") & ~F.col("entity").startswith("IFCREL") & (F.size("args") >= 6) & step.arg(1).startswith("'"))


def records_of(all_: DataFrame) -> DataFrame:
    """A record for each element, type and container, with the columns that records.read gives."""
    key = ["dataset"]
    typed = _typed(all_).groupBy(*key, "id").agg(F.min_by(F.struct("entity", "args"), "line").alias("r")).select(*key, "id", "r.*")
    typed = typed.select(*key, F.col("id").alias("express_id"), step._text(1).alias("global_id"), step.type_class_of(F.col("entity")).alias("ifc_class"), *[tx.blank_to_null(step._text(k)).alias(n) for k, n in ((3, "name"), (4, "description"), (8, "tag"))], F.lit(None).cast("string").alias("object_type"))
    own = step.elements(all_).unionByName(typed).withColumnRenamed("express_id", "id")
    place = F.coalesce(F.create_map(*[F.lit(x) for kv in KIND_AT.items() for x in kv])[F.col("entity")], F.when(F.col("entity").endswith("TYPE"), F.when(F.col("entity").isin("IFCSPACETYPE", "IFCFURNITURETYPE"), F.size("args")).otherwise(10)).otherwise(9))
    kind = all_.where(~F.col("entity").isin(*NO_KIND)).select(*key, "id", F.regexp_extract(F.get("args", F.least(place, F.size("args")) - 1), r"^\.([A-Z0-9_]+)\.$", 1).alias("kind"), "line")
    kind = kind.where("kind <> ''").groupBy(*key, "id").agg(F.min_by("kind", "line").alias("kind"))
    # an element is in what contains it, else in the whole that it is part of; a whole that is no container passes on the level of its own
    inside = _once(all_, "IFCRELCONTAINEDINSPATIALSTRUCTURE").select(*key, F.explode(refs(5)).alias("id"), ref(6).alias("parent"))
    parts = _once(all_, "IFCRELAGGREGATES").select(*key, F.explode(refs(6)).alias("id"), ref(5).alias("whole"))
    names = own.select(*key, F.col("id").alias("parent"), F.col("global_id").alias("parent_gid"), F.col("ifc_class").alias("parent_class"), F.col("name").alias("parent_name"))
    parents = inside.unionByName(parts.withColumnRenamed("whole", "parent").join(inside.select(*key, "id"), [*key, "id"], "left_anti")).groupBy(*key, "id").agg(F.min("parent").alias("parent")).join(names, [*key, "parent"], "left")
    above = parents.select(*key, F.col("id").alias("parent"), F.col("parent_name").alias("above"))
    parents = parents.join(above, [*key, "parent"], "left").withColumn("level", F.when(is_container(F.col("parent_class")), F.col("parent_name")).otherwise(F.col("above"))).drop("above")
    type_of = _once(all_, "IFCRELDEFINESBYTYPE").select(*key, F.explode(refs(5)).alias("id"), ref(6).alias("t")).groupBy(*key, "id").agg(F.min("t").alias("t")).join(typed.select(*key, F.col("express_id").alias("t"), F.col("name").alias("type_name")), [*key, "t"]).drop("t")
    gids = own.select(*key, "id", "global_id")
    found = step.relations(all_, openings=True)
    to = gids.select(*key, F.col("id").alias("dst"), F.col("global_id").alias("target"))
    named = labels(all_).select(*key, F.col("id").alias("dst"), F.col("label").alias("target"))
    targets = found.where(F.col("relation").isin(*records.ELEMENT_RELATIONS)).join(to, [*key, "dst"]).unionByName(found.where(F.col("relation").isin(*records.CONTEXT_RELATIONS)).join(named, [*key, "dst"]))
    targets = targets.groupBy(*key, F.col("src").alias("id"), "relation").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    relations = targets.groupBy(*key, "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", "targets")))).alias("relations"))
    properties = _attributes(all_, "pset_name", "property_name", step.properties)
    official = _nested(properties.where(F.col("set").startswith("Pset_")), "official")
    custom = _nested(properties.where(~F.col("set").startswith("Pset_")), "custom")
    quantities = _nested(_attributes(all_, "qto_name", "quantity_name", step.quantities), "quantities")
    shape = kept(vertices(all_)).withColumnRenamed("express_id", "id")
    rows = own
    for more in (kind, parents, type_of, relations, official, custom, quantities, shape, materials(all_).withColumnRenamed("express_id", "id")):
        rows = rows.join(more, [*key, "id"], "left")
    rows = rows.withColumn("f", measured("vertices"))
    matrix = F.when(F.col("placement").isNotNull(), F.concat(*[F.array(F.slice("placement", 4 * i + 1, 4)) for i in range(3)], F.array(F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]))))
    bounds = F.when(F.col("f").isNotNull(), F.struct(F.col("f.lo").alias("min"), F.col("f.hi").alias("max")))
    turned = F.when(F.col("f.center").isNotNull(), F.struct("f.center", "f.extents", "f.axes", "f.corners_xy"))
    geometry = F.struct(
        F.col("f.centre").alias("Centroid"), bounds.alias("BoundingBox"), F.when(F.size("vertices") > 0, F.col("vertices")).alias("MeshVertices"), F.col("f.footprint").alias("FootprintPolygon2D"),
        matrix.alias("LocalPlacementMatrix"), turned.alias("OrientedBoundingBox"),
    )
    return rows.select(
        *key, F.col("id").alias("line"), F.col("global_id").alias("GlobalId"), F.col("id").alias("ExpressId"), F.col("name").alias("Name"), F.col("ifc_class").alias("IfcType"), F.col("ifc_class").alias("ClassRaw"),
        F.lit(None).cast("array<string>").alias("BaseClasses"), F.col("kind").alias("PredefinedType"), F.col("description").alias("Description"), F.col("object_type").alias("ObjectType"), F.col("tag").alias("Tag"), F.col("type_name").alias("TypeName"),
        F.struct(F.col("parent_gid").alias("ParentId"), F.col("parent_class").alias("ParentType"), F.col("level").alias("Level")).alias("Hierarchy"), geometry.alias("Geometry"), F.col("materials").alias("Materials"),
        F.struct(F.col("official").alias("Official"), F.col("custom").alias("Custom")).alias("PropertySets"), F.col("quantities").alias("Quantities"), F.col("relations").alias("Relationships"),
    )


def read(spark: SparkSession, *paths: str, strict: bool = False) -> DataFrame:
    """The records of STEP files; strict refuses files with problems (step_check.problems)."""
    # every step below reads the instances: they are parsed once
    all_ = kept(step.read(spark, *paths))
    if strict:
        step_check.refuse(all_)
    return records_of(all_)
