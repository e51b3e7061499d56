"""Near-duplicate vectors within a label by exact cosine, in PCA-ordered tiles.

Vectors are rotated to the axes of their second moments, by falling weight, and laid out in that order; each tile holds up to ``TILE`` neighbours of one label
and dimension. Two unit vectors with cosine c differ by sqrt(2 - 2c) at most on any axes, so tiles whose leading coordinates lie
further apart never meet. For tiles that meet, products are summed up over blocks of leading axes; what the rest can add is at most the product of the two
suffix norms, and when no pair of rows can reach the threshold any more, the tiles are left. Survivors are settled by the cosine of the vectors as given, in
double precision. Equal vectors are one weighted row, and a pair of tiles returns sums of links and a star per connected set, never pairs.

Successive tiles are a block; tiles travel once for each pair of blocks that holds tiles that meet, not once for each pair of tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Scratch, components, kept

THRESHOLD = 0.98
TILE, LEAD, STEP = 512, 8, 16
#: A block has 2 ** BLOCK_BITS tiles.
BLOCK_BITS = 3
#: The rotation is fitted to at most so many numbers (vectors times dimensions), and has at most so many axes; what lies beyond them counts as the rest. Any
#: rotation gives the same links.
FIT_NUMBERS, AXES = 1 << 20, 256


def axes(vectors: np.ndarray) -> np.ndarray:
    """Orthonormal axes as columns, by falling second moment of the normalised rows."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    if vectors.shape[1] <= 2 * AXES:
        return np.ascontiguousarray(np.linalg.eigh(unit.T @ unit)[1][:, ::-1][:, :AXES])
    return np.ascontiguousarray(np.linalg.svd(unit, full_matrices=False)[2][:AXES].T)


def _rotation(rotations: dict, dim: int) -> np.ndarray:
    """Vectors too few to be cut into tiles need no order."""
    return rotations[dim] if dim in rotations else np.eye(dim, min(dim, LEAD))


_TILE = "tile long, label string, dim int, nodes binary, weights binary, vectors binary, low array<double>, high array<double>"
_KINDS = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], names=[c.split()[0] for c in _TILE.split(", ")])


def _matrix(lists: pa.Array, dims: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Vectors of equal length at some places of a column of lists."""
    first = np.cumsum(dims) - dims
    return lists.flatten().to_numpy()[first[at][:, None] + np.arange(dims[at[0]])]


def _tiles(rotations: dict, kind: str, most: int):
    """Rows in order to tiles of one label and dimension."""

    def run(batches):
        at, held, number = None, [], TaskContext.get().partitionId() << 32

        def tile():
            nonlocal held, number
            nodes, weights, rows = (np.concatenate(x) for x in zip(*held, strict=True))
            wide = rows.astype(np.float64)
            lead = (wide / np.linalg.norm(wide, axis=1, keepdims=True)) @ _rotation(rotations, at[1])[:, :LEAD]
            head = np.zeros((len(rows), LEAD))
            head[:, : lead.shape[1]] = lead
            number, held = number + 1, []
            return (number, *at, nodes.astype("<i8").tobytes(), weights.astype("<i8").tobytes(), rows.astype(kind).tobytes(), head.min(0).tolist(), head.max(0).tolist())

        for batch in batches:
            label, dims = batch.column("label").to_numpy(zero_copy_only=False), batch.column("dim").to_numpy()
            nodes, weights, lists = batch.column("node").to_numpy(), batch.column("w").to_numpy(), batch.column("v")
            cuts = np.flatnonzero(np.append(True, (label[1:] != label[:-1]) | (np.diff(dims) != 0))) if len(nodes) else []
            made = []
            for low, high in zip(cuts, np.append(cuts[1:], len(nodes)), strict=True):
                if at != (key := (label[low], int(dims[low]))):
                    if held:
                        made.append(tile())
                    at = key
                while low < high:
                    stop = min(high, low + most - sum(len(h[0]) for h in held))
                    held.append((nodes[low:stop], weights[low:stop], _matrix(lists, dims, np.arange(low, stop))))
                    low = stop
                    if sum(len(h[0]) for h in held) == most:
                        made.append(tile())
            yield _batch(made)
        if held:
            yield _batch([tile()])

    return run


def linked(a: np.ndarray, b: np.ndarray, rotation: np.ndarray, threshold: float, step: int = STEP) -> np.ndarray:
    """Whether the cosine of each row of a and each row of b reaches the threshold; the columns of rotation are orthonormal leading axes."""
    na, nb = np.linalg.norm(a, axis=1, keepdims=True), np.linalg.norm(b, axis=1, keepdims=True)
    ua, ub = a / na @ rotation, b / nb @ rotation
    # norms of what follows each axis; the last term outweighs rounding
    ra, rb = (np.sqrt(np.maximum(0, 1 - np.cumsum(u**2, axis=1)) + 1e-14) for u in (ua, ub))
    rows, cols = np.arange(len(a)), np.arange(len(b))
    got, out = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)), bool)
    for k in range(0, ua.shape[1], step):
        got += ua[rows, k : k + step] @ ub[cols, k : k + step].T
        last = min(k + step, ua.shape[1]) - 1
        able = got + np.outer(ra[rows, last], rb[cols, last]) >= threshold - 1e-9
        if not able.any():
            return out
        # rows and columns out of reach of all others are left
        keep_r, keep_c = able.any(axis=1), able.any(axis=0)
        rows, cols, got, able = rows[keep_r], cols[keep_c], got[np.ix_(keep_r, keep_c)], able[np.ix_(keep_r, keep_c)]
    i, j = np.nonzero(able)
    exact = np.concatenate([np.einsum("ij,ij->i", a[rows[i[s : s + 16384]]], b[cols[j[s : s + 16384]]]) for s in range(0, len(i), 16384)] or [np.zeros(0)])
    good = exact / (na[rows[i], 0] * nb[cols[j], 0]) >= threshold
    out[rows[i[good]], cols[j[good]]] = True
    return out


def _stars(link: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """(node, least node) for each connected set of a symmetric matrix."""
    left, out = link.any(axis=1), []
    while left.any():
        reached = np.zeros(len(ids), bool)
        front = np.zeros(len(ids), bool)
        front[np.argmax(left)] = True
        while front.any():
            reached |= front
            front = link[front].any(axis=0) & ~reached
        nodes = ids[reached]
        out += [(int(x), int(nodes.min())) for x in nodes if x != nodes.min()]
        left &= ~reached
    return out


def _pair(p: dict, q: dict, rotation: np.ndarray, threshold: float, kind: str) -> list[tuple]:
    """(node, null, links) of the rows of two tiles, or of one with itself, and (node, least node, null) of what they connect."""
    same, dim = p["tile"] == q["tile"], p["dim"]
    nodes, weights = ([np.frombuffer(t[c], "<i8") for t in (p, q)] for c in ("nodes", "weights"))
    a, b = (np.frombuffer(t["vectors"], kind).reshape(-1, dim).astype(np.float64) for t in (p, q))
    link = linked(a, b, rotation, threshold)
    if same:
        np.fill_diagonal(link, False)
    if not link.any():
        return []
    counts = [(nodes[0], link @ weights[1])] + ([] if same else [(nodes[1], weights[0] @ link)])
    out = [(int(i), None, int(n)) for who, n in counts for i, n in zip(who, n, strict=True) if n]
    if same:
        return out + [(*e, None) for e in _stars(link, nodes[0])]
    n, both = len(nodes[0]), np.concatenate(nodes)
    square = np.zeros((len(both), len(both)), bool)
    square[:n, n:], square[n:, :n] = link, link.T
    return out + [(*e, None) for e in _stars(square, both)]


def _compare(rotations: dict, threshold: float, reach: float, kind: str, bits: int):
    """Compares the tiles of each pair of blocks; rows come in order of the pairs."""
    names = ("tile", "label", "dim", "nodes", "weights", "vectors", "low", "high", "bp", "bq")

    def meet(p: dict, q: dict) -> bool:
        gap = np.maximum(0, np.maximum(np.subtract(p["low"], q["high"]), np.subtract(q["low"], p["high"])))
        return p["label"] == q["label"] and p["dim"] == q["dim"] and float(gap @ gap) <= reach * reach

    def group(tiles: list[dict]):
        bp, bq = tiles[0]["bp"], tiles[0]["bq"]
        out = []
        for p in tiles:
            for q in tiles:
                if p["tile"] >> bits == bp and q["tile"] >> bits == bq and p["tile"] <= q["tile"] and meet(p, q):
                    out += _pair(p, q, _rotation(rotations, p["dim"]), threshold, kind)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["a", "b", "n"])

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            for r in range(batch.num_rows):
                tile = {c: batch.column(c)[r].as_py() for c in names}
                if held and (held[0]["bp"], held[0]["bq"]) != (tile["bp"], tile["bq"]):
                    yield group(held)
                    held = []
                held.append(tile)
        if held:
            yield group(held)

    return run


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component_id, kept) for every row; keys are of any type with an order, labels of any type with a text.

    Rows link if their labels are equal and not null, their vectors equally long (of any length), and the cosine in double precision is at least the threshold. Vectors that are null,
    empty or zero or hold null or non-finite numbers link with nothing, nor do rows with a null key. n_links counts other keys; rows that
    repeat a key and its vector count once; a key that comes with several vectors gets a row for each, linked on its own. component_id is the least key that links reach; of equal
    vectors none is special but for that. No rows give no rows; other columns play no part, whatever their names.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vector].dataType == T.ArrayType(T.FloatType())
    number, kind = ("float", "<f4") if single else ("double", "<f8")
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").cast(f"array<{number}>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(fit, F.lit(False)))
    good = rows.where("ok").withColumns({"dim": F.size("v"), "h1": F.xxhash64(F.lit(1), "v"), "h2": F.xxhash64("v", F.lit(2))})
    same = ["label", "dim", "h1", "h2"]
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    with Scratch(spark) as scratch:
        # equal vectors once, numbered before they are written
        uniq = good.groupBy(*same, "id").agg(F.first("v").alias("v")).groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("w"), F.first("v").alias("v"))
        uniq = scratch.keep(uniq.withColumn("node", F.monotonically_increasing_id()))
        rotations = {}
        for row in uniq.groupBy("dim").count().where(F.col("count") > TILE).collect():
            some = uniq.where(F.col("dim") == row.dim).orderBy("h1", "h2").select("v").limit(max(2 * LEAD, FIT_NUMBERS // row.dim)).toArrow().column("v").combine_chunks()
            rotations[row.dim] = axes(some.flatten().to_numpy().astype(np.float64).reshape(-1, row.dim))
        shipped, most, bits = spark.sparkContext.broadcast(rotations), TILE, BLOCK_BITS

        # order by label and leading coordinates: the first in steps of the reach, then the second
        def lead(batches):
            for batch in batches:
                dims, lists = batch.column("dim").to_numpy(), batch.column("v")
                first, second = np.zeros(len(dims)), np.zeros(len(dims))
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    x = _matrix(lists, dims, at).astype(np.float64)
                    x = x / np.linalg.norm(x, axis=1, keepdims=True) @ _rotation(shipped.value, int(dim))[:, :2]
                    first[at] = np.floor(x[:, 0] / reach)
                    second[at] = x[:, 1] if x.shape[1] > 1 else 0
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first), pa.array(second)], names=[*batch.schema.names, "c0", "c1"])

        order = ["label", "dim", "c0", "c1", "node"]
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        laid = uniq.select("node", "w", "label", "dim", "v").mapInArrow(lead, f"node long, w long, label string, dim int, v array<{number}>, c0 double, c1 double")
        laid = laid.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        tiles = scratch.keep(laid.mapInArrow(lambda b: _tiles(shipped.value, kind, most)(b), _TILE))

        # blocks with tiles that can hold a pair: bins of the first two axes that a tile spans, and their neighbours
        def bins(axis: int, by: int):
            return F.explode(F.sequence((F.floor(F.col("low")[axis] / reach) - by).cast("long"), (F.floor(F.col("high")[axis] / reach) + by).cast("long")))

        meta = scratch.keep(tiles.select("tile", "label", "dim", "low", "high"))
        side = lambda s, by: meta.select(F.col("tile").alias(s), "label", "dim", F.col("low").alias("l" + s), F.col("high").alias("h" + s), "low", "high", bins(0, by).alias("b0")).withColumn("b1", bins(1, by)).drop("low", "high")
        gap = F.aggregate(F.arrays_zip("lp", "hp", "lq", "hq"), F.lit(0.0), lambda s, z: s + F.pow(F.greatest(z["lp"] - z["hq"], z["lq"] - z["hp"], F.lit(0.0)), F.lit(2)))
        block = lambda c: F.shiftright(c, bits)
        meets = side("p", 0).join(side("q", 1), ["label", "dim", "b0", "b1"]).where((F.col("p") <= F.col("q")) & (gap <= reach * reach))
        meets = scratch.keep(meets.select(block("p").alias("bp"), block("q").alias("bq")).distinct())
        ends = meets.select("bp", "bq", F.explode(F.array_distinct(F.array("bp", "bq"))).alias("block"))
        placed = ends.join(tiles.withColumn("block", block("tile")), "block").drop("block").repartition("bp", "bq").sortWithinPartitions("bp", "bq")
        found = scratch.keep(placed.mapInArrow(lambda b: _compare(shipped.value, threshold, reach, kind, bits)(b), "a long, b long, n long"))
        links = found.where("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
        roots = components(found.where("b IS NOT NULL").select("a", "b"), scratch)
        # the least key of a component
        of = roots.join(uniq.select("node", "rep"), "node")
        of = of.join(of.groupBy("root").agg(F.min("rep").alias("least")), "root").select("node", "least")
        class_of = uniq.select(*same, "node", "rep", "w").join(links, "node", "left").join(of, "node", "left").select(*same, (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component"))
        inside = good.select("id", *same).join(class_of, same).select("id", "n_links", "component")
        outside = rows.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
        return kept(inside.unionByName(outside).select(F.col("id").alias(key), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")))
