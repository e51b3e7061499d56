"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A signature needs two permutations only: the first scatters a document's shingles, the second, circularly shifted by 1, 2, 3, ... steps,
gives one coordinate per shift. Both are bijections of 64-bit words, so no table is kept. The k-th coordinate is the least permuted
value; 32 bands of 4 coordinates find a pair of similarity 0.75 but for one in 200,000. In small sets shifted coordinates depend
on one another, so where the smaller has up to ``SMALL`` shingles both add exact keys: their first few shingles by hash, of which a linked pair shares one.

Then, all distributed and without lists of pairs:

1. equal shingle sets collapse to one node each;
2. a bucket holds the nodes that agree on a band; buckets with the same members are one;
3. each member of a bucket is compared with its first node, its leader: a group of near copies costs one comparison a document, and a bucket of two is done;
4. what these links connect is a class. A bucket whose other members still are of several classes is cut into tiles of bounded size, those of its
   largest class apart: every pair of tiles is compared but for two of that class. In a pair of tiles signatures are compared first, and pairs that agree on at least
   half of the coordinates (a pair at the threshold misses that with odds under 1e-9; small sets skip it) are verified, best first, unless already connected;
5. the verified links' components are the classes.

Texts, not sets, travel to the comparisons, and sets are made there. Hot groups: copies vanish in step 1; a bucket is only ever reduced to counts (a partial aggregate) or joined
(which Spark may split); a leader's members and a large bucket become many tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as tx
from ._common import Scratch, components, kept

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 32, 4
#: Pairs whose smaller set has so many shingles at most are found by exact keys.
SMALL = 16
TILE_DOCS, TILE_SHINGLES = 256, 1_000_000
_U = np.uint64
_BLOCK = 1 << 12


def shingle_set(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    return np.unique(tx.shingles(words, size))


def signature(shingles: np.ndarray, length: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of a non-empty set of 64-bit hashes; the hashes' last mixing is the first permutation."""
    best = np.full(length, np.iinfo(np.uint64).max, _U)
    # 64-bit words are ring positions; a shift is a step of 2**64 / length, so that all shifts differ
    shifts = (np.arange(length, dtype=_U) * _U((1 << 64) // length + 1))[:, None]
    for k in range(0, len(shingles), _BLOCK):
        x = shingles[None, k : k + _BLOCK] + shifts
        x ^= x >> _U(31)
        x *= _U(0x7FB5D329728EA185)
        x ^= x >> _U(27)
        np.minimum(best, x.min(axis=1), out=best)
    return best


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    key = np.arange(1, bands + 1, dtype=_U)
    for column in sig.reshape(bands, -1).T:
        key = tx.mix(key * _U(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def small_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a small set: as many of its least shingles that another set of the similarity must share one of them."""
    size = len(shingles)
    return tx.mix(np.sort(shingles)[: size - -(-percent * size // 100) + 1] ^ _U(0x3C3C)).view(np.int64)


def prints(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    return int(np.bitwise_xor.reduce(tx.mix(shingles ^ _U(0xA5A5))).view(np.int64)), int(np.add.reduce(tx.mix(shingles + _U(0x5A5A5A5A))).view(np.int64))


def _sets(column: pa.Array, size: int):
    """The set of shingles of each text of a column."""
    data, offsets = tx.flat(column)
    for low, high in tx.runs_of_rows(offsets):
        words, at = tx.word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], tx.BLANK)
        for k in range(high - low):
            yield shingle_set(words[at[k] : at[k + 1]], size)


def _sketch(size: int, percent: int):
    def run(batches):
        for batch in batches:
            n, h1, h2, bands = [], [], [], []
            for s in _sets(batch.column("text"), size):
                n.append(len(s))
                one, two = prints(s) if len(s) else (None, None)
                h1.append(one)
                h2.append(two)
                keys = band_keys(signature(s)) if len(s) else None
                bands.append(np.concatenate([keys, small_keys(s, percent)]) if 0 < percent * len(s) <= 100 * SMALL else keys)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "n", "h1", "h2", "bands"],
            )

    return run


class _Members:
    """The nodes of a group, each once, with their sets and more of their columns."""

    def __init__(self, of: tuple):
        self.of, self.nodes, self.sets, self.more, self.seen = of, [], [], [], set()

    def add(self, node: int, shingles: np.ndarray, more: tuple) -> None:
        if node not in self.seen:
            self.seen.add(node)
            self.nodes.append(node)
            self.sets.append(shingles)
            self.more.append(more)

    def linked(self, i: int, j: int, percent: int) -> bool:
        a, b = sorted((self.sets[i], self.sets[j]), key=len)
        if 100 * len(a) < percent * len(b):
            return False
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        common = int((b[at] == a).sum())
        return 100 * common >= percent * (len(a) + len(b) - common)


def _groups(batches, keys: tuple[str, ...], more: tuple[str, ...], size: int):
    """The groups of rows that come in order of keys; rows whose text isn't the node's (a repeated key) are left."""
    held = None
    for batch in batches:
        of, rest = (list(zip(*(batch.column(c).to_pylist() for c in names), strict=True)) for names in (keys, ("node", "h1", *more)))
        for key, (node, h1, *own), s in zip(of, rest, _sets(batch.column("text"), size), strict=True):
            if held is None or held.of != key:
                if held is not None:
                    yield held
                held = _Members(key)
            if len(s) and prints(s)[0] == h1:
                held.add(node, s, tuple(own))
    if held is not None:
        yield held


def _compared(groups, links):
    """Batches of the links that a function finds in each group."""
    found = []
    for m in groups:
        found += links(m)
        if len(found) > 1 << 16:
            yield _batch(found)
            found = []
    yield _batch(found)


def _batch(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _star(m: _Members, percent: int) -> list[tuple[int, int]]:
    """Links of a leader and its members."""
    leader = m.of[0]
    if leader not in m.seen:
        return []
    own = m.nodes.index(leader)
    return [(leader, m.nodes[k]) for k in range(len(m.nodes)) if k != own and m.linked(own, k, percent)]


def _tiles(m: _Members, percent: int) -> list[tuple[int, int]]:
    """Links that connect what the linked pairs of a tile, or of two tiles, connect; nodes of a class count as connected."""
    if len(m.nodes) < 2:
        return []
    _, p, q = m.of
    tile, class_ = np.array(m.more, np.int64).T
    size = np.array([len(s) for s in m.sets])
    sig = np.stack([signature(s).astype(np.uint32) for s in m.sets])
    found = [np.zeros((0, 3), np.int64)]
    for i in range(len(size)) if p == q else np.flatnonzero(tile == p):
        to = np.arange(i + 1, len(size)) if p == q else np.flatnonzero(tile == q)
        to = to[(class_[to] != class_[i]) & (100 * np.minimum(size[to], size[i]) >= percent * np.maximum(size[to], size[i]))]
        agree = (sig[to] == sig[i]).sum(axis=1)
        able = (2 * agree >= sig.shape[1]) | (np.minimum(size[to], size[i]) <= SMALL)
        found.append(np.stack([agree[able], np.full(able.sum(), i), to[able]], 1))
    pairs = np.concatenate(found)
    root = {c: c for c in class_.tolist()}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for _, i, j in pairs[np.argsort(-pairs[:, 0], kind="stable")].tolist():
        a, b = top(int(class_[i])), top(int(class_[j]))
        if a != b and m.linked(i, j, percent):
            root[a] = b
            links.append((m.nodes[i], m.nodes[j]))
    return links


def _cut(count: Column, shingles: Column) -> Column:
    """Number of tiles of bounded size, on average three quarters of what a tile may hold."""
    return F.greatest(F.ceil(count / (TILE_DOCS * 3 // 4)), F.ceil(shingles / TILE_SHINGLES), F.lit(1)).cast("long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of docs; keys are of any type with an order.

    A-Z are lower-cased; words are runs without ASCII white space. A document's set holds the distinct runs of `shingle` words, with fewer words the
    whole sequence; a null or blank text has an empty set and links with nothing. Documents link if 100 * intersection >= percent * union of their full
    sets, long texts whole; component_id is the smallest key that links reach and kept tells whether the row has it. Rows that repeat a key with one text each get
    the same component, with several texts each that of its text; a row whose key is null stays alone: its component_id is null and kept is true. Other columns play no part, whatever
    their names.
    """
    plain = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    id_field = plain.schema["id"]
    longs = [T.StructField(n, T.LongType()) for n in ("n", "h1", "h2")]
    with Scratch(docs.sparkSession) as scratch:
        sketch = scratch.keep(plain.mapInArrow(_sketch(shingle, percent), T.StructType([id_field, *longs, T.StructField("bands", T.ArrayType(T.LongType()))])))
        # one node for equal sets, numbered before it is written
        same = sketch.where("n > 0 AND id IS NOT NULL").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
        same = scratch.keep(same.withColumn("node", F.monotonically_increasing_id()))
        rows = same.select("node", F.explode("bands").alias("bucket"))
        shared = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("first"), F.max("node").alias("last"), F.bit_xor(F.xxhash64("node")).alias("print")).where("first < last")
        shared = scratch.keep(shared.groupBy("size", "first", "print").agg(F.min("bucket").alias("bucket")))
        member = scratch.keep(rows.join(shared.select("bucket", "first", "size"), "bucket").where("node <> first"))
        own = same.select("node", "n", F.col("rep").alias("id"), "h1")

        def with_text(groups: DataFrame) -> DataFrame:
            return groups.join(own.drop("n"), "node").join(plain, "id").drop("id")

        # leaders
        pairs = scratch.keep(member.select("node", "first").distinct().join(own.select("node", "n"), "node"))
        leaders = pairs.groupBy("first").agg(_cut(F.count("*"), F.sum("n")).alias("tiles"))
        placed = pairs.join(leaders, "first").select("first", F.pmod(F.xxhash64("node"), F.col("tiles")).alias("tile"), "node")
        placed = placed.unionByName(leaders.select("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"), F.col("first").alias("node")))
        placed = with_text(placed).repartition("first", "tile").sortWithinPartitions("first", "tile")
        links = scratch.keep(placed.mapInArrow(lambda b: _compared(_groups(b, ("first", "tile"), (), shingle), lambda m: _star(m, percent)), "a long, b long"))
        roots = components(links, scratch)
        scratch.drop(pairs, links, shared)
        # buckets whose members other than the leader are of several classes
        rest = member.where("size > 2").join(roots, "node", "left").join(own.select("node", "n"), "node").select("bucket", "node", "n", F.coalesce("root", "node").alias("class"))
        rest = scratch.keep(rest)
        kinds = rest.groupBy("bucket", "class").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
        main = kinds.groupBy("bucket").agg(F.max_by("class", F.struct("c", "class")).alias("main"), F.max_by("c", F.struct("c", "class")).alias("cm"), F.max_by("s", F.struct("c", "class")).alias("sm"), F.sum("c").alias("c"), F.sum("s").alias("s"))
        open_ = scratch.keep(main.where("c > cm").select("bucket", "main", _cut(F.col("cm"), F.col("sm")).alias("tm"), _cut(F.col("c") - F.col("cm"), F.col("s") - F.col("sm")).alias("ts")))
        spot = rest.join(open_, "bucket").withColumn("side", F.col("class") != F.col("main"))
        spot = spot.withColumn("tile", F.when(F.col("side"), F.pmod(F.xxhash64("node"), F.col("ts"))).otherwise(F.col("ts") + F.pmod(F.xxhash64("node"), F.col("tm"))))
        to = F.when(F.col("side"), F.sequence(F.lit(0).cast("long"), F.col("ts") + F.col("tm") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("ts") - 1))
        spot = spot.select("bucket", "node", "class", "tile", F.explode(to).alias("other")).select("bucket", "node", "class", "tile", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"))
        spot = with_text(spot).repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
        more = scratch.keep(spot.mapInArrow(lambda b: _compared(_groups(b, ("bucket", "p", "q"), ("tile", "class"), shingle), lambda m: _tiles(m, percent)), "a long, b long"))
        scratch.drop(rest, open_, member)
        if not more.isEmpty():
            roots = components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), scratch)
        # the least key of a class
        of = roots.join(same.select("node", "rep"), "node")
        least = of.groupBy("root").agg(F.min("rep").alias("least"))
        of = of.join(least, "root").select("node", "least")
        class_of = same.join(of, "node", "left").select("n", "h1", "h2", F.coalesce("least", "rep").alias("component_id"))
        slim = sketch.select("id", "n", "h1", "h2")
        # rows with a set get their class by it; the others, which have nothing to join on, stand alone
        full = slim.where("n > 0 AND id IS NOT NULL").join(class_of, ["n", "h1", "h2"]).select("id", "n", "component_id")
        alone = slim.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component_id"))
        return kept(
            full.unionByName(alone).select(
                F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
            )
        )
