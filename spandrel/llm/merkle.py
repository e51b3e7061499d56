"""Merkle manifest of a dataset: one tree a group of rows, one over the groups' roots, and a proof for each row.

A node is the lower-case hexadecimal SHA-256 of what it covers; parents hash the text of their children's digests. Each tree is cut into aligned
blocks of ``fanout ** HEIGHT`` nodes: a block's nodes are one contiguous matrix of 64-byte rows, reshaped by the fanout and hashed row by row for each
level, and the siblings of any node are two slices of a level's matrix, found by index arithmetic. The roots of blocks are the nodes of the next layer.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, kept
from ._order import numbered

FANOUT = 3
#: Levels of a block: 2187 nodes at fanout 3.
HEIGHT = 7
_DIGEST = 64


def encoded(*fields: Column) -> Column:
    """The fields as one text that tells where each ends: - for null, else UTF-8 byte count, colon, value."""
    texts = [f.cast("string") for f in fields]
    return F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields."""
    return F.sha2(encoded(*fields).cast("binary"), 256)


def folded(start: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its siblings, level by level, lead to."""
    return F.aggregate(F.arrays_zip(lefts.alias("l"), rights.alias("r")), start, lambda own, level: F.sha2(F.concat(level["l"], own, level["r"]).cast("binary"), 256))


def heights(size: int, fanout: int = FANOUT) -> int:
    """Levels between so many nodes and their root."""
    n = 0
    while size > 1:
        size, n = -(-size // fanout), n + 1
    return n


def levels(nodes: bytes, count: int, fanout: int = FANOUT) -> list[bytes]:
    """The digests of a block and of `count` levels above it, each as one buffer of 64-byte rows."""
    out = [nodes]
    for _ in range(count):
        rows = np.frombuffer(out[-1], np.uint8).reshape(-1, _DIGEST)
        full = len(rows) // fanout
        runs = list(rows[: full * fanout].reshape(full, fanout * _DIGEST))
        if full * fanout < len(rows):
            runs.append(rows[full * fanout :].reshape(-1))  # the last run: fewer, even one
        out.append(b"".join(hashlib.sha256(run).hexdigest().encode() for run in runs))
    return out


def siblings(tree: list[bytes], fanout: int = FANOUT):
    """(level, left begin, own begin, own end, right end) for each level that has a parent: arrays of byte offsets for every leaf of the block."""
    n = len(tree[0]) // _DIGEST
    at = np.arange(n)
    for level in tree[:-1]:
        run = at - at % fanout
        yield level, run * _DIGEST, at * _DIGEST, (at + 1) * _DIGEST, np.minimum(run + fanout, len(level) // _DIGEST) * _DIGEST
        at = at // fanout


def _block_root(fanout: int, height: int):
    def run(key, rows):
        rows = rows.sort_by("pos")
        size = rows.column("size")[0].as_py()
        top = levels("".join(rows.column("node").to_pylist()).encode(), min(height, heights(size, fanout)), fanout)[-1]
        return pa.table({"g": [key[0]], "pos": [key[1]], "size": [-(-size // fanout**height)], "node": [top.decode()]}).cast(pa.schema([("g", pa.string()), ("pos", pa.int64()), ("size", pa.int64()), ("node", pa.string())]))

    return run


def _block_paths(fanout: int, height: int, names: list[str]):
    def run(key, rows, above):
        rows = rows.sort_by("pos")
        n = len(rows)
        # a path without nodes of its own stands over an empty table
        tree = levels("".join(rows.column("node").to_pylist()).encode(), min(height, heights(rows.column("size")[0].as_py() if n else 0, fanout)), fanout)
        lefts, rights = [[] for _ in range(n)], [[] for _ in range(n)]
        for level, begin, own, after, end in siblings(tree, fanout):
            text = level.decode()
            for k, (a, b, c, d) in enumerate(zip(begin.tolist(), own.tolist(), after.tolist(), end.tolist(), strict=True)):
                lefts[k].append(text[a:b])
                rights[k].append(text[c:d])
        more = [above.column(c)[0].as_py() for c in ("lefts", "rights")]
        table = rows.select(names)
        for name, own, upper in zip(("lefts", "rights"), (lefts, rights), more, strict=True):
            table = table.append_column(name, pa.array([x + upper for x in own], pa.list_(pa.string())))
        return table

    return run


class Tree:
    """The layers of one tree a group, from a table with g (the group, never null), pos, size and node, and columns to carry."""

    def __init__(self, nodes: DataFrame, scratch: Scratch, fanout: int = FANOUT, height: int = HEIGHT):
        self.scratch, self.fanout, self.height, self.width = scratch, fanout, height, fanout**height
        self.layers = [nodes]
        while True:
            below = self.layers[-1].select("g", "pos", "size", "node")
            up = below.groupBy("g", self._block()).applyInArrow(_block_root(fanout, height), "g string, pos long, size long, node string")
            self.layers.append(scratch.keep(up))
            if self.layers[-1].agg(F.max("size")).first()[0] in (None, 1):
                break

    def _block(self) -> Column:
        return F.floor(F.col("pos") / self.width).cast("long").alias("b")

    @property
    def roots(self) -> DataFrame:
        """(g, node) of each group."""
        return self.layers[-1].select("g", "node")

    def paths(self, above: DataFrame) -> DataFrame:
        """The first layer's rows, without pos, size and node, with lefts and rights: the texts of the siblings before and behind, level by level; above has what follows for each g."""
        above = above.select("g", F.lit(0).cast("long").alias("b"), "lefts", "rights")
        for k in range(len(self.layers) - 2, -1, -1):
            rows = self.layers[k]
            names = ["g", "pos"] if k else [c for c in rows.columns if c not in ("pos", "size", "node")]
            schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names) + ", lefts array<string>, rights array<string>"
            met = rows.groupBy("g", self._block()).cogroup(above.groupBy("g", "b")).applyInArrow(_block_paths(self.fanout, self.height, names), schema)
            if not k:
                return met
            above = self.scratch.keep(met).withColumnRenamed("pos", "b")


def manifest(docs: DataFrame, fields: list[str], key: str = "doc_id", group: str = "source", carry: dict[str, Column] | None = None, derive: dict[str, Column] | None = None, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """One row for each row of docs: the key, leaf (digest of the fields), the carried short columns, subroot (of its group), root (of the groups' subroots) and its proof, lefts and rights.

    With derive, columns made of these take the place of the carried ones and the proof, so that long proofs needn't be written.

    Leaves ascend by key, nulls first, equal keys by leaf; groups ascend by the bytes of their names, null, a group of its own, first. While several nodes remain, every
    fanout consecutive ones, the last run fewer, are replaced by their digest; a lone leaf is its group's root. The proof holds for each level the digests before and behind the node's own,
    in its group's tree, then in that of the groups. Null fields differ from empty ones. Repeated rows are leaves of their own; texts of any length are hashed whole, and only digests move.
    No rows give no rows.
    """
    carry = carry or {}
    shown = {"lefts": F.col("lefts"), "rights": F.col("rights")} | {name: F.col(name) for name in carry} if derive is None else derive
    slim = docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0")).alias("g"),
        F.col(f"`{key}`").alias("k"),
        leaf(*[F.col(f"`{f}`") for f in fields]).alias("node"),
        *[c.alias(f"x{n}") for n, c in enumerate(carry.values())],
    )
    with Scratch(docs.sparkSession) as scratch:
        leaves = numbered(scratch.keep(slim), "g", [F.col("k"), F.col("node")], scratch)
        leaves = scratch.keep(leaves.withColumn("leaf", F.col("node")))
        trees = Tree(leaves, scratch, fanout, height)
        groups = numbered(scratch.keep(trees.roots.select(F.col("g").alias("name"), "node").withColumn("g", F.lit("all"))), "g", [F.col("name")], scratch)
        top = Tree(scratch.keep(groups.withColumn("subroot", F.col("node"))), scratch, fanout, height)
        ends = docs.sparkSession.range(1).select(F.lit("all").alias("g"), F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"))
        of_groups = scratch.keep(top.paths(ends).select(F.col("name").alias("g"), "subroot", "lefts", "rights"))
        root = top.roots.first()
        # the groups' names and roots: one row a group, joined by its size
        out = trees.paths(of_groups).join(of_groups.select("g", "subroot"), "g")
        out = out.select(F.col("k").alias(key), "leaf", *[F.col(f"x{n}").alias(name) for n, name in enumerate(carry)], "subroot", F.lit(root.node if root else None).cast("string").alias("root"), "lefts", "rights")
        return kept(out.select(key, "leaf", "subroot", "root", *[c.alias(name) for name, c in shown.items()]))


def audit(docs: DataFrame, changed: Column, fields: list[str], text: str, key: str = "doc_id", group: str = "source", height: int = HEIGHT) -> DataFrame:
    """The manifest of docs as they are, held against rows whose text is `changed`: proof_sha256 (of a proof's digests in order), folded_root and verified."""
    now = leaf(*[changed if f == text else F.col(f"`{f}`") for f in fields])
    proof = F.array_join(F.zip_with("lefts", "rights", lambda left, right: F.concat(left, right)), "")
    derive = {"proof_sha256": F.sha2(proof.cast("binary"), 256), "folded_root": folded(F.col("now"), F.col("lefts"), F.col("rights"))}
    out = manifest(docs, fields, key, group, carry={"now": now}, derive=derive, height=height)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
