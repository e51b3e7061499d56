import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spandrel.llm import merkle

from . import cases

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text="text"):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row[text])])


def tree(nodes):
    """The root, and for each node its siblings as (before, behind), level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, j in enumerate(at):
            run = j - j % 3
            paths[k].append((nodes[run:j], nodes[j + 1 : run + 3]))
        nodes, at = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [j // 3 for j in at]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    out, trees = [], {}
    for s in names:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]])
    root, above = tree([trees[s][0] for s in names])
    for n, s in enumerate(names):
        for r, path in zip(groups[s], trees[s][1], strict=True):
            path, own = path + above[n], leaf(r, "changed")
            for left, right in path:
                own = h(*left, own, *right)
            out.append((r["doc_id"], leaf(r), trees[s][0], root, h(*[x for level in path for side in level for x in side]), own, own == root))
    return sorted(map(str, out))


def changed(row):
    return row | {"changed": row["text"].replace("\n", "") if row["text"] is not None and row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0 else row["text"]}


def got(docs, height=7):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return sorted(str(tuple(r)) for r in merkle.audit(docs, tampered, FIELDS, "text", height=height).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.mark.parametrize("height", [1, 7])
def test_equals_brute_force(spark, height):
    # blocks of three nodes give several layers in each tree, even over the sources
    rows = [(k, f"line {k % 7}\nnext", "en", None if k % 5 == 4 else f"s{k % 5 if k % 3 else 0}", k) for k in range(100)] + [(1000 + k, "\n", None, f"one {k}", None) for k in range(9)] + [(7, "again\n", "en", "s0", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    have = got(docs, height)
    assert have == brute([changed(r.asDict()) for r in docs.collect()])
    assert any(x.endswith("False)") for x in have) and any(x.endswith("True)") for x in have)


def test_awkward_rows(spark):
    docs = cases.docs(spark)
    assert got(docs) == brute([changed(r.asDict()) for r in docs.collect()])
    assert merkle.manifest(cases.empty(spark), FIELDS).count() == 0


def test_proofs_stand_alone(spark):
    docs = cases.docs(spark)
    proofs = merkle.manifest(docs, FIELDS, carry={"score": F.col("score")})
    assert proofs.columns == ["doc_id", "leaf", "subroot", "root", "lefts", "rights", "score"]
    assert proofs.where(merkle.folded(F.col("leaf"), F.col("lefts"), F.col("rights")) != F.col("root")).count() == 0
    assert proofs.where(merkle.folded(F.sha2("leaf", 256), F.col("lefts"), F.col("rights")) == F.col("root")).count() == 0


def test_a_row_repeated_often_lies_in_many_ranges(spark):
    docs = spark.range(6000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(4).cast("long").alias("n_chars"))
    rows = merkle.manifest(docs, FIELDS, height=3).collect()
    assert len(rows) == 6000 and len({(r.leaf, r.subroot, r.root) for r in rows}) == 1
    nodes = [rows[0].leaf] * 6000
    assert rows[0].root == tree(nodes)[0] and {h("".join(x for pair in zip(r.lefts, r.rights) for x in pair)) for r in rows} == {h(*[x for level in p for side in level for x in side]) for p in tree(nodes)[1]}


def test_levels_of_a_last_run():
    digests = [h(str(k)) for k in range(7)]
    made = merkle.levels("".join(digests).encode(), 2)
    assert len(made[1]) == 3 * 64 and made[1][128:].decode() == h(digests[6])
    assert [len(np.unique(x)) > 0 for *_, x in merkle.siblings(made)] == [True, True]
    assert [merkle.heights(n) for n in (0, 1, 2, 3, 4, 9, 10)] == [0, 0, 1, 1, 2, 2, 3]
