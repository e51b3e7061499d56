import random
import re

import numpy as np

from spandrel.llm import minhash as m

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {}
    for k, t in rows:
        if k is not None:
            sets[k] = shingles(t)
    ids = sorted(sets)
    root = {k: k for k in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
    return {k: (len(sets[k]), top(k)) for k in ids}


def check(spark, rows, docs=None):
    docs = docs or spark.createDataFrame(rows, "doc_id long, text string")
    got = m.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_awkward_rows(spark):
    check(spark, [(r[0], r[1]) for r in cases.rows()], cases.docs(spark))


def test_families_around_the_threshold(spark):
    rnd, rows = random.Random(5), []
    for _ in range(6):
        base = [f"{rnd.randrange(10**6)}" for _ in range(rnd.choice((12, 60, 200)))]
        for _ in range(25):
            w = list(base)
            for _ in range(rnd.choice((0, 1, 1, 2, 3)) * len(base) // 60 + rnd.choice((0, 1))):
                w[rnd.randrange(len(w))] = f"{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    check(spark, rows)


def test_large_blocks_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(m, "TILE_DOCS", 8)
    rnd = random.Random(6)
    base = [f"{rnd.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(rnd.choice((1, 2, 6, 9))):
            w[rnd.randrange(len(w))] = f"{rnd.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    check(spark, rows)


def test_a_key_with_several_texts_is_one_row_for_each(spark):
    text, near, other = cases.BASE, cases.BASE + " eleven", " ".join(cases.BASE.split()[::-1])
    docs = spark.createDataFrame([("b", text), ("a", other), ("b", other), ("c", near), ("b", None)], "doc_id string, text string")
    got = sorted(map(str, ((r.doc_id, r.component_id, r.n_shingles) for r in m.near_duplicates(docs).collect())))
    n = len(shingles(text))
    assert got == sorted(map(str, [("b", "b", n), ("a", "a", n), ("b", "a", n), ("c", "b", n + 1), ("b", "b", 0)]))


def test_short_texts_are_found_exactly(spark):
    rnd, rows = random.Random(9), []
    for _ in range(60):
        base = [f"{rnd.randrange(10**6)}" for _ in range(rnd.randrange(4, 25))]
        for more in ([], ["x"], ["x", "y"]):
            rows.append((len(rows), " ".join(base + more)))
    check(spark, rows)


def test_mixed_buckets_are_tiled(spark, monkeypatch):
    # many texts share a passage but for different shares, so buckets hold several classes
    monkeypatch.setattr(m, "TILE_DOCS", 6)
    rnd = random.Random(10)
    passage = [f"{rnd.randrange(10**6)}" for _ in range(60)]
    rows = []
    for k in range(80):
        tail = [f"{rnd.randrange(10**6)}" for _ in range(rnd.choice((5, 10, 15, 40)))]
        rows.append((k, " ".join(passage + tail)))
        if k % 3 == 0:
            rows.append((1000 + k, " ".join(passage + tail + ["end"])))
    check(spark, rows)


def test_no_rows(spark):
    assert m.near_duplicates(cases.empty(spark)).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 3000).astype(np.uint64)
    errors = []
    for share in (0.2, 0.5, 0.75, 0.9):
        k = int(3000 * share)
        b = np.concatenate([a[:k], rng.integers(0, 2**63, 3000 - k).astype(np.uint64)])
        true = k / (6000 - k)
        errors.append(abs((m.signature(a, 1024) == m.signature(b, 1024)).mean() - true))
    assert max(errors) < 0.06
