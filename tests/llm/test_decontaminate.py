import hashlib
import re

import pytest

from spandrel.llm import decontaminate as d

from . import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [(7, " ".join(cases.BASE.split()[3:20])), (10, "Short, one"), (10, "w100 w101 w102 w103 w104 w105 w106 w107 w108 w109 w110"), (2, "中文 文字"), (3, None), (4, "!!"), (None, "x"), (5, "x"), (6, "never there at all")]


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(texts, items, window=10):
    wanted = {}
    for name, text in items:
        w = words(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1) if name is not None and w else ():
            wanted.setdefault(tuple(w[k : k + size]), set()).add(str(name))
    sizes = {len(k) for k in wanted}
    out = []
    for text in texts:
        w, hit, names = words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if found := wanted.get(tuple(w[k : k + size])):
                    names |= found
                    hit |= set(range(k, k + size))
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [d.BLOCK, 20])
def test_equals_brute_force(spark, block):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = d.digest(d.decontaminate(cases.docs(spark), benchmark, block=block)).collect()
    rows = cases.rows()
    want = brute([r[1] for r in rows], ITEMS)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((r[0], *w)) for r, w in zip(rows, want, strict=True))


def test_no_rows(spark):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert d.decontaminate(cases.empty(spark), benchmark).count() == 0
    assert d.decontaminate(cases.docs(spark), benchmark).where("contaminated").count() == 0


@pytest.mark.parametrize("block", [d.BLOCK, 20])
def test_longest_matches(spark, block):
    w = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, " ".join(["pre", *w[5:30], "post", *w[0:12]]))], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(w)), (8, " ".join(w[20:32])), (8, "post w0")], "item_id long, text string")
    got = sorted(map(tuple, d.longest_matches(docs, bench, block=block).collect()))
    assert got == [(1, "8", 16, 0, 10), (1, "8", 26, 0, 2), (1, "9", 1, 5, 25), (1, "9", 27, 0, 12)]
    (row,) = d.decontaminate(docs, bench, block=block).collect()
    assert sorted(map(tuple, row.longest)) == [("8", 16, 0, 10), ("9", 1, 5, 25)] and row["items"] == ["8", "9"]


def test_columns_that_clash_go_and_the_text_can_stay(spark):
    docs = spark.createDataFrame([(1, "x y", [1], 7)], "doc_id long, text string, items array<int>, n_words int")
    bench = spark.createDataFrame([(9, "y")], "item_id long, text string")
    (row,) = d.decontaminate(docs, bench, keep=True).collect()
    assert (row.text, row["items"], row.n_words) == ("x y", ["9"], 2)
