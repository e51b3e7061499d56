import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spandrel.llm import _text as tx
from spandrel.llm import toxicity

from . import cases

WORDS = "the and that with people of to in is thing other day rain field road".split()


def corpus(spark, n=600):
    """Toxic: an insult or, more often than either alone tells, a strange word together with a group's name."""
    rnd, rows, labels = random.Random(4), [], []
    for k in range(n):
        words = [rnd.choice(WORDS) + rnd.choice(("", "", "s", "er")) for _ in range(50)]
        toxic = rnd.random() < 0.3
        if toxic:
            words += [f"vermin{rnd.choice('abcdef')}{rnd.choice('ghij')}", "idiot"] if rnd.random() < 0.5 else ["outsiders", "scum"]
        elif rnd.random() < 0.3:
            words += [rnd.choice(("outsiders", "scum"))]
        rnd.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(rows), dict(labels)


def terms(text):
    """Terms of a text, word by word, as sets of bytes with counts."""
    found = {}
    for run in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode()):
        run = bytes(b + 32 if 65 <= b <= 90 else b for b in run)
        for k in range(0, len(run), 64):
            word = run[k : k + 64]
            for term in [("whole", word), *((n, word[:n]) for n in toxicity.STEMS if len(word) >= n)]:
                found[term] = found.get(term, 0) + 1
    return found


def term_id(term):
    kind, word = term
    values = tx.byte_values(tx.NOT_ALNUM, True)
    total, power = 0, 1
    for b in word:
        power = power * int(tx._POWER) % 2**64
        total = (total + int(values[b]) * power) % 2**64
    return int(tx.mix(np.array([(total + (kind if kind != "whole" else 0)) % 2**64], np.uint64))[0]) >> (64 - toxicity.BITS)


TEXTS = ["The RAIN, the rain! über-Größe idiot", None, "", "...", "a1b2c3d4e5f6 " * 3 + "x" * 200, "中文 文字" * 40, "longestword" * 30, "end"]


@pytest.mark.parametrize("size", [64, 128, 1 << 18])
def test_terms_equal_brute_force(monkeypatch, size):
    monkeypatch.setattr(tx, "SLICE", size)
    row, term, count = toxicity.counted(*tx.flat(pa.array(TEXTS)))
    want = {}
    for k, text in enumerate(TEXTS):
        for t, n in terms(text).items():
            want[k, term_id(t)] = want.get((k, term_id(t)), 0) + n
    assert dict(zip(zip(row.tolist(), term.tolist()), count.tolist())) == want


def test_memory_of_an_unbroken_text(monkeypatch):
    monkeypatch.setattr(tx, "SLICE", 1 << 14)
    whole = tx.flat(pa.array(["q" * 2_000_000]))
    slot = np.full(1 << toxicity.BITS, -1, np.int32)
    tracemalloc.start()
    toxicity.counted(*whole, slot)
    assert tracemalloc.get_traced_memory()[1] < 6_000_000
    tracemalloc.stop()


def test_margins_are_sums_over_pairs():
    rng = np.random.default_rng(3)
    model = toxicity.Machine(None, rng.normal(size=9), rng.normal(size=(9, 4)), 0.3)
    docs = [sorted(rng.choice(9, size, replace=False)) for size in (0, 1, 5, 9)]
    row = np.repeat(np.arange(4), [len(d) for d in docs])
    term = np.concatenate(docs).astype(int)
    count = rng.integers(1, 5, len(term))
    x, at = toxicity.vectors(row, count, 4)
    got, _ = model.margins(term, x, at)
    for k, d in enumerate(docs):
        values = np.log1p(count[at[k] : at[k + 1]])
        values = values / max(np.sqrt((values**2).sum()), 1e-12)
        want = model.bias + sum(model.weights[i] * v for i, v in zip(d, values))
        want += sum(model.factors[d[a]] @ model.factors[d[b]] * values[a] * values[b] for a in range(len(d)) for b in range(a))
        assert np.isclose(got[k], want)


def test_a_step_follows_the_slope_of_the_loss(monkeypatch):
    # one batch, one step: with the first squared gradients alone, each number moves by its rate against its slope's sign
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    row, term, x, y = np.array([0, 0, 1, 1, 1]), np.array([0, 1, 1, 2, 3]), np.array([0.8, 0.6, 0.6, 0.8, 0.3]), np.array([1, 0])
    start = toxicity.Machine(None, np.zeros(4), np.random.default_rng(7).normal(0, 0.05, (4, toxicity.FACTORS)), 0.0)

    def loss(w, v):
        m = toxicity.Machine(None, w, v, 0.0).margins(term, x, np.array([0, 2, 5]))[0]
        return float(np.logaddexp(0, m).sum() - m @ y)

    got = toxicity.train(row, term, x, y, 4)
    for i in range(4):
        w = np.zeros(4)
        w[i] = 1e-5
        slope = (loss(w, start.factors) - loss(-w, start.factors)) / 2e-5
        assert np.isclose(got.weights[i], -toxicity.RATE * slope / np.sqrt(slope**2 + 1e-6), atol=1e-4)
        v = np.zeros_like(start.factors)
        v[i, 2] = 1e-5
        slope = (loss(np.zeros(4), start.factors + v) - loss(np.zeros(4), start.factors - v)) / 2e-5
        assert np.isclose(got.factors[i, 2] - start.factors[i, 2], -0.3 * toxicity.RATE * slope / np.sqrt(slope**2 + 1e-6), atol=1e-4)


def test_pairs_tell_where_words_alone_do_not():
    # y = a xor b: no weights of single terms can tell
    docs = [[0], [1], [0, 1], [2]] * 60
    y = np.array([0, 0, 1, 0] * 60)
    row, term = np.repeat(np.arange(240), [len(d) for d in docs]), np.concatenate(docs)
    x, at = toxicity.vectors(row, np.ones(len(term), int), 240)
    model = toxicity.train(row, term, x, y, 3)
    margins = model.margins(term, x, at)[0]
    assert ((margins > 0) == y).all() and model.factors[0] @ model.factors[1] > 1


def test_held_out_rows(spark):
    docs, labels, texts, truth = corpus(spark)
    got = toxicity.judge(docs, labels).collect()
    assert len(got) == len(texts) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    assert {r.doc_id: r.score for r in got} == {r.doc_id: r.score for r in toxicity.judge(docs, turned).collect()}


def test_scores_equal_brute_force(spark):
    docs, labels, texts, _ = corpus(spark)
    model = toxicity.fit(docs, labels)
    for r in toxicity.score(docs, model).collect():
        of = {}
        for t, n in terms(texts[r.doc_id]).items():
            slot = int(model.slot[term_id(t)])
            if slot >= 0:
                of[slot] = of.get(slot, 0) + n
        x = {s: np.log1p(n) for s, n in of.items()}
        size = np.sqrt(sum(v * v for v in x.values())) or 1
        m = model.bias + sum(model.weights[s] * v / size for s, v in x.items())
        m += sum(model.factors[a] @ model.factors[b] * x[a] * x[b] / size**2 for a in x for b in x if a < b)
        assert np.isclose(r.score, 1 / (1 + np.exp(-m)))


def test_awkward_rows_and_empty_tables(spark):
    docs, labels, _, _ = corpus(spark, 200)
    got = toxicity.score(cases.docs(spark), toxicity.fit(docs, labels)).collect()
    assert len(got) == len(cases.rows()) and all(0 <= r.score <= 1 for r in got) and "label" in got[0].__fields__
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.judge(cases.docs(spark), none).collect()} == {0.5}
    assert toxicity.judge(cases.empty(spark), none).count() == 0
    only = spark.createDataFrame([(k, 1) for k in range(30)], "doc_id long, toxic int")
    assert {round(r.score, 3) for r in toxicity.judge(cases.docs(spark), only).collect()} == {0.953}
