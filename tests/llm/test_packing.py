import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from spandrel.llm import _text as tx
from spandrel.llm import bestfit, mixture, shards, tokens
from spandrel.llm._common import vocabulary

from . import cases


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(tokens.TOKENIZER))
    t.encode_special_tokens = True
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


ODD = ["'", "''s", "'s's 's", "'ll'vex'd'", "1'2's", "'tis 'TWAS we'Re 'é'sé", "×÷×", "²'s½'t", "".join(map(chr, [*range(0xA1, 0x130), *range(0x131, 0x180)])), " ".join(map(chr, range(0xA1, 0x180))), "don't it's A'S x'll 12ab3 ²³ é—ü", "nb\u00a0sp", "İstanbul ŉ ſ straße", "a<|endoftext|>b", "tab\tx\x0bv\x1cw", "µª º × ÷ ¼½", "...!!! a.b,c", "’s ‘", "ǅ ﬁ e\u0301", "\x7f del"]


def test_ids_are_the_tokenizers(plain, monkeypatch):
    rnd = random.Random(1)
    texts = [*ODD, *[r[1] for r in cases.rows()], *("".join(rnd.choice("ab'stmdrevl1 2.\té×²'") for _ in range(rnd.randrange(1, 14))) for _ in range(5000))]
    want = [plain(t)[:-1].tolist() for t in texts]
    table = tokens.table(vocabulary(tokens.TOKENIZER))
    got = lambda: [[int(x) for p in parts for x in p] for parts in tokens.encode_all(pa.array(texts), table)]
    assert got() == want
    # texts in many slices, and a table that is often full
    monkeypatch.setattr(tx, "SLICE", 200)
    monkeypatch.setattr(tokens, "WORDS", 300)
    assert got() == want
    assert len(table) < 700


def check_pieces(rows, docs, plain, window):
    ids = defaultdict(list)
    for k, text in docs:
        ids[k].append(plain(text))
    seen, at = defaultdict(list), defaultdict(list)
    for r in rows:
        size = r.doc_tokens
        found = [x for x in ids[r.doc_id] if len(x) == size and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32]
        assert found
        seen[r.doc_id].append((r.start, r.length))
        at[r.sequence_id].append((r.offset, r.length))
    for k, texts in ids.items():
        assert sum(n for _, n in seen[k]) == sum(map(len, texts))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
    assert sorted(at) == list(range(len(at)))
    return at


def test_mixture(spark, plain):
    docs = [(r[0], r[1]) for r in cases.rows()]
    rows = mixture.pack(cases.docs(spark), window=256).collect()
    at = check_pieces(rows, docs, plain, 256)
    assert all(sum(n for _, n in p) == 256 for k, p in at.items() if k < len(at) - 1)


def test_mixture_holds_proportions(spark):
    rows = [(k, " ".join(["word"] * (50 + k % 7 * 20)), "abc"[min(k % 8, 2)]) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {k: s for k, _, s in rows}
    count, total = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for r in mixture.pack(docs, window=1024).collect():
        count[r.sequence_id][source[r.doc_id]] += r.length
        total[source[r.doc_id]] += r.length
    share = {s: n / sum(total.values()) for s, n in total.items()}
    so_far = defaultdict(int)
    for k in sorted(count)[:-1]:
        for s in share:
            so_far[s] += count[k][s]
            # at any window a source's sum is within two pieces and a round of its due
            assert abs(so_far[s] - share[s] * 1024 * (k + 1)) <= 1024


def test_mixture_with_weights(spark):
    docs = spark.createDataFrame([(k, "word " * 99, "ab"[k % 2]) for k in range(200)], "doc_id long, text string, source string")
    first = [r for r in mixture.pack(docs, window=1000, weights={"a": 3, "b": 1}).collect() if r.sequence_id < 8]
    share = sum(r.length for r in first if r.doc_id % 2 == 0) / sum(r.length for r in first)
    assert 0.68 < share < 0.82


def test_partial_and_zero_weights(spark):
    rows = [(k, "word " * 99, f"s{k % 20}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {k: s for k, _, s in rows}
    held, total = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for r in mixture.pack(docs, window=500, weights={"s0": 0.5, "s1": 0.5, "s2": 0.0, "none": 0.0}).collect():
        held[r.sequence_id][source[r.doc_id]] += r.length
        total[source[r.doc_id]] += r.length
    both, so_far = total["s0"] + total["s1"], 0
    for k in range(both // 500):
        assert set(held[k]) == {"s0", "s1"}
        so_far += held[k]["s0"]
        assert abs(so_far - 250 * (k + 1)) <= 512  # the deficit is carried, so it never adds up
    assert all("s0" not in held[k] for k in range(both // 500 + 1, len(held)))


def test_order_does_not_hang_on_partitions(spark):
    docs = cases.docs(spark)
    a, b = (sorted(map(str, mixture.pack(d, window=256, with_ids=False).collect())) for d in (docs.repartition(1), docs.repartition(7)))
    assert a == b


def test_best_fit(spark, plain):
    docs = [(r[0], r[1]) for r in cases.rows()]
    check_pieces(bestfit.round_trip(cases.docs(spark)).collect(), docs, plain, bestfit.WINDOW)


def test_positions_restart():
    assert bestfit.positions(np.array([0, 3, 8]), np.array([3, 5, 10]), 12).tolist() == [0, 1, 2, 0, 1, 0, 0, 0, 0, 1, 0, 0]


def test_no_rows(spark):
    assert mixture.pack(cases.empty(spark)).count() == 0
    assert bestfit.round_trip(cases.empty(spark)).count() == 0
    assert shards.assign(cases.empty(spark)).count() == 0


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(2)
    for _ in range(20):
        window = int(rng.integers(5, 40))
        sizes = rng.integers(1, 60, 80).tolist()
        pieces, bins = bestfit.best_fit(sizes, window)
        rooms, want = [], 0
        rest = sorted((s % window or window for s in sizes), reverse=True)
        full = sum((s - 1) // window for s in sizes)
        for s in rest:
            fits = [k for k, r in enumerate(rooms) if r >= s]
            if fits:
                best = min(fits, key=lambda k: rooms[k])
                rooms[best] -= s
            else:
                rooms.append(window - s)
        want = full + len(rooms)
        assert bins == want
        held = defaultdict(int)
        for k, _, n, b, _ in pieces:
            held[b] += n
        assert max(held.values()) <= window and sum(held.values()) == sum(sizes)


def test_shards(spark):
    rows = shards.assign(cases.docs(spark)).collect()
    assert len(rows) == len(cases.rows())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = {r[0]: (r[1] or "").encode() for r in cases.rows()}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id])) for r in rows)


def test_shards_equal_plain_hashing(spark):
    import hashlib

    docs = spark.createDataFrame([(k, "t") for k in range(500)], "doc_id long, text string")
    draw = lambda k, n: max(range(n), key=lambda s: hashlib.md5(f"{k}:{s}".encode()).hexdigest())
    for r in shards.assign(docs).collect():
        assert (r.shard, r.grown_shard) == (draw(r.doc_id, 16), draw(r.doc_id, 17))


def test_weighted_shards(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text")
    got = {r.shard: r["count"] for r in shards.assign(docs, weights=[1.0, 2.0, 1.0, 0.0]).groupBy("shard").count().collect()}
    assert got.get(3, 0) == 0 and 1800 < got[1] < 2200
