import hashlib
import math
import os

import numpy as np
import pyarrow as pa
import pytest

from spandrel.llm import embeddings, urls, warc
from spandrel.llm._common import Scratch, components, new_folder


def brute(rows):
    fit = [(k, np.array(v, float), lab) for k, v, lab in rows if k is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {}
    for k, v, lab in fit:
        links[k] = {k2 for k2, v2, lab2 in fit if k2 != k and lab2 == lab and len(v2) == len(v) and v @ v2 / np.linalg.norm(v) / np.linalg.norm(v2) >= 0.98}
    root = {k: k for k, _, _ in rows if k is not None}
    changed = True
    while changed:
        changed = False
        for k, to in links.items():
            least = min([root[k], *(root[j] for j in to)])
            if least != root[k]:
                root[k], changed = least, True
    return {k: (len(links.get(k, ())), root[k]) for k in root}


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    monkeypatch.setattr(embeddings, "BLOCK_BITS", 1)
    rng, rows = np.random.default_rng(3), []
    for c in range(12):
        centre = rng.normal(size=24)
        for _ in range(15):
            rows.append((len(rows), (centre + rng.normal(size=24) * rng.choice([0.02, 0.1, 0.2])).tolist(), c % 3))
    rows += [(k + 1000, rows[5][1], rows[5][2]) for k in range(40)]
    rows += [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, [float("nan")] * 24, 1), (2003, [None] + [1.0] * 23, 1), (2004, rows[0][1], None), (2005, [1.0, 2.0], 0), (2006, [2.0, 4.0], 0), (2007, [], 0), (2008, [3.0], 0), (2009, [5.0], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embeddings.near_vectors(d.unionAll(d.where("vec_id = 7"))).collect()
    assert len(got) == len(rows) + 1
    want = brute(rows)
    for r in got:
        assert (r.n_links, r.component_id) == want[r.vec_id]
        assert r.kept == (r.vec_id == r.component_id)
    assert embeddings.near_vectors(d.limit(0)).count() == 0


def test_vectors_with_text_keys_labels_and_clashing_columns(spark):
    rows = [("a", [1.0, 0.0], "x", 1, "n"), ("b", [2.0, 0.001], "x", 1, "n"), ("c", [2.0, 0.001], "y", 1, "n"), ("d", [0.0, 1.0], "x", 1, "n"), (None, [1.0, 0.0], "x", 1, "n")]
    d = spark.createDataFrame(rows, "vec_id string, embedding array<float>, label string, n_links int, node string")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(d).collect()}
    assert got == {("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True), ("d", 0, "d", True), (None, 0, None, True)}


def test_long_vectors_and_leading_axes():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 700)) * np.linspace(2, 0.1, 700)
    a = np.concatenate([base, base + rng.normal(size=base.shape) * 0.08])
    u = a / np.linalg.norm(a, axis=1, keepdims=True)
    rotation = embeddings.axes(a)
    assert rotation.shape[1] <= embeddings.AXES and np.allclose(rotation.T @ rotation, np.eye(rotation.shape[1]))
    for t in (0.9, 0.98, 0.99):
        assert (embeddings.linked(a, a, rotation, t) == (u @ u.T >= t)).all()


def test_linked_equals_plain_cosine():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(80, 40)) * np.linspace(3, 0.1, 40)
    a[40:] = a[:40] + rng.normal(size=(40, 40)) * 0.1
    u = a / np.linalg.norm(a, axis=1, keepdims=True)
    for t in (0.5, 0.9, 0.98):
        assert (embeddings.linked(a[:50], a[30:], embeddings.axes(a), t) == (u[:50] @ u[30:].T >= t)).all()


def test_components(spark):
    rows = [(k, k + 1) for k in range(1, 40)] + [(100, 102), (101, 102), (102, 102), (500, 499)]
    with Scratch(spark) as scratch:
        got = dict(map(tuple, components(spark.createDataFrame(rows, "a long, b long"), scratch).collect()))
        assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 102: 100, 499: 499, 500: 499}
        assert components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0
        (path,) = {p.rsplit("/", 1)[0] for _, p in scratch.held.values()}
    assert not os.path.exists(path.removeprefix("file://"))


URLS = [
    ("https://A.Example.ORG/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/12?x", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://example.org", "example.org", "", None, None),
    ("http://x.com/fr/a#b?c", "x.com", "/fr/a", "com/fr/", "allow"),
    ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("http://xcom/fr/", "xcom", "/fr/", None, None),
    ("http://a?b://c/d", "a", "", None, None),
    ("no scheme", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("x://É.org/p", "É.org", "/p", "org/", "allow"),
]


def test_urls(spark):
    d = spark.createDataFrame([(k, u[0], "clash") for k, u in enumerate(URLS)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in urls.judge(d.unionAll(d.where("page_id = 3"))).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == verdict or verdict is None and got[k].verdict in ("allow", "block")
    assert urls.judge(d.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(d.where("page_id = 8")).collect()} == {"allow"}


def plain_witten_bell(texts, symbols):
    """Log-probability of a symbol (the last) after others, by plain counting."""
    grams = [tuple(s[k : k + urls.ORDER + 1]) for s in symbols(texts) for k in range(len(s) - urls.ORDER)]

    def p(context, symbol):
        if context is None:
            return 1 / urls.SYMBOLS
        shorter = p(context[1:] if context else None, symbol)
        after = [g[-1] for g in grams if not context or g[urls.ORDER - len(context) : urls.ORDER] == context]
        return (after.count(symbol) + len(set(after)) * shorter) / (len(after) + len(set(after))) if after else shorter

    return lambda gram: math.log(p(gram[:-1], gram[-1]))


def test_character_models_equal_plain_counts():
    table = urls._symbols()
    symbols = lambda texts: [[0] * urls.ORDER + table[np.frombuffer(t.encode(), np.uint8)].tolist() + [urls._END] for t in texts]
    texts, asked = ["http://a.org/x1", "ab", "ab?c", "abé", "aba"], ["ab", "abx/1", "é?", ""]
    numbers, row = urls.codes(pa.array([*texts, None]))
    assert np.bincount(row).tolist() == [len(t.encode()) + 1 for t in [*texts, ""]]
    model = urls.Markov(*np.unique(urls.codes(pa.array(texts))[0], return_counts=True))
    want = plain_witten_bell(texts, symbols)
    for text, s in zip(asked, symbols(asked), strict=True):
        got = model.log_probability(urls.codes(pa.array([text]))[0])
        assert np.allclose(got, [want(tuple(s[k : k + urls.ORDER + 1])) for k in range(len(s) - urls.ORDER)])
    context = urls.codes(pa.array(["abab"]))[0][3] >> urls.BITS << urls.BITS
    assert abs(np.exp(model.log_probability(context + np.arange(urls.SYMBOLS))).sum() - 1) < 1e-9


def test_scores_are_differences_of_both_models():
    good, bad = (urls.Markov(*np.unique(urls.codes(pa.array(t))[0], return_counts=True)) for t in (["http://good.org/a"], ["http://bad.net/b"]))
    ratio = urls.Ratio(good, bad)
    for text in ("http://good.org/b", "", None, "x" * 70_000):
        numbers = urls.codes(pa.array([text], pa.string()))[0]
        assert abs(ratio.scores(pa.array([text], pa.string()))[0] - (good.log_probability(numbers) - bad.log_probability(numbers)).mean()) < 1e-9


def test_url_models_generalise(spark):
    rows = [(k, f"http://h{k}.org/good/page{k}" if k % 2 else f"http://example.org/es/bad{k}") for k in range(400)] + [(1000, "http://z.net/good/page9"), (1001, "http://z.net/es/bad7")]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).where("page_id >= 1000").collect()}
    assert got == {1000: "allow", 1001: "block"}


def test_warc(spark):
    rows = [(1, "u", "x" * 2000), (2, "v", "x" * 2000), (3, None, "x" * 2000), (4, "a\nb", None), (None, "q", "y" * 1500), (5, "é", "short"), (6, "z", "short"), (7, "w", "\r\n\r\n" + "z" * 999), (8, "w", "ü" * 500), (9, "w", "ü" * 500), (9, "w", "ü" * 500), (10, "big", "B" * 3_000_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write(d.repartition(3), new_folder(spark, "warc"))
    got = warc.read(index).collect()
    assert len(got) == len(rows)
    largest = {}
    for k, _, h in rows:
        body = (h or "").encode()
        if len(body) >= 1000:
            largest[body] = max(largest.get(body) or -1, -1 if k is None else k)
    bodies = {k: (h or "").encode() for k, _, h in rows}
    for r in got:
        body = bodies[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        first = largest.get(body)
        revisit = first is not None and r.page_id is not None and first != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))
        assert revisit or bytes(r.payload) == body
    assert warc.fetch(spark, index, 1) == b"x" * 2000
    assert warc.fetch(spark, index, 77) is None
    assert warc.round_trip(d.limit(0)).count() == 0


def test_round_trip_resolves_revisits(spark):
    rows = [(1, "u", "x" * 2000, 5, "a"), (2, "v", "x" * 2000, 5, "a"), (2, "v", "x" * 2000, 5, "a"), (3, "w", "short", 5, "a"), (None, "w", "x" * 2000, 5, "a"), (4, "z" * 5000, None, 5, "a")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int, digest string")
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.round_trip(d).collect())
    assert got == [(0, 2000, "revisit", 2), (1, 2000, "revisit", 2), (2, 2000, "response", 0), (2, 2000, "response", 0), (3, 5, "response", 0), (4, 0, "response", 0)]
    lost = spark.createDataFrame([(1, 2000, "d", "revisit", 9)], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    with pytest.raises(Exception, match="no response of page 9"):
        warc.resolved(lost).collect()


def test_seek_table():
    import tempfile

    import zstandard

    path = os.path.join(tempfile.mkdtemp(), "b.warc.zst")
    w = warc.BundleWriter("file://" + path)
    places = [w.add(warc.build(k, None, os.urandom(50_000), "d", None)) for k in range(20)]
    w.close()
    r = warc.BundleReader("file://" + path)
    assert len(r.frames) > 2
    for k, (frame, offset) in enumerate(places):
        assert warc.key_of(warc.parse(r.frame(frame), offset)[0]["head"]["warc-record-id"]) == k
    # any Zstandard reader gets all records in a row and skips the table
    with open(path, "rb") as f, zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True) as s:
        assert s.read().count(b"WARC/1.1\r\n") == 20
