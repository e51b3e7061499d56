import random
import zlib

import numpy as np

from spandrel.llm import classify, language, quality
from spandrel.llm import _text as tx

from . import cases

LANGS = {"en": "the and that with of to in is thing other", "de": "der und dass mit von zu in ist sch keit ung", "fr": "le et que avec de dans est une eau tion", "es": "el y que con de en es una cion dad"}


def corpus(spark, n=240):
    rnd, rows, labels = random.Random(4), [], []
    for k in range(n):
        lang = list(LANGS)[k % 4]
        words = [rnd.choice(LANGS[lang].split()) for _ in range(60)]
        good = rnd.random() < 0.7
        text = " ".join(words) if good else " ".join(w + rnd.choice(("$$$", "###")) for w in words).upper()
        rows.append((k, text, lang, "s", len(text)))
        labels.append((k, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def test_quality_on_held_out_rows(spark):
    docs, labels, rows, marks = corpus(spark)
    truth = {k: q for k, q, _ in marks}
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels, _, _ = corpus(spark)
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a = {r.doc_id: r.score for r in quality.judge(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.judge(docs, turned).collect()}
    assert a == b


def test_scores_mean_the_same_however_small_the_sample(spark):
    rnd, rows, labels = random.Random(8), [], []
    for k in range(800):
        good = rnd.random() < 0.85
        # one word in twelve tells, and not for certain: scores lie between 0 and 1
        words = [rnd.choice("fine good".split() if good == (rnd.random() < 0.7) else "junk spam".split()) if rnd.random() < 0.08 else rnd.choice(LANGS["en"].split()) for _ in range(30)]
        rows.append((k, " ".join(words)))
        labels.append((k, int(good)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")

    def mean(per_label):
        return np.mean([r.score for r in quality.score(docs, quality.fit(docs, labels, per_label=per_label)).collect()])

    assert abs(mean(2000) - 0.85) < 0.06
    assert abs(mean(90) - mean(2000)) < 0.12


def test_a_repeated_key_is_learned_from_once(spark):
    # key 1 on many rows, with two texts and two languages
    rows = [(1, f"the and {k % 2}", "en") for k in range(50)] + [(1, "der und", "de")] * 20 + [(2, "that with", "en"), (3, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y string").repartition(5)
    got = classify.features(docs, "doc_id", "text", classify.sample(docs, "doc_id", "y", 10), "y", (), True, own=True)
    assert sorted(y for y, _, _ in got) == ["de", "en", "en", "en"]
    german = classify.sparse("der und", (), True)[0].tolist()
    assert [i.tolist() for y, i, _ in got if y == "de"] == [german] and german not in [i.tolist() for y, i, _ in got if y == "en"]
    chosen = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "doc_id long, mark int")
    assert sorted(y for y, _, _ in classify.features(docs, "doc_id", "text", chosen, "mark", (), True)) == [0, 1, 1]


def test_languages_on_held_out_rows(spark):
    docs, _, rows, _ = corpus(spark)
    truth = {r[0]: r[2] for r in rows}
    got = language.languages(docs).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_awkward_rows(spark):
    docs, labels, _, _ = corpus(spark)
    q = quality.score(cases.docs(spark), quality.fit(docs, labels)).collect()
    assert len(q) == len(cases.rows()) and all(0 <= r.score <= 1 for r in q)
    got = language.identify(cases.docs(spark), language.fit(docs)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r.lang_pred)
    assert len(got) == len(cases.rows())
    assert all(by[k] == "und" for k in (3, 4, 5, 11, 50)) and by[14] != "und"
    assert "label" in got[0].__fields__


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.judge(cases.docs(spark), none).collect()} == {0.5}
    assert quality.judge(cases.empty(spark), none).count() == 0
    assert language.languages(cases.empty(spark)).count() == 0


def test_three_languages_of_a_family():
    rows = []
    for lang, words in (("en", "the and"), ("de", "der und"), ("nl", "het en")):
        rows += [(lang, *classify.sparse(f"{words} {k}", language.GRAMS, True)) for k in range(40)]
    model = language.Model(rows)
    assert model.families == ["germanic"] and len(model.pairs) == 3
    data = [f"{w} 7" for w in ("the and", "der und", "het en")]
    import pyarrow as pa

    mean = classify.means(*tx.flat(pa.array(data)), model.weights.T, language.GRAMS, True)
    assert model.read(mean)[0].tolist() == ["en", "de", "nl"]


def test_means_of_long_texts_equal_those_in_one_piece(monkeypatch):
    import pyarrow as pa

    text = " ".join(f"word{k % 97}" for k in range(5000))
    weights = np.random.default_rng(0).normal(size=(2, 1 << 16))
    whole = classify.means(*tx.flat(pa.array([text, None, "x"])), weights, (), True)
    monkeypatch.setattr(tx, "SLICE", 1000)
    assert np.allclose(classify.means(*tx.flat(pa.array([text, None, "x"])), weights, (), True), whole)
    assert whole[1].tolist() == [0, 0]


def plain_features(text, grams, fold, bits=classify.BITS):
    """Feature ids of a text, occurrence by occurrence, without arrays."""
    shift, half, top = 65 - bits, 1 << (bits - 1), 2**64
    power = int(tx._POWER)
    mixed = lambda x: int(tx.mix(np.array([x % top], np.uint64))[0])
    words, chars = tx.byte_values(tx.BLANK, fold), tx.byte_values(np.zeros(256, bool), fold)
    for word in text.replace("\t", " ").replace("\n", " ").split(" "):
        if word:
            yield mixed(sum(int(words[b]) * pow(power, k + 1, top) for k, b in enumerate(word.encode()))) >> shift
    codes = [int(chars[c.encode()[0]]) if ord(c) < 128 else mixed(int.from_bytes(c.encode(), "big")) | 1 for c in text]
    for n in grams:
        for k in range(len(codes) - n + 1):
            total = n
            for code in codes[k : k + n]:
                total = (total * power + code) % top
            yield (mixed(total) >> shift) + half


def test_quality_scores_equal_brute_force(spark):
    docs, labels, rows, _ = corpus(spark, 120)
    weights, bias = quality.fit(docs, labels)
    texts = [rows[0][1], rows[1][1][:40], "Überraschung  für\tAlle\nñ 中文字 x", "a", "", None]
    got = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (weights, bias)).collect()
    table = weights[:, 0].astype(np.float32)
    for r in got:
        ids = list(plain_features(texts[r.doc_id] or "", quality.GRAMS, quality.FOLD_CASE))
        mean = sum(float(table[i]) for i in ids) / max(len(ids), 1)
        assert np.isclose(r.score, 1 / (1 + np.exp(-(mean + bias))), atol=1e-9)


def test_a_training_step_equals_plain_arithmetic():
    # one document, one epoch: the softmax's error moves read-out and bias by the rate, whatever its size, as steps are divided by it
    rows = [(1, np.array([3, 9]), np.array([0.25, 0.75], np.float32))]
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1, 1, (1 << 5, 4)).astype(np.float32) / 4
    x = 0.25 * vectors[3] + 0.75 * vectors[9]
    out = -0.3 * np.outer(x, [0.5, -0.5]) / np.sqrt(1e-8 + np.outer(x, [0.5, -0.5]) ** 2)
    got, bias = classify.train_embeddings(rows, 2, dim=4, epochs=1, bits=5)
    # the read-out was zero, so the vectors stay as they were drawn
    assert np.allclose(got, vectors @ out, atol=1e-4) and np.allclose(bias, [-0.3, 0.3], atol=1e-4)


def test_models_are_trained_on_executors(spark, monkeypatch):
    docs, labels, _, _ = corpus(spark)
    known = docs.where(classify.fold_of("doc_id", language.FOLDS) != language.HELD_OUT).selectExpr("doc_id AS k", "lang AS y", "text AS t")
    plain = language.Model(classify.features(known, "k", "t", classify.sample(known, "k", "y", language.PER_LANGUAGE), "y", language.GRAMS, language.FOLD_CASE, own=True))
    monkeypatch.setattr(classify, "train_embeddings", None)  # in the driver's process alone
    monkeypatch.setattr(classify, "train_svm", None)
    got = language.fit(docs)
    assert np.array_equal(got.weights, plain.weights) and list(got.bias) == list(plain.bias) and got.pairs == plain.pairs
    weights, _ = quality.fit(docs, labels)
    assert weights.any()
    assert not quality.fit(docs.limit(0), labels)[0].any() and not language.fit(docs.limit(0)).families
