import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from spandrel.llm import language, minhash, mixture, quality, tokens
from spandrel.llm._common import vocabulary

from . import test_decontaminate, test_minhash

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first()
    extra = [(9001, "!!! 12", "en", "src0", 6), (9002, None, "en", "src0", 0), (9003, "one two " + bench.text, "en", "src0", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    kept = {}
    for name, stage in p.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == before.columns
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert not {9001, 9002} & kept["language_id"] and 9003 in kept["language_id"]
    assert 9003 not in kept["decontamination"]
    assert minhash.near_duplicates(docs).where("NOT kept").count() == 0
    packed = p.STAGES[-1][1](spark, docs, SF).cache()
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept["decontamination"]
    sums = packed.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in sums)
    full = packed.groupBy("sequence_id").sum("length").orderBy("sequence_id").collect()
    assert all(r[1] == mixture.WINDOW for r in full[:-1])


def test_near_dedup_keeps_one_row_of_each_group_and_rows_without_an_id(spark):
    words = [f"w{k}" for k in range(60)]
    text, near, other, lone, last = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(words[::-1]), "a row of its own", "another one of its own"
    # exact repeated rows; a copy of a smaller doc_id beside another text of its doc_id; no doc_id, with a copied text and with one of its own; no text
    rows = [(1, text), (1, text), (2, near), (3, lone), (3, near), (4, other), (4, other), (4, other), (5, None), (6, ""), (None, text), (None, text), (None, last)]
    docs = spark.createDataFrame([(k, t, "en", "s", n) for n, (k, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = p.near_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    want = [(1, text), (3, lone), (4, other), (5, None), (6, ""), (None, text), (None, text), (None, last)]
    assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(str(r) for r in spark.createDataFrame(want, "doc_id long, text string").collect())


CLASHES = ("_text", "score", "items", "lang_pred", "n_words", "n_hit", "spans", "contaminated", "row", "own", "c0", "C1", "component_id", "kept", "hash", "longest")


@pytest.mark.parametrize("name,stage", p.STAGES[:-1])
def test_columns_that_clash_survive(spark, name, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in CLASHES})
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHES)


def test_packing_with_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ("row", "order", "ids", "pieces", "start", "length", "n_tokens", "key", "offset")
    a, b = (sorted(map(str, p.packing(spark, d, SF).collect())) for d in (docs, docs.withColumns({c: F.lit(1) for c in names})))
    assert a == b


def test_run_equals_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    # what the two models say is taken as given; all else is done anew
    told = {r.doc_id: r for r in language.identify(docs.select("doc_id", "text"), language.fit(docs)).collect()}
    left = {k for k in texts if told[k].lang_pred != "und" and told[k].score >= p.LEAST_SCORE}
    rows = docs.where(F.col("doc_id").isin(sorted(left)))
    scores = {r.doc_id: r.score for r in quality.score(rows.select("doc_id", "text"), quality.fit(rows, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    left = {k for k in left if scores[k] >= quality.THRESHOLD}
    groups = test_minhash.brute([(k, texts[k]) for k in sorted(left)])
    left = {k for k in left if groups[k][1] == k}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = dict(zip(sorted(left), test_decontaminate.brute([texts[k] for k in sorted(left)], items), strict=True))
    left = {k for k in left if not hits[k][4]}
    t = Tokenizer.from_file(vocabulary(tokens.TOKENIZER))
    t.encode_special_tokens = True
    want = {k: len(t.encode(texts[k] or "", add_special_tokens=False).ids) + 1 for k in left}
    got = {}
    for r in p.run(spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(got) == left and len(left) > 50
    for k, pieces in got.items():
        assert {n for _, _, n in pieces} == {want[k]}
        end = 0
        for start, length, _ in sorted(pieces):
            assert start == end
            end += length
        assert end == want[k]


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, p.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


@pytest.mark.parametrize("name,stage", p.STAGES)
def test_no_documents(spark, name, stage):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert stage(spark, none, SF).count() == 0
