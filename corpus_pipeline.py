"""From raw documents to packed sequences: language, quality, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents, extra ones too, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm import decontaminate, language, minhash, mixture, quality
from spandrel.llm._common import new_folder, table

#: A language is rejected if it is unknown or less likely than not.
LEAST_SCORE = 0.5


def _apart(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with columns named by their places, so that none clashes with what an operator adds, and the names of doc_id and text."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs under their own names."""
    return rows.select(*[F.col(f"c{k}").alias(name) for k, name in enumerate(docs.columns)])


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number of its own for each row; written and read again, so that a row has the same one wherever it is used."""
    path = new_folder(docs.sparkSession, "numbered")
    docs.withColumn(name, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is less likely than not."""
    rows, _, text = _apart(docs)
    judged = language.identify(rows, language.fit(docs), text, keep=True)
    return _back(judged.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is below the threshold."""
    rows, _, text = _apart(docs)
    judged = quality.score(rows, quality.fit(docs, table(spark, sf_dir, "labels")), text, keep=True)
    return _back(judged.where(F.col("score") >= quality.THRESHOLD), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that with the least doc_id, of those that repeat it that whose text hashes least. Rows without a doc_id are in no group and stay.

    Rows are told apart by numbers of their own, so neither repeated rows nor a doc_id with several texts hide one another.
    """
    rows, key, text = _apart(docs)
    rows = _numbered(rows, "own")
    known = rows.where(F.col(key).isNotNull())
    groups = minhash.near_duplicates(known, "own", text).select("own", "component_id").join(known.select("own", key, F.xxhash64(text).alias("hash")), "own")
    # a partial aggregate, so a large group gathers nowhere
    first = groups.groupBy("component_id").agg(F.min(F.struct(key, "hash", "own")).alias("first")).select(F.col("first.own").alias("own"))
    stay = first.unionByName(rows.where(F.col(key).isNull()).select("own"))
    return _back(rows.join(stay, "own", "left_semi"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    rows, _, text = _apart(docs)
    judged = decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark"), text=text, keep=True)
    return _back(judged.where("NOT contaminated"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens that hold the sources in proportion."""
    return mixture.pack(docs, with_ids=False).drop("ids")


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Trained models and tokenizers are beyond SQL; tests hold the stages against brute force on a small fixture, given the models' scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
