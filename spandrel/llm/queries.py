"""The operators' queries: each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit, decontaminate, dialogue, embeddings, language, merkle, minhash, mixture, oracles, quality, shards, toxicity, urls, warc
from ._common import table


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page to a record of a seekable bundle and back; equal payloads are stored once."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by subword embeddings learned from labels outside fold 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: family, then pairwise support vector machines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.languages(docs).select("doc_id", "held_out", "lang_pred", "score")


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine >= 0.98 within a label, and their components."""
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in packed binary files, as read back from them."""
    return bestfit.round_trip(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every URL by rules, else by the ratio of character models."""
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 16 by rendezvous hashing, and that of 17."""
    out = shards.assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("law", F.lit("key")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with similar shingle sets."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences that hold the sources in proportion."""
    return mixture.pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in benchmark passages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a factorization machine learned from labels outside fold 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.judge(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and the cheapest edits that mend it."""
    turns = table(spark, sf_dir, "conversations")
    return dialogue.report(dialogue.damage(turns), turns)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof; half of them are checked after their line ends are taken out."""
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.audit(table(spark, sf_dir, "documents"), changed, ["doc_id", "source", "lang", "n_chars", "text"], "text")


QUERIES = {f.__name__: f for f in (op1_warc_bundles, op2_quality, op3_language, op4_near_vectors, op5_best_fit, op6_url_filter, op7_shards, op8_near_duplicates, op9_mixture_packing, op10_decontamination, op11_toxicity, op12_conversation_repair, op13_merkle_manifest)}

#: The others train models or tokenise.
ORACLE_SQL = {"op1_warc_bundles": oracles.OP1, "op4_near_vectors": oracles.OP4, "op7_shards": oracles.OP7, "op8_near_duplicates": oracles.OP8, "op10_decontamination": oracles.OP10, "op12_conversation_repair": oracles.OP12, "op13_merkle_manifest": oracles.OP13}
