"""Shared folders, tables and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset a temporary one is made and set, on one machine only; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not folder:
        known = jsc.getCheckpointDir()
        if not known.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = known.get() if known.isDefined() else f"file://{tempfile.mkdtemp(prefix='spandrel')}"
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows computed once and held in the shared folder: cuts lineage and survives lost executors. Spark deletes them when nothing uses them, if
    spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder and read again; dropped one by one or, at the end of the block, together.

    While a table is written, Spark is told to drop the shuffle files of that one query when it ends, as nothing reads them again.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.held = spark, new_folder(spark, "scratch"), {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(out)] = (out, path)
        return out

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jvm, True)

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            self._delete(self.held.pop(id(frame))[1])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.held.clear()
        self._delete(self.folder)


def spare(*names: str, taken) -> list[str]:
    """Column names that don't clash with those taken (Spark compares without case)."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of an undirected graph with links (a, b): root is the smallest node that links reach. A table of scratch.

    Large-star and small-star steps in turn: each works on pairs (node, smaller node), so rows never exceed
    the links and nothing gathers at one task or the driver but a count and two checksums a round. The lists of
    neighbours are never built: the smallest one is a partial aggregate, and joins on busy nodes can be split. A round's tables go when the next one stands.
    """
    e = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _print(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join reads both sides by exchanges of its own, which Spark can split at a busy node
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")))
        large = scratch.keep(both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        scratch.drop(least, e)
        least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"))
        small = large.join(least, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.keep(small.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
        scratch.drop(least, large)
        now = _print(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = scratch.keep(e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots))
    scratch.drop(e)
    return out
