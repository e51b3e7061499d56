"""Models kept as tables: a folder with one Parquet table each of elements, properties, quantities, nodes and edges, partitioned by dataset.

A version is a list of datasets, each with the digest of its source files and the folder that holds its tables, so that a later version names the folders of datasets that didn't change.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "dataset string, digest string, folder string"
NAMES = ("elements", "properties", "quantities", "nodes", "edges")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def digests(spark: SparkSession, *paths: str) -> DataFrame:
    """(dataset, digest, files): what the source files of each dataset (a file's stem) hold; file by file, on the executors."""
    files = spark.read.format("binaryFile").load(list(paths)).select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("dataset"), "path", F.sha2("content", 256).alias("d"))
    both = F.array_sort(F.collect_list(F.struct("d", "path")))
    return files.groupBy("dataset").agg(F.sha2(F.array_join(F.transform(both, lambda x: x["d"]), "").cast("binary"), 256).alias("digest"), F.transform(both, lambda x: x["path"]).alias("files"))


def write(folder: str, frames: dict[str, DataFrame], sources: DataFrame | None = None, kept_rows: list | None = None) -> str:
    """Writes a version of all tables and returns its folder; the marker that makes it count is written last, so that readers never see half of one.

    sources (dataset, digest) tells what the datasets were made of; kept_rows are datasets of an earlier version, (dataset, digest, folder), that belong to this one as they are.
    """
    spark = frames["nodes"].sparkSession
    path = f"{folder}/v-{uuid.uuid4().hex}"
    for name in NAMES:
        frames[name].write.partitionBy("dataset").parquet(f"{path}/{name}")
        # a table without rows has no file that tells its columns
        spark.createDataFrame([], frames[name].schema).coalesce(1).write.parquet(f"{path}/columns/{name}")
    own = spark.read.parquet(f"{path}/nodes").select(F.col("dataset").cast("string").alias("dataset")).distinct()
    own = own.withColumn("digest", F.lit(None).cast("string")) if sources is None else own.join(sources.select("dataset", "digest"), "dataset", "left")
    rows = own.withColumn("folder", F.lit(path)).unionByName(spark.createDataFrame(kept_rows or [], _MANIFEST))
    rows.coalesce(1).write.parquet(f"{path}/manifest")  # a row a dataset
    spark.range(1).select(F.current_timestamp().alias("at"), F.lit(path).alias("path")).write.mode("append").parquet(f"{folder}/versions")
    return path


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(dataset, digest, folder) of the newest version; none where there is none."""
    return spark.read.parquet(f"{latest(spark, folder)}/manifest") if _exists(spark, f"{folder}/versions") else spark.createDataFrame([], _MANIFEST)


def update(spark: SparkSession, folder: str, paths: list[str], build) -> dict[str, list[str]]:
    """Brings a folder up to date with source files: build(files) gives the tables of files whose datasets are new or changed, and only those are written; the names of built, kept and removed datasets.

    Where nothing changed, no version is added. Two files of one stem are one dataset.
    """
    now = digests(spark, *paths)
    before = manifest(spark, folder)
    met = now.join(before.withColumnsRenamed({"digest": "old"}), "dataset", "full_outer").collect()  # a row a dataset
    same = [r for r in met if r.files is not None and r.digest == r.old]
    made = [r for r in met if r.files is not None and r.digest != r.old]
    gone = [r for r in met if r.files is None]
    if made or gone:
        kept_rows = [(r.dataset, r.old, r.folder) for r in same]
        if made:
            write(folder, build([f for r in made for f in r.files]), now, kept_rows)
        elif same:
            path = f"{folder}/v-{uuid.uuid4().hex}"
            spark.createDataFrame(kept_rows, _MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
            spark.range(1).select(F.current_timestamp().alias("at"), F.lit(path).alias("path")).write.mode("append").parquet(f"{folder}/versions")
    return {name: sorted(r.dataset for r in rows) for name, rows in (("built", made), ("kept", same), ("removed", gone))}


def latest(spark: SparkSession, folder: str) -> str:
    """The folder of the newest complete version."""
    if not _exists(spark, f"{folder}/versions"):
        raise ValueError(f"{folder} holds no model")
    return spark.read.parquet(f"{folder}/versions").orderBy(F.desc("at"), "path").first().path


def read(spark: SparkSession, folder: str, *datasets: str) -> dict[str, DataFrame]:
    """The tables of the newest version, of all datasets or of some: then only their partitions are read."""
    homes: dict[str, list[str]] = {}
    known = {r.dataset: r.folder for r in manifest(spark, folder).collect()}
    if not known:
        raise ValueError(f"{folder} holds no model")
    if missing := set(datasets) - set(known):
        raise ValueError(f"no such datasets: {sorted(missing)}; there are {', '.join(sorted(known))}")
    for name in datasets or known:
        homes.setdefault(known[name], []).append(name)

    def table(name: str) -> DataFrame:
        parts = [spark.read.schema(spark.read.parquet(f"{home}/columns/{name}").schema).parquet(f"{home}/{name}").withColumn("dataset", F.col("dataset").cast("string")).where(F.col("dataset").isin(*names)) for home, names in sorted(homes.items())]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    return {n: table(n) for n in NAMES}


def datasets_of(spark: SparkSession, folder: str) -> list[str]:
    """Names of the datasets of the newest version."""
    latest(spark, folder)
    return sorted(r.dataset for r in manifest(spark, folder).collect())


def write_report(rows: DataFrame, folder: str, kind: str = "csv") -> None:
    """A report as CSV with a header, or as JSON lines."""
    if kind not in ("csv", "json"):
        raise ValueError("kind must be csv or json")
    rows.write.mode("overwrite").option("header", True).format(kind).save(folder)
