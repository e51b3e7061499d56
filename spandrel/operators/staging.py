"""Cutting the lineage of loops, in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, on one machine (tests), a temporary folder."""
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spandrel"))
    return context.getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """The rows computed once and written to spark.checkpoint.dir, so that they survive lost executors."""
    _folder(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame, by: str | None = None) -> DataFrame:
    """As kept, by columns: what reads the rows reads the columns it needs only, and Spark knows their size. Each task's rows are sorted by a column, if one is named, so that what asks for some of its values reads little else."""
    path = f"{_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    (df if by is None else df.sortWithinPartitions(by)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
