"""STEP instances that very many others refer to, or none, and lines that a small file becomes."""

import pytest
from pyspark.sql import functions as F

from spandrel.plans import views
from spandrel.sources import step, step_check, step_model

SF = "/root/testdata/sf0.001"


@pytest.fixture
def apart(spark):
    """Small shuffles are not merged into one partition."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def tasks(rows):
    return sorted(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect())


def test_lines_of_a_small_file_are_made_by_several_tasks(spark):
    lines = views.step_parts(spark, SF).where("value LIKE '%=IFCWALL(%'")
    assert len(tasks(lines)) > 1 and lines.count() == spark.read.parquet(f"{SF}/customer.parquet").count()


@pytest.mark.parametrize("most", [100_000, 0])
def test_missing_ids_are_found_however_many(spark, monkeypatch, most):
    monkeypatch.setattr(step_check, "SENT", most)
    texts = ["#1=IFCX(#7,#7,#2,'#9')", "#2=IFCX(#1)", "#2=IFCX(#1)", "#3=IFCX(#7,(#8))", "#4=IFCPROJECT()"]
    parts = spark.createDataFrame([(d, k, t) for d in "ab" for k, t in enumerate(texts + ["#7=IFCX()"] * (d == "b"))], "dataset string, line long, value string")
    got = sorted((r.dataset, r.rule, r.id, r.message) for r in step_check.problems(step.parsed(parts)).collect())
    want = [("a", "dangling", 1, "refers to #7"), ("a", "dangling", 3, "refers to #7"), ("a", "dangling", 3, "refers to #8"), ("a", "double", 2, "comes 2 times"), ("b", "dangling", 3, "refers to #8"), ("b", "double", 2, "comes 2 times")]
    assert got == want


def test_ids_are_counted_without_a_join_of_all(spark):
    parts = spark.createDataFrame([("a", 0, "#1=IFCX(#2)")], "dataset string, line long, value string")
    plan = step_check.problems(step.parsed(parts))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan


def test_what_is_shared_or_missing_gathers_in_no_task(spark, monkeypatch, apart):
    monkeypatch.setattr(step_model, "SHARED", 100, raising=False)
    ref = F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, F.col("id")).cast("long")
    rows = spark.range(3000).select(F.lit("a").alias("dataset"), "id", ref.alias("to")).localCheckpoint()
    table = spark.range(0, 3000, 2).union(spark.range(1, 2)).select(F.lit("a").alias("dataset"), "id", (F.col("id") * 2).alias("v")).localCheckpoint()
    found = step_model._looked_up(rows.hint("merge"), ["dataset"], table.hint("merge"), got="to").localCheckpoint()
    want = {k: 2 if k % 3 == 0 else 2 * k if k % 3 == 1 and (k % 2 == 0 or k == 1) else None for k in range(3000)}
    assert {r.id: r.got for r in found.collect()} == want and found.count() == 3000
    assert max(tasks(found)) < 1200
