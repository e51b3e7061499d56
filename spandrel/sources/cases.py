"""Benchmark cases from YAML, and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SCHEMA = "ordinal long, id string, question string, expected_route string, canonical string, acceptable array<string>, tags array<string>, max_duration_s double"


def read(spark: SparkSession, text: str) -> DataFrame:
    """Cases of a YAML document in file order; ids must differ, routes be sql or graph, answers not be blank."""
    import yaml

    rows, seen = [], set()
    for k, case in enumerate(yaml.safe_load(text)["cases"]):
        answer = case.get("answer") or {}
        if case["id"] in seen or case["expected_route"] not in ("sql", "graph") or not str(answer.get("canonical", "")).strip():
            raise ValueError(f"case {case['id']} is not valid")
        seen.add(case["id"])
        limit = case.get("max_duration_s")
        rows.append((k, case["id"], case["question"], case["expected_route"], str(answer["canonical"]), list(answer.get("acceptable") or []), list(case.get("tags") or []), float(limit) if limit is not None else None))
    return spark.createDataFrame(rows, _SCHEMA)


def write_report(rows: DataFrame, path: str) -> None:
    """CSV with a header; null as nothing."""
    rows.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
