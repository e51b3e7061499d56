"""Roll-ups of evaluation runs: profile, case_id, answer_correct, route_correct, no_error (booleans), duration_ms, tokens (null without usage)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quantiles


def rate(c: Column) -> Column:
    """Share of true among not null, to six digits."""
    return F.round(F.avg(c.cast("double")), 6)


def mean(c: Column) -> Column:
    return F.round(F.avg(c.cast("double")), 6)


def p95(runs: DataFrame, by: list[str], name: str) -> DataFrame:
    """(by, p95): nearest rank, the smallest value that at least 95 % of the values don't exceed; no row for a group without values."""
    return quantiles.nearest_rank(runs, by, name, 0.95).withColumnRenamed("value", "p95")


def roll_up(runs: DataFrame, *by: str) -> DataFrame:
    rows = runs.groupBy(*by).agg(
        F.count("*").alias("runs"),
        rate(F.col("answer_correct")).alias("answer_correct_rate"),
        rate(F.col("route_correct")).alias("route_correct_rate"),
        rate(F.col("no_error")).alias("no_error_rate"),
        mean(F.col("duration_ms")).alias("avg_duration_ms"),
        mean(F.col("tokens")).alias("avg_tokens"),
        F.sum("tokens").alias("sum_tokens"),
        rate(F.col("tokens").isNotNull()).alias("token_coverage_rate"),
    )
    late = p95(runs, list(by), "duration_ms").select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(by)], F.col("p95").alias("p95_duration_ms"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{k}")) for k, c in enumerate(by)])
    return rows.join(late, same, "left").drop(*[f"_{k}" for k in range(len(by))])


TOKEN_KINDS = ("total_tokens", "output_tokens", "input_tokens")


def leaderboard(runs: DataFrame, by: str, limit: int) -> DataFrame:
    """Best profiles first: answers, routes, then fewer tokens (of all, output and input ones, as far as runs tell them apart) and less time; missing figures last."""
    rows, kinds = roll_up(runs, by), [k for k in TOKEN_KINDS if k in runs.columns]
    if kinds:
        rows = rows.join(runs.groupBy(by).agg(*[mean(F.col(k)).alias("avg_" + k) for k in kinds]), by)
    tokens = [F.asc_nulls_last("avg_" + k) for k in kinds] or [F.asc_nulls_last("avg_tokens")]
    return rows.orderBy(F.desc_nulls_last("answer_correct_rate"), F.desc_nulls_last("route_correct_rate"), *tokens, F.asc_nulls_last("avg_duration_ms"), by).limit(limit)


def judged(runs: DataFrame) -> DataFrame:
    """Runs (expected_route, route, error, limit_ms, duration_ms) with route_correct, no_error and duration_pass (null without a limit)."""
    return runs.withColumns({"route_correct": F.col("expected_route").eqNullSafe(F.col("route")), "no_error": F.col("error").isNull(), "duration_pass": F.col("duration_ms") <= F.col("limit_ms")})


def profile_summary(runs: DataFrame, by: str = "profile") -> DataFrame:
    """(by, runs, errors, warnings, with_data, avg_duration_ms, max_duration_ms) of runs with error, warnings and rows_returned."""
    return runs.groupBy(by).agg(
        F.count("*").alias("runs"), F.count("error").alias("errors"), F.sum(F.coalesce("warnings", F.lit(0))).alias("warnings"), F.count_if(F.col("rows_returned") > 0).alias("with_data"),
        mean(F.col("duration_ms")).alias("avg_duration_ms"), F.max("duration_ms").alias("max_duration_ms"),
    )


def combinations(spark, axes: dict[str, list]) -> DataFrame:
    """The matrix of all choices, each once, with its number; axes are short configured lists."""
    from itertools import product

    rows = list(dict.fromkeys(product(*axes.values())))
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ordinal long, " + ", ".join(f"{a} string" for a in axes))


def cases_up_to(cases: DataFrame, last: str | None = None, tags: tuple[str, ...] = ()) -> DataFrame:
    """Cases (ordinal, id, tags) up to an id in file order, then those with any of some tags."""
    if last is not None:
        end = cases.where(F.col("id") == last).agg(F.min("ordinal").alias("end"))
        cases = cases.crossJoin(F.broadcast(end)).where("ordinal <= end").drop("end")
    return cases.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else cases
