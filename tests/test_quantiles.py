"""Order statistics against sorting, with passes forced by a small bound."""

import random

import pytest

from spandrel.operators import evals, quantiles


@pytest.fixture(scope="module")
def values():
    rnd = random.Random(2)
    rows = [("many", rnd.gauss(0, 10) ** 3) for _ in range(6000)] + [("same", 4.0)] * 900 + [("ties", float(rnd.randint(0, 3))) for _ in range(2001)] + [(None, float(k)) for k in range(7)]
    rows += [("one", 3.5), ("none", None), ("two", 1.0), ("two", 2.0), ("edges", float("nan")), ("edges", float("-inf")), ("edges", 0.0), ("edges", -0.5)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [1_000_000, 50])
def test_median_and_nearest_rank(spark, values, small):
    df = spark.createDataFrame(values, "k string, v double").repartition(5)
    by = {}
    for k, v in values:
        if v is not None:
            by.setdefault(k, []).append(v)
    for vs in by.values():
        vs.sort(key=lambda v: (v != v, v))
    late = {r.k: r.value for r in quantiles.nearest_rank(df, ["k"], "v", 0.95, small).collect()}
    middle = {r.k: r.value for r in quantiles.median(df, ["k"], "v", small).collect()}
    assert set(late) == set(middle) == set(by)
    for k, vs in by.items():
        want = vs[-(-95 * len(vs) // 100) - 1]
        assert late[k] == want or (want != want and late[k] != late[k])
        assert middle[k] == pytest.approx((vs[(len(vs) - 1) // 2] + vs[len(vs) // 2]) / 2)


def test_without_a_key_and_without_rows(spark, values):
    df = spark.createDataFrame([(v,) for _, v in values if v is not None and v == v], "v double")
    vs = sorted(r.v for r in df.collect())
    assert quantiles.median(df, [], "v", 50).first().value == pytest.approx((vs[(len(vs) - 1) // 2] + vs[len(vs) // 2]) / 2)
    assert quantiles.median(df.limit(0), [], "v").count() == 0 and quantiles.nearest_rank(df.limit(0), [], "v", 0.95).count() == 0


def test_roll_up_keeps_groups_without_durations(spark):
    rows = [("a", True, True, True, None, 1.0), (None, True, False, True, 5.0, None), (None, True, True, True, 7.0, 2.0)]
    runs = spark.createDataFrame(rows, "profile string, answer_correct boolean, route_correct boolean, no_error boolean, duration_ms double, tokens double")
    assert {r.profile: r.p95_duration_ms for r in evals.roll_up(runs, "profile").collect()} == {"a": None, None: 7.0}
