"""Join helpers (size-checked broadcast, hot-key split) and table profiles."""

import statistics

import pytest

from chirpflow.operators import joins, profile


def test_small_side_join_both_paths(spark, monkeypatch):
    big = spark.createDataFrame([(i, f"w{i % 5}") for i in range(50)], "i int, word string")
    stop = spark.createDataFrame([("w1",), ("w3",)], "word string")
    a = sorted(r.i for r in joins.small_side_join(big, stop, "word", "left_anti").collect())
    monkeypatch.setattr(joins, "BROADCAST_MAX_ROWS", 1)
    b = sorted(r.i for r in joins.small_side_join(big, stop, "word", "left_anti").collect())
    assert a == b and len(a) == 30


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_hot_join_equals_plain_join(spark, how):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(60)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "rk string, v int")
    plain = sorted(tuple(r) for r in left.join(right, left.k == right.rk, how).collect())
    split = sorted(tuple(r) for r in joins.split_hot_join(left, right, [("k", "rk")], how, hot_rows=10).collect())
    assert split == plain


def test_profile_exact_approx_auto(spark):
    vals = [1, 2, 2, 3, 4, 10, 11, 50]
    df = spark.createDataFrame([(v, float(v) / 2) for v in vals], "a int, b double")
    exact = {r.column: r for r in profile.profile(df, approx=False).collect()}
    assert exact["a"]["count"] == 8 and exact["a"].min == 1 and exact["a"].max == 50
    assert exact["a"].p50 == statistics.median(vals)
    assert abs(exact["a"].std - statistics.stdev(vals)) < 1e-9
    approx = {r.column: r for r in profile.profile(df, approx=True).collect()}
    assert approx["a"].p50 in vals  # percentile_approx returns an observed value
    auto = {r.column: r for r in profile.profile(df).collect()}
    assert auto["a"].p50 == exact["a"].p50  # few distinct values: exact
    info = {r.column: (r.dtype, r.non_null) for r in profile.null_profile(df).collect()}
    assert info == {"a": ("int", 8), "b": ("double", 8)}


def test_numbered_equals_a_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from chirpflow.operators.ranks import numbered

    rows = [("hot" if i % 3 else (None if i % 2 else f"g{i % 12}"), (i * 7919) % 500 / 7, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double, id int").repartition(5)
    order = [F.desc("x"), F.asc("id")]
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    got = numbered(df, ["g"], order, partitions=7)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert numbered(df.where("id < 0"), ["g"], order).count() == 0


def test_exact_quantiles_of_awkward_columns(spark, monkeypatch):
    """Heavy hitters, wide ranges, nulls, NaN and no values, with ranges too large to sort directly."""
    import numpy as np

    rng = np.random.default_rng(8)
    cols = {
        "skew": np.exp(rng.normal(0, 12, 4000)), "mostly": np.where(rng.random(4000) < 0.97, 5.0, rng.normal(size=4000)),
        "few": rng.integers(0, 3, 4000).astype(float), "uniform": rng.random(4000),
    }
    rows = [tuple(float(v[i]) for v in cols.values()) + (None if i % 2 else float(i), float("nan") if i % 5 else -1.0, None) for i in range(4000)]
    df = spark.createDataFrame(rows, "skew double, mostly double, few double, uniform double, half double, nan double, none double")
    monkeypatch.setattr(profile, "SMALL_RANGE", 3)
    got = {r.column: r for r in profile.profile(df).collect()}
    half = [float(i) for i in range(0, 4000, 2)]
    for name, values in {**cols, "half": half, "nan": [-1.0] * 800}.items():
        want = np.quantile(values, [0.25, 0.5, 0.75])
        assert [got[name].p25, got[name].p50, got[name].p75] == pytest.approx(want.tolist(), rel=1e-12), name
    assert got["none"]["count"] == 0 and got["none"].p50 is None and got["none"].min is None


def test_time_profile(spark):
    import datetime as dt

    days = [dt.datetime(2020, 1, d, 12) for d in (1, 2, 4, 8)]
    df = spark.createDataFrame([(d, None) for d in [*days, None]], "t timestamp, u date")
    got = {r.column: r for r in profile.time_profile(df).collect()}
    t = got["t"]
    assert (t["count"], t.min, t.max, t.p50) == (4, days[0], days[3], dt.datetime(2020, 1, 3, 12))
    assert t.p25 == dt.datetime(2020, 1, 2, 6) and t["mean"] == dt.datetime(2020, 1, 4, 6)
    assert got["u"]["count"] == 0 and got["u"].p50 is None
