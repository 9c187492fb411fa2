import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationcast.operators import folds, sampling, upsert, windows
from stationcast.operators.cleaning import iqr_cap
from stationcast.operators.joins import missing_dates, truth_mismatch
from stationcast.operators.resample import daily_max_of_moving_mean, resample_daily
from stationcast.plans.features import add_features, daily_features
from stationcast.schemas import FEATURE_SCHEMA, KEY, MEASURES, READING_SCHEMA, TARGETS, TIME, check_schema

D0 = dt.datetime(2024, 1, 1)


def daily(spark, values, key="s", shuffle=False):
    data = [(key, D0 + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    if shuffle:
        random.Random(1).shuffle(data)
    return spark.createDataFrame(data, f"{KEY} string, {TIME} timestamp_ntz, aqi double")


@pytest.fixture(scope="module")
def readings(spark):
    rng = random.Random(3)
    data = []
    for s in range(3):
        for h in range(24 * 40):
            if rng.random() < 0.3:
                data.append((s, D0 + dt.timedelta(hours=h), *[round(rng.uniform(0, 400), 2) if rng.random() < 0.8 else None for _ in MEASURES]))
    return spark.createDataFrame(data, READING_SCHEMA)


def test_mean_is_null_and_sum_is_zero_without_values(spark):
    df = spark.createDataFrame([("s", D0, None, None), ("s", D0, None, None)], "k string, t timestamp_ntz, a double, b double")
    row = resample_daily(df, "k", "t", ["a"], ["b"], count="n").first()
    assert (row["a"], row["b"], row["n"]) == (None, 0.0, 2)


def test_nan_and_infinity_do_not_spoil_a_day(spark):
    data = [("s", D0, v, v) for v in (1.0, 2.0, float("nan"), float("inf"), None)]
    df = spark.createDataFrame(data, "k string, t timestamp_ntz, a double, b double")
    row = resample_daily(df, "k", "t", ["a"], ["b"]).first()
    assert (row["a"], row["b"]) == (1.5, 3.0)


def test_windows_do_not_depend_on_input_order(spark, rows):
    values = [float(i * i % 7) for i in range(12)]
    for shuffle in (False, True):
        df = daily(spark, values, shuffle=shuffle)
        df = windows.add_lags(df, KEY, TIME, "aqi")
        df = windows.add_targets(windows.add_diff(df, KEY, TIME, "aqi"), KEY, TIME, "aqi")
        got = [tuple(r) for r in df.orderBy(TIME).select("aqi_lag_1", "aqi_lag_2", "aqi_diff", "aqi_t1", "aqi_t3").collect()]
        at = lambda i: values[i] if 0 <= i < len(values) else None
        assert got == [
            (at(i - 1), at(i - 2), values[i] - values[i - 1] if i else None, at(i + 1), at(i + 3)) for i in range(12)
        ]


def test_rolling_with_one_and_two_rows(spark):
    out = windows.add_rolling(daily(spark, [4.0, 8.0]), KEY, TIME, "aqi").orderBy(TIME).collect()
    assert out[0]["aqi_roll_mean_3"] == 4.0 and out[0]["aqi_roll_std_3"] is None
    assert out[1]["aqi_roll_mean_3"] == 6.0 and math.isclose(out[1]["aqi_roll_std_3"], math.sqrt(8))


def test_feature_table_has_the_declared_schema(readings):
    check_schema(daily_features(readings), FEATURE_SCHEMA)


def test_features_do_not_see_the_future(readings):
    """Cutting off later days leaves lags, rollings and filled values as they were.

    Capped measures are left out: their bounds come from the whole series by definition.
    """
    cut = F.lit(D0 + dt.timedelta(days=25)).cast("timestamp_ntz")
    cols = [KEY, TIME, "aqi", "pm25", "co", "log_pm25", "aqi_lag_1", "aqi_lag_2", "aqi_roll_mean_3", "aqi_roll_std_3", "aqi_diff"]
    full = daily_features(readings).where(F.col(TIME) < cut).select(cols)
    early = daily_features(readings.where(F.col("time") < cut)).select(cols)
    assert full.exceptAll(early).count() == 0 and early.exceptAll(full).count() == 0


def test_targets_are_not_filled(spark):
    df = daily(spark, [1.0, 2.0, 3.0])
    out = add_features(df, measures=("aqi",), capped=()).orderBy(TIME).collect()
    assert [out[-1][t] for t in TARGETS] == [None, None, None]
    assert out[-1]["aqi_lag_1"] == 2.0


def test_holdout_split(spark, rows):
    df = daily(spark, [1.0] * 5)
    got = [r["split"] for r in folds.holdout_split(df, KEY, TIME, 2).orderBy(TIME).collect()]
    assert got == ["train"] * 3 + ["test"] * 2
    with pytest.raises(ValueError):
        folds.holdout_split(df, KEY, TIME, 0)
    # a new station does not fail the others
    assert {r["split"] for r in folds.holdout_split(df, KEY, TIME, 5).collect()} == {"short"}


def spans(df):
    numbered = df.withColumn("p", F.datediff(TIME, F.lit(D0.date())))
    got = numbered.groupBy("fold", "role").agg(F.min("p"), F.max("p") + 1, F.count("*")).collect()
    for r in got:
        assert r[4] == r[3] - r[2]  # no holes
    return {(r[0], r[1]): (r[2], r[3]) for r in got}


def test_expanding_folds_of_1000_rows(spark):
    got = spans(folds.expanding_folds(daily(spark, [1.0] * 1000), KEY, TIME))
    assert got == {
        (1, "train"): (0, 600), (1, "val"): (600, 750), (2, "train"): (0, 637), (2, "val"): (637, 900),
        (3, "train"): (0, 765), (3, "val"): (765, 1000),
    }


@pytest.mark.parametrize("n, cut", [(4, 3), (3, 2), (12, 9)])
def test_short_series_have_one_fold(spark, n, cut):
    got = spans(folds.expanding_folds(daily(spark, [1.0] * n), KEY, TIME))
    if n == 12:  # only folds with enough rows on both sides
        assert all(v[1] - v[0] >= 3 for k, v in got.items() if k[1] == "val")
    else:
        assert got == {(1, "train"): (0, cut), (1, "val"): (cut, n)}


def test_forward_folds(spark):
    got = spans(folds.forward_folds(daily(spark, [1.0] * 10), KEY, TIME, 3))
    assert got[1, "train"] == (0, 4) and got[1, "val"] == (4, 6) and got[3, "val"] == (8, 10)


def test_folds_never_train_on_later_rows(spark):
    for make in (folds.expanding_folds, folds.forward_folds):
        got = spans(make(daily(spark, [1.0] * 137), KEY, TIME))
        assert all(got[f, "train"][1] <= got[f, "val"][0] for f, role in got if role == "val")


def test_upsert_replaces_and_is_idempotent(spark, rows):
    old = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0)], "k int, d int, a double")
    new = spark.createDataFrame([(1, 2, 20.0, "x"), (1, 3, 30.0, "y")], "k int, d int, a double, b string")
    once = upsert.upsert(old, new, ["k", "d"])
    twice = upsert.upsert(once, new, ["k", "d"])
    assert rows(once) == rows(twice) == [(1, 1, 1.0, None), (1, 2, 20.0, "x"), (1, 3, 30.0, "y")]


def test_missing_dates(spark, rows):
    days = [("a", dt.date(2024, 1, d)) for d in (1, 5, 6, 7)] + [("b", dt.date(2023, 1, 1))]
    df = spark.createDataFrame(days, "k string, day date")
    out = missing_dates(df, "k", "day", F.lit("2024-01-04").cast("date"), F.lit("2024-01-07").cast("date"))
    assert rows(out) == [("a", dt.date(2024, 1, 4))] + [("b", dt.date(2024, 1, d)) for d in (4, 5, 6, 7)]


def test_truth_mismatch_has_a_tolerance(spark):
    df = spark.createDataFrame([(1.0, 1.0 + 1e-7), (1.0, 1.1), (1e6, 1e6 + 1)], "y_a double, y_b double")
    assert [r[0] for r in df.select(truth_mismatch(df, ["a", "b"])).collect()] == [False, True, False]


def test_moving_mean_matches_brute_force(spark):
    rng = random.Random(7)
    data = [("s", D0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 6)), round(rng.uniform(0, 90), 2)) for _ in range(150)]
    got = daily_max_of_moving_mean(spark.createDataFrame(data, "k string, t timestamp_ntz, v double"), "k", "t", "v", 8, out="m")
    hours = {}
    for _, t, v in data:
        hours.setdefault(t.replace(minute=0), []).append(v)
    best = {}
    for h in hours:
        vals = [v for g, vs in hours.items() if dt.timedelta(0) <= h - g < dt.timedelta(hours=8) for v in vs]
        best[h.date()] = max(best.get(h.date(), 0), round(sum(vals) / len(vals), 3))
    result = {r["day"]: r["m"] for r in got.collect()}
    assert result.keys() == best.keys()
    assert all(abs(result[d] - best[d]) < 1.1e-3 for d in best)


def test_sample_is_seeded_and_independent_of_partitions(spark, rows):
    df = spark.range(1000)
    a = rows(sampling.capped_sample(df.repartition(3), ["id"], 50, 1))
    b = rows(sampling.capped_sample(df.repartition(7), ["id"], 50, 1))
    c = rows(sampling.capped_sample(df, ["id"], 50, 2))
    assert a == b and len(a) == 50 and a != c


def test_last_n_is_limited_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 as k", "id as t")
    plan = windows.last_n(df, "k", ["t"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange")[1]
    assert np.sort([r["t"] for r in windows.last_n(df, "k", ["t"], 2).collect()]).tolist() == [94, 95, 96, 97, 98, 99]


def test_readings_are_not_rounded(spark):
    data = [("a", dt.datetime(2024, 1, 1, 0, i % 60), 0.00004) for i in range(4800)]
    df = spark.createDataFrame(data, "k string, t timestamp_ntz, v double")
    r = resample_daily(df, "k", "t", ["v"], places=None).first()
    assert abs(r["v"] - 0.00004) < 1e-12
    assert abs(resample_daily(df, "k", "t", [], ["v"]).first()["v"] - 0.192) < 1e-9
    huge = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1e16)], "k string, t timestamp_ntz, v double")
    assert resample_daily(huge, "k", "t", ["v"]).first()["v"] == 1e16


def test_days_of_a_time_zone(spark):
    data = [("a", dt.datetime(2024, 1, 1, 20), 1.0), ("a", dt.datetime(2024, 1, 1, 18), 3.0)]
    df = spark.createDataFrame(data, "k string, t timestamp_ntz, v double")
    got = {str(r["day"]): r["v"] for r in resample_daily(df, "k", "t", ["v"], zone="Asia/Karachi").collect()}
    assert got == {"2024-01-02": 1.0, "2024-01-01": 3.0}


def test_caps_fitted_on_training_rows_ignore_later_days(spark):
    rows = [("a", i, float(v), i < 8) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 30, 500, 600, 700, 800])]
    df = spark.createDataFrame(rows, "k string, t int, v double, early boolean")
    full = {r["t"]: r["v"] for r in iqr_cap(df, "k", ["v"], is_train="early").collect()}
    early = {r["t"]: r["v"] for r in iqr_cap(df.where("early"), "k", ["v"], is_train="early").collect()}
    assert all(full[t] == v for t, v in early.items()) and full[11] < 20
