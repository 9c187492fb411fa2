import datetime as dt

import pytest
from pyspark.sql import functions as F

from stationcast.functions import airquality as aq
from stationcast.functions.numeric import clamp, exact_mean, to_units
from stationcast.operators import cleaning, encode
from stationcast.operators.subindex import ozone_index, pollutant_index
from stationcast.schemas import CONTRACT, FEATURE_SCHEMA, check_schema, require_columns


def test_unusable_numbers_become_null(spark, rows):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["1.5", "abc", "inf", "-inf", "NaN", None, ""])], "i int, v string")
    got = dict(rows(cleaning.coerce_numeric(df, ["v"])))
    assert got == {0: 1.5, 1: None, 2: None, 3: None, 4: None, 5: None, 6: None}


def test_clamp_keeps_null_and_bounds(spark, rows):
    df = spark.createDataFrame([(-5.0,), (0.0,), (500.0,), (501.0,), (None,)], "v double")
    assert rows(df.select(clamp(F.col("v"), 0, 500).alias("v"))) == [(0.0,), (0.0,), (500.0,), (500.0,), (None,)]


@pytest.mark.parametrize("values, mean", [([1.0, 2.0], 1.5), ([0.01] * 3 + [0.02], 0.013), ([-0.01, -0.02], -0.015), ([], None)])
def test_exact_mean_rounds_half_away(spark, values, mean):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 3, 4):
        got = df.agg(exact_mean(F.sum(to_units(F.col("v"), digits)), F.count("v"), digits, 3)).first()[0]
        assert got == mean


def test_exact_mean_of_a_huge_total(spark):
    df = spark.range(1).select(exact_mean(F.lit(9_000_000_000_000_000_000), F.lit(7_000_000_000), 4, 3))
    assert df.first()[0] == round(9e18 / 7e9 / 1e4, 3)


def test_category_bounds_are_inclusive(spark):
    values = [0.0, 50.0, 50.1, 100.0, 150.0, 200.0, 300.0, 300.1, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [tuple(r) for r in df.select(aq.category(F.col("v")), aq.category_label(F.col("v"))).collect()]
    assert [g[0] for g in got] == [1, 1, 2, 2, 3, 4, 5, 6, None]
    assert got[0][1] == "Good" and got[7][1] == "Hazardous" and got[8][1] is None


def test_alert_thresholds(spark):
    df = spark.createDataFrame([(149.9,), (150.0,), (199.9,), (200.0,), (None,)], "v double")
    assert [r[0] for r in df.select(aq.alert_level(F.col("v"))).collect()] == ["ok", "unhealthy", "unhealthy", "hazardous", None]


def test_one_hot_has_a_fixed_schema(spark):
    df = spark.createDataFrame([("Summer",), (None,)], "season string")
    out = encode.one_hot(df, "season", ["Spring", "Summer", "Winter"], drop_first=True)
    assert out.columns == ["season_Summer", "season_Winter"]
    assert [tuple(r) for r in out.collect()] == [(1, 0), (0, 0)]


def test_contract_order_and_defaults(spark):
    df = spark.createDataFrame([(float("inf"), 2.0)], "aqi double, co double")
    out = cleaning.align_contract(df, CONTRACT)
    assert out.columns == CONTRACT and len(CONTRACT) == 27
    row = out.first()
    assert row["aqi"] == 0.0 and row["co"] == 2.0 and row["humidity"] == 0.0


def test_legacy_date_column(spark):
    df = spark.createDataFrame([("2024-01-02",), ("x",)], "date string")
    out = cleaning.legacy_time(df)
    assert out.columns == ["event_timestamp"]
    assert [r[0] for r in out.collect()] == [dt.datetime(2024, 1, 2), None]
    with pytest.raises(ValueError):
        cleaning.legacy_time(spark.range(1))


def test_required_columns(spark):
    with pytest.raises(ValueError, match="aqi_t1"):
        require_columns(spark.range(1), ["id", "aqi_t1"])
    with pytest.raises(ValueError):
        check_schema(spark.range(1), FEATURE_SCHEMA)


def test_imputation_variants(spark, rows):
    df = spark.createDataFrame(
        [("a", 1, True, 1.0), ("a", 2, True, 3.0), ("a", 3, False, None), ("a", 4, False, 10.0), ("b", 1, True, None)],
        "k string, t int, tr boolean, v double",
    )
    by = lambda d: {(r["k"], r["t"]): r["v"] for r in d.collect()}
    assert by(cleaning.impute_train_mean(df, "k", ["v"], "tr"))["a", 3] == 2.0
    assert by(cleaning.impute_self_mean(df, ["k", "tr"], ["v"]))["a", 3] == 10.0
    assert by(cleaning.impute_zero(df, ["v"]))["b", 1] == 0.0
    latest = by(cleaning.impute_latest_from_history(df, "k", "t", ["v"]))
    assert latest == {("a", 4): 10.0, ("b", 1): 0.0}


def test_all_null_columns_are_dropped(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    assert cleaning.drop_all_null(df, ["a", "b"]).columns == ["a"]


def test_index_steps_change_by_date_and_ozone_takes_the_greater_mean(spark):
    rows = [(dt.date(2024, 5, 5), 12.0), (dt.date(2024, 5, 6), 12.0), (dt.date(2024, 5, 6), 9.0), (dt.date(2024, 5, 6), 400.0), (dt.date(2024, 5, 6), None)]
    df = spark.createDataFrame(rows, "day date, v double").select(pollutant_index(F.col("v"), "pm25", F.col("day")).alias("i"))
    assert [r["i"] for r in df.collect()] == [50.0, 56.0, 50.0, 500.0, None]
    rows = [(54.9, 100.0), (71.0, 124.9), (71.0, 205.0), (None, 125.0), (300.0, None), (None, 90.0), (10.0, 700.0)]
    df = spark.createDataFrame(rows, "a double, b double").select(ozone_index(F.col("a"), F.col("b")).alias("i"))
    assert [r["i"] for r in df.collect()] == [50.0, 101.0, 201.0, 101.0, 300.0, None, 500.0]
