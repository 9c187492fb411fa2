import numpy as np
import pytest

from stationcast.operators import blend
from stationcast.plans import evaluation, scoring
from pyspark.sql import functions as F


def weights(spark, values, names=("lightgbm", "linear", "hgbr", "randomforest"), horizon="hd1"):
    return spark.createDataFrame(
        [(horizon, n, float(v)) for n, v in zip(names, values)], "horizon string, model string, weight double"
    )


def as_dict(df):
    return {r["model"]: r["weight"] for r in df.collect()}


def test_projection_shifts_when_all_stay_positive(spark):
    w = [0.03521, 0.23865, 0.31609, 0.39404]
    got = as_dict(blend.project_to_simplex(weights(spark, w), ["horizon"]))
    shift = (1 - sum(w)) / 4
    assert np.allclose([got[n] for n in ("lightgbm", "linear", "hgbr", "randomforest")], np.array(w) + shift)


def test_projection_zeroes_negative_weights(spark):
    got = as_dict(blend.project_to_simplex(weights(spark, [-0.44014, 0.24809, 0.22772, 0.97677]), ["horizon"]))
    assert got["lightgbm"] == 0.0 and np.isclose(sum(got.values()), 1.0)


@pytest.mark.parametrize("seed", range(4))
def test_projection_is_the_nearest_point(spark, seed):
    rng = np.random.default_rng(seed)
    w = rng.normal(0.3, 0.6, 4)
    got = as_dict(blend.project_to_simplex(weights(spark, w), ["horizon"]))
    v = np.array([got[n] for n in ("lightgbm", "linear", "hgbr", "randomforest")])
    assert np.isclose(v.sum(), 1) and (v >= 0).all()
    best = min(np.sum((w - c) ** 2) for c in rng.dirichlet(np.ones(4) * 0.5, 20000))
    assert np.sum((w - v) ** 2) <= best + 1e-9


def test_constraints(spark):
    w = weights(spark, [0.5, -0.5, 1.0, 1.0])
    nonneg = as_dict(blend.constrain(w, ["horizon"], nonneg=True, sum_to_one=False))
    assert nonneg["linear"] == 0.0 and nonneg["hgbr"] == 1.0
    summed = as_dict(blend.constrain(w, ["horizon"], nonneg=False, sum_to_one=True))
    assert np.isclose(sum(summed.values()), 1.0) and summed["linear"] == -0.25
    zero = as_dict(blend.constrain(weights(spark, [1.0, -1.0, 0.0, 0.0]), ["horizon"], nonneg=False, sum_to_one=True))
    assert set(zero.values()) == {0.25}


def test_least_squares_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 300, (200, 4))
    y = x @ [0.1, 0.2, 0.3, 0.4] + rng.normal(0, 5, 200)
    df = spark.createDataFrame([("hd1", *map(float, r), float(v)) for r, v in zip(x, y)], "horizon string, a double, b double, c double, d double, y double")
    for cols in (list("abcd"), list("ab")):
        got = as_dict(blend.blend_weights(df, ["horizon"], "y", cols, cols))
        want = np.linalg.lstsq(x[:, : len(cols)], y, rcond=None)[0]
        assert np.allclose([got[c] for c in cols], want)


def preds(spark, rows):
    return spark.createDataFrame(
        rows, "station_id string, horizon string, p_lightgbm double, p_linear double, p_hgbr double, p_randomforest double"
    )


def test_blend_of_available_models(spark):
    w = weights(spark, [0.05, 0.15, 0.3, 0.5])
    df = preds(spark, [
        ("all", "hd1", 100.0, 100.0, 200.0, 200.0),
        ("some", "hd1", None, 100.0, 200.0, 200.0),
        ("few", "hd1", None, None, 200.0, 900.0),
        ("none", "hd1", None, None, None, None),
        ("no weights", "hd2", None, 7.0, 8.0, 9.0),
    ])
    got = {r["station_id"]: r for r in blend.blend_apply(df, w, ["station_id"]).collect()}
    assert np.isclose(got["all"]["blend"], 180.0) and not got["all"]["low_coverage"]
    assert np.isclose(got["some"]["coverage"], 0.95) and np.isclose(got["some"]["blend"], (15 + 160) / 0.95)
    assert got["few"]["blend"] == 500.0 and got["few"]["low_coverage"]
    assert got["none"]["blend"] is None
    assert got["no weights"]["blend"] == 7.0 and got["no weights"]["coverage"] is None


def test_predictions_are_not_shuffled_by_the_blend(spark):
    df = preds(spark, [("a", "hd1", 1.0, 2.0, 3.0, 4.0)])
    plan = blend.blend_apply(df, weights(spark, [0.25] * 4), ["station_id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_weighted_family_without_predictions_lowers_the_coverage(spark):
    w = spark.createDataFrame([("hd1", "linear", 0.4), ("hd1", "prophet", 0.6)], "horizon string, model string, weight double")
    df = spark.createDataFrame([("a", "hd1", 100.0)], "station_id string, horizon string, p_linear double")
    r = blend.blend_apply(df, w, ["station_id"]).first()
    assert np.isclose(r["coverage"], 0.4) and r["low_coverage"] and r["blend"] == 100.0
    more = df.withColumn("p_prophet", F.lit(200.0))
    assert np.isclose(blend.blend_apply(more, w, ["station_id"]).first()["blend"], 160.0)


def test_stack_fits_before_the_holdout(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        y = float(rng.uniform(50, 300))
        good, bad = y + float(rng.normal(0, 2)), float(rng.uniform(50, 300))
        if i >= 200:  # in the holdout the roles are swapped
            good, bad = bad, good
        rows.append(("s", i, "hd1", y, good, bad))
    df = spark.createDataFrame(rows, "station_id string, t int, horizon string, y_true double, p_lightgbm double, p_linear double")
    _, honest = evaluation.stack(df, "station_id", "t", holdout=100, families=["lightgbm", "linear"])
    _, in_sample = evaluation.stack(df, "station_id", "t", holdout=100, families=["lightgbm", "linear"], in_sample=True)
    assert as_dict(honest)["lightgbm"] > 0.9 and as_dict(in_sample)["linear"] > 0.9
    blended, _ = evaluation.stack(df, "station_id", "t", holdout=100, families=["lightgbm", "linear"], in_sample=True, calibrate=True)
    scopes = {r["scope"]: r for r in evaluation.stack_metrics(blended, "station_id", "t").collect()}
    assert scopes["full"]["n"] == 100 and scopes["last"]["n"] == 30 and scopes["full"]["rmse"] < 10


def test_forecast_record(spark):
    df = preds(spark, [("a", h, v, None, None, None) for h, v in (("hd1", 210.0), ("hd2", 90.0), ("hd3", 80.0))])
    df = df.withColumn("event_timestamp", F.lit("2024-01-01").cast("timestamp_ntz"))
    records = scoring.forecast_records(df, weights(spark, [1.0, 0, 0, 0]), F.lit("2024-01-01").cast("date"))
    r = records.first()
    assert r["alert"] == "hazardous" and r["lightgbm"] == {"hd1": 210.0, "hd2": 90.0, "hd3": 80.0}
    assert [str(d) for d in r["forecast_dates"]] == ["2024-01-02", "2024-01-03", "2024-01-04"]
    assert scoring.choose_series(records, "blend").count() == 3
