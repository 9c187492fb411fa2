"""Training, selection, calibration, scoring and importance.

The fits use fewer rounds and trees than the defaults of the library; all rows are used.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import linear, training, trees, tuning
from ..models.calibration import isotonic_calibrate
from ..models.frame import training_frame
from ..functions.airquality import alert_level
from ..functions.numeric import clamp
from ..operators.blend import weights_by_horizon
from ..plans.evaluation import stack
from ..plans.features import add_features
from ..plans.scoring import forecast_records
from ..schemas import AQI_MAX, AQI_MIN, FAMILIES, HORIZONS, KEY, TARGETS, TIME
from ..session import stored, work_path
from ..sources.artifacts import latest_artifacts
from . import inputs as src
from . import query

HOLDOUT, ROUNDS, TREES = 90, 8, 20


def series_features(spark, sf_dir):
    """Feature table of the long series; the index is the only measure."""
    daily = src.series(spark, sf_dir).select(
        KEY, F.col("day").cast("timestamp_ntz").alias(TIME), F.col("y").alias("aqi")
    )
    return add_features(daily, measures=("aqi",), capped=())


def frame(spark, sf_dir):
    df, names = training_frame(series_features(spark, sf_dir), HOLDOUT)
    return df.persist(), names


def train_rows(df):
    return df.where(F.col("split") == "train")


@query("linear_select")
def linear_select(spark, sf_dir):
    df, names = frame(spark, sf_dir)
    scores = linear.linear_search(train_rows(df), names, TARGETS)
    df.unpersist()
    return spark.createDataFrame(scores).select("target", "kind", "alpha", "l1", "cv_rmse")


def _fit_and_score(spark, sf_dir, families, **kw):
    models, df, _ = training.train_families(series_features(spark, sf_dir), HOLDOUT, families, **kw)
    scores = stored(training.holdout_metrics(training.score_holdout(models, df), families), "metrics")
    df.unpersist()
    return scores


@query("gbt_train")
def gbt_train(spark, sf_dir):
    return _fit_and_score(spark, sf_dir, ["lightgbm"], rounds=ROUNDS)


@query("gbt_hist_train")
def gbt_hist_train(spark, sf_dir):
    return _fit_and_score(spark, sf_dir, ["hgbr"], rounds=ROUNDS)


@query("rf_train")
def rf_train(spark, sf_dir):
    return _fit_and_score(spark, sf_dir, ["randomforest"], n_trees=TREES)


@query("linear_train")
def linear_train(spark, sf_dir):
    return _fit_and_score(spark, sf_dir, ["linear"], huber=False)


@query("train_all_horizons")
def train_all_horizons(spark, sf_dir):
    return _fit_and_score(spark, sf_dir, FAMILIES, rounds=3, n_trees=TREES, huber=False)


@query("score_latest")
def score_latest(spark, sf_dir):
    models, df, _ = training.train_families(
        series_features(spark, sf_dir), HOLDOUT, ("linear", "randomforest"), n_trees=TREES, huber=False
    )
    scored = stored(training.score_latest(models, df), "scores")
    df.unpersist()
    return scored


@query(
    "model_roundtrip",
    "SELECT horizon, 90 * count(DISTINCT o_orderpriority) AS n, 0.0E0 AS max_difference FROM orders "
    "CROSS JOIN (VALUES ('hd1'), ('hd2'), ('hd3')) h(horizon) GROUP BY horizon",
)
def model_roundtrip(spark, sf_dir):
    models, df, _ = training.train_families(series_features(spark, sf_dir), HOLDOUT, ("linear",), huber=False)
    path = work_path(spark, "models")
    training.save_models(models, path)
    before = training.score_holdout(models, df).withColumnRenamed("p_linear", "before")
    after = training.score_holdout(training.load_models(path, ["linear"]), df)
    same = before.join(after, [KEY, TIME, "horizon"]).groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("before") - F.col("p_linear"))).alias("max_difference")
    )
    same = stored(same, "differences")
    df.unpersist()
    return same


@query("registry_entries")
def registry_entries(spark, sf_dir):
    scores = _fit_and_score(spark, sf_dir, ["linear"], huber=False)
    entries = training.registry_entries(scores, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "models")
    return latest_artifacts(entries)


@query("tune_search")
def tune_search(spark, sf_dir):
    df, names = frame(spark, sf_dir)
    trials = tuning.draw_trials({"trees": [10, 20], "depth": [4, 6, 8], "min_leaf": [1, 5, 20], "features": ["sqrt", "0.6"]}, 3)
    found = tuning.tune(train_rows(df), TARGETS[0], lambda **kw: trees.forest(names, TARGETS[0], **kw), trials)
    df.unpersist()
    return spark.createDataFrame(found, "trial int, folds int, cv_rmse double, trees int, depth int, min_leaf int, features string")


@query("tree_importance")
def tree_importance(spark, sf_dir):
    df, names = frame(spark, sf_dir)
    model = trees.fit_rows(trees.forest(names, TARGETS[0], trees=TREES), train_rows(df), TARGETS[0])
    df.unpersist()
    return trees.importance(model, names, spark)


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    df, names = frame(spark, sf_dir)
    model = trees.fit_rows(trees.forest(names, TARGETS[0], trees=TREES), train_rows(df), TARGETS[0])
    out = stored(trees.permutation_importance(model, df.where(F.col("split") == "test"), names, TARGETS[0]), "importance")
    df.unpersist()
    return out


@query("isotonic_calibrate")
def isotonic(spark, sf_dir):
    preds = src.preds(spark, sf_dir).dropna(subset=["y_true"])
    out = isotonic_calibrate(preds, preds, "horizon", "y_true", "p_linear", "calibrated_p")
    return out.select(KEY, "day", "horizon", "y_true", "p_linear", "calibrated_p")


@query(
    "train_stack_forecast",
    f"WITH {src.SERIES} SELECT station_id, 3 AS n_horizons, CAST({3 * (HOLDOUT // 2)} AS BIGINT) AS n_calibrated, "
    "CAST(max(day) + 1 AS DATE) AS first_day, true AS in_range, true AS blend_matches, true AS alert_matches, "
    "true AS weights_sum_to_one FROM series GROUP BY 1",
)
def train_stack_forecast(spark, sf_dir):
    """From features to forecast records, with all families: the exact properties of the result.

    The older half of the holdout's predictions gives weights and calibration, which are applied
    to the newer half; the weights then blend the forecasts of the newest rows.
    """
    models, df, _ = training.train_families(
        series_features(spark, sf_dir), HOLDOUT, FAMILIES, rounds=ROUNDS, n_trees=TREES, huber=False
    )
    preds = stored(training.score_holdout(models, df), "holdout")
    latest = stored(training.score_latest(models, df), "latest")
    df.unpersist()
    blended, weights = stack(preds, KEY, TIME, holdout=HOLDOUT // 2, nonneg=True, sum_to_one=True, calibrate=True)
    weights = stored(weights, "weights")
    calibrated = blended.where(F.col("blend").between(AQI_MIN, AQI_MAX)).groupBy(KEY).agg(F.count(F.lit(1)).alias("n_calibrated"))
    records = forecast_records(latest, weights, F.to_date("latest_feature_timestamp"))
    maps = weights_by_horizon(weights).select("horizon", "_w")
    rows = records.select(
        KEY, "forecast_dates", "alert", F.explode("blend").alias("horizon", "blend"), *FAMILIES
    ).join(maps, "horizon")
    w = [F.col("_w")[f] for f in FAMILIES]
    total = sum(w[1:], w[0])
    value = sum((F.col(f)[F.col("horizon")] * x for f, x in zip(FAMILIES, w)), F.lit(0.0)) / total
    close = lambda a, b: F.abs(a - b) < 1e-6
    checked = rows.groupBy(KEY).agg(
        F.count(F.lit(1)).cast("int").alias("n_horizons"),
        F.first(F.col("forecast_dates")[0]).alias("first_day"),
        F.bool_and(F.col("blend").between(AQI_MIN, AQI_MAX)).alias("in_range"),
        F.bool_and(close(F.col("blend"), clamp(value, AQI_MIN, AQI_MAX))).alias("blend_matches"),
        F.bool_and((F.col("horizon") != HORIZONS[0]) | F.col("alert").eqNullSafe(alert_level(F.col("blend")))).alias("alert_matches"),
        F.bool_and(close(total, F.lit(1.0))).alias("weights_sum_to_one"),
    )
    return checked.join(calibrated, KEY).select(
        KEY, "n_horizons", "n_calibrated", "first_day", "in_range", "blend_matches", "alert_matches", "weights_sum_to_one"
    )
