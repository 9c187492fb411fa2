"""Blend weights, blending, attribution and forecast records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution
from ..operators import blend as ops
from ..operators.windows import latest
from ..plans import evaluation, scoring
from ..schemas import FAMILIES, KEY, TIME
from ..session import work_path
from ..sources import files
from . import inputs as src
from . import query
from .aggregates import SCORE_SQL, _rounded
from .cleaning import SPLIT, split_daily
from .ordered import RAW_WEIGHTS, SIMPLEX, raw_weights

PAIR = ["lightgbm", "randomforest"]
# least squares of two models from their sums of products, {src} has y_true, p_lightgbm, p_randomforest
PAIR_SUMS = (
    "sums AS (SELECT horizon, sum(p_lightgbm * p_lightgbm) AS a, sum(p_lightgbm * p_randomforest) AS b, "
    "sum(p_randomforest * p_randomforest) AS d, sum(p_lightgbm * y_true) AS u, sum(p_randomforest * y_true) AS v "
    "FROM {src} GROUP BY 1), w2 AS (SELECT horizon, (u * d - v * b) / (a * d - b * b) AS w_lightgbm, "
    "(v * a - u * b) / (a * d - b * b) AS w_randomforest FROM sums)"
)


def scored_preds(spark, sf_dir):
    return src.preds(spark, sf_dir).dropna(subset=["y_true"])


@query(
    "blend_weights_2",
    f"WITH {src.PREDS}, p AS (SELECT * FROM preds WHERE y_true IS NOT NULL), {PAIR_SUMS.format(src='p')} "
    "SELECT horizon, 'lightgbm' AS model, round(w_lightgbm, 6) AS weight FROM w2 UNION ALL "
    "SELECT horizon, 'randomforest', round(w_randomforest, 6) FROM w2",
)
def blend_weights_2(spark, sf_dir):
    out = ops.blend_weights(scored_preds(spark, sf_dir), ["horizon"], "y_true", [f"p_{f}" for f in PAIR], PAIR)
    return out.withColumn("weight", F.round("weight", 6))


@query("blend_weights_4")
def blend_weights_4(spark, sf_dir):
    cols = [f"p_{f}" for f in FAMILIES]
    return ops.blend_weights(
        scored_preds(spark, sf_dir), ["horizon"], "y_true", cols, FAMILIES, nonneg=True, sum_to_one=True
    )


# hgbr has no prediction above 250
HOLES = (
    "holes AS (SELECT station_id, day, horizon, p_lightgbm, p_linear, "
    "CASE WHEN p_hgbr <= 250 THEN p_hgbr END AS p_hgbr, p_randomforest FROM preds)"
)


def with_holes(spark, sf_dir):
    p = src.preds(spark, sf_dir).drop("y_true")
    return p.withColumn("p_hgbr", F.when(F.col("p_hgbr") <= 250, F.col("p_hgbr")))


_VALUE = " + ".join(f"coalesce(w_{f} * p_{f}, 0)" for f in FAMILIES)
_TOTAL = " + ".join(f"CASE WHEN p_{f} IS NOT NULL THEN w_{f} ELSE 0 END" for f in FAMILIES)


def _blend_sql(weights: str) -> str:
    picks = ", ".join(f"max(CASE WHEN model = '{f}' THEN weight END) AS w_{f}" for f in FAMILIES)
    return (
        f"w AS (SELECT horizon, {picks} FROM {weights} GROUP BY 1), "
        f"j AS (SELECT h.*, w.horizon IS NOT NULL AS has, {_VALUE} AS value, {_TOTAL} AS total, "
        + " + ".join(f"w_{f}" for f in FAMILIES)
        + " AS expected FROM holes h LEFT JOIN w USING (horizon)) "
        "SELECT station_id, day, horizon, round(CASE WHEN NOT has THEN coalesce(p_lightgbm, p_linear, p_hgbr, "
        "p_randomforest) WHEN total > 0 THEN least(greatest(value / total, 0), 500) END, 6) AS blend, "
        "round(CASE WHEN has THEN total / expected END, 6) AS coverage, "
        "CASE WHEN has THEN round(total / expected, 9) < 0.95 END AS low_coverage FROM j"
    )


@query("blend_apply", f"WITH {SIMPLEX}, {HOLES}, {_blend_sql('simplex')}")
def blend_apply(spark, sf_dir):
    weights = ops.project_to_simplex(raw_weights(spark, sf_dir), ["horizon"])
    out = ops.blend_apply(with_holes(spark, sf_dir), weights, [KEY, "day"])
    return out.withColumns({"blend": F.round("blend", 6), "coverage": F.round("coverage", 6)})


@query(
    "blend_fallback",
    f"WITH {src.PREDS}, x AS (SELECT station_id, day, horizon, CASE WHEN p_lightgbm <= 200 THEN p_lightgbm END AS a, "
    "CASE WHEN p_linear <= 250 THEN p_linear END AS b, p_hgbr AS c FROM preds) "
    "SELECT station_id, day, horizon, round(coalesce(a, b, c), 6) AS blend FROM x",
)
def blend_fallback(spark, sf_dir):
    p = src.preds(spark, sf_dir)
    p = p.withColumns({
        "p_lightgbm": F.when(F.col("p_lightgbm") <= 200, F.col("p_lightgbm")),
        "p_linear": F.when(F.col("p_linear") <= 250, F.col("p_linear")),
    })
    return p.select(KEY, "day", "horizon", F.round(ops.blend_fallback(p), 6).alias("blend"))


@query(
    "model_contributions",
    f"WITH {SIMPLEX} SELECT horizon, model, round(weight, 6) AS contribution FROM simplex "
    "ORDER BY abs(weight) DESC, model",
)
def model_contributions(spark, sf_dir):
    w = ops.project_to_simplex(raw_weights(spark, sf_dir), ["horizon"])
    ranked = w.orderBy(F.abs("weight").desc(), "model")
    return ranked.select("horizon", "model", F.round("weight", 6).alias("contribution"))


STACK = (
    f"{src.PREDS}, b AS (SELECT *, (row_number() OVER (PARTITION BY station_id, horizon ORDER BY day DESC) - 1) // 90 "
    f"AS block FROM preds WHERE y_true IS NOT NULL), fit AS (SELECT * FROM b WHERE block = 1), "
    f"{PAIR_SUMS.format(src='fit')}, blended AS (SELECT station_id, day, horizon, y_true, "
    "CASE WHEN w_lightgbm + w_randomforest > 0 THEN least(greatest((w_lightgbm * p_lightgbm + w_randomforest * "
    "p_randomforest) / (w_lightgbm + w_randomforest), 0), 500) END AS y_pred FROM b JOIN w2 USING (horizon) "
    "WHERE block = 0)"
)


def stack_pair(spark, sf_dir):
    return evaluation.stack(src.preds(spark, sf_dir), KEY, "day", families=PAIR)[0]


@query("stack_two_models", f"WITH {STACK} SELECT station_id, day, horizon, y_true, round(y_pred, 4) AS blend FROM blended")
def stack_two_models(spark, sf_dir):
    out = stack_pair(spark, sf_dir)
    return out.select(KEY, "day", "horizon", "y_true", F.round("blend", 4).alias("blend"))


@query(
    "stack_metrics",
    f"WITH {STACK}, scoped AS (SELECT *, 'full' AS scope FROM blended UNION ALL SELECT *, 'last' FROM blended "
    "QUALIFY row_number() OVER (PARTITION BY station_id, horizon ORDER BY day DESC) <= 30) "
    f"SELECT horizon, scope, {SCORE_SQL} FROM scoped GROUP BY 1, 2",
)
def stack_metrics(spark, sf_dir):
    return _rounded(evaluation.stack_metrics(stack_pair(spark, sf_dir), KEY, "day"))


@query("stack_four_models")
def stack_four_models(spark, sf_dir):
    blended, _ = evaluation.stack(
        src.preds(spark, sf_dir), KEY, "day", nonneg=True, sum_to_one=True, calibrate=True
    )
    return evaluation.stack_metrics(blended, KEY, "day")


COEFS = {"pm25": 0.5, "co": -0.25, "temperature": 0.125}
OTHER_COEFS = {"pm25": 0.25, "co": 0.5, "temperature": -0.5}


def _attr_sql(coefs, prefix: str) -> str:
    return ", ".join(
        f"({c} - avg(CASE WHEN split = 'train' THEN {c} END) OVER (PARTITION BY station_id)) * {v}E0 AS {prefix}{c}"
        for c, v in coefs.items()
    )


@query(
    "linear_attribution",
    f"WITH {SPLIT} SELECT station_id, event_timestamp, {_attr_sql(COEFS, 'a_')} FROM split",
)
def linear_attribution(spark, sf_dir):
    df = split_daily(spark, sf_dir).withColumn("_t", F.col("split") == "train")
    return attribution.linear_attribution(df, KEY, COEFS, "_t").select(KEY, TIME, *[f"a_{c}" for c in COEFS])


_ENSEMBLE = " UNION ALL ".join(
    f"SELECT w.horizon, '{c}' AS feature, round(avg(abs((w_lightgbm * a_{c} + w_linear * b_{c}) / "
    f"(abs(w_lightgbm) + abs(w_linear)))), 4) AS mean_abs FROM x CROSS JOIN w GROUP BY 1"
    for c in COEFS
)


@query(
    "ensemble_attribution",
    f"WITH {RAW_WEIGHTS}, {SPLIT}, "
    f"x AS (SELECT {_attr_sql(COEFS, 'a_')}, {_attr_sql(OTHER_COEFS, 'b_')} FROM split), "
    "w AS (SELECT horizon, max(CASE WHEN model = 'lightgbm' THEN weight END) AS w_lightgbm, "
    f"max(CASE WHEN model = 'linear' THEN weight END) AS w_linear FROM raw GROUP BY 1) {_ENSEMBLE}",
)
def ensemble_attribution(spark, sf_dir):
    df = split_daily(spark, sf_dir).withColumn("_t", F.col("split") == "train")
    first = attribution.linear_attribution(df, KEY, COEFS, "_t")
    both = first.withColumn("lightgbm", F.array(*[f"a_{c}" for c in COEFS])).drop(*[f"a_{c}" for c in COEFS])
    both = attribution.linear_attribution(both, KEY, OTHER_COEFS, "_t")
    both = both.withColumn("linear", F.array(*[f"a_{c}" for c in COEFS]))
    rows = both.select("lightgbm", "linear", F.explode(F.array(*map(F.lit, ("hd1", "hd2", "hd3")))).alias("horizon"))
    out = attribution.ensemble_attribution(
        rows, raw_weights(spark, sf_dir), {"lightgbm": "lightgbm", "linear": "linear"}, list(COEFS)
    )
    return out.withColumn("mean_abs", F.round("mean_abs", 4))


def records(spark, sf_dir):
    """Forecast of the newest row per station, with weights from all scored rows."""
    newest = latest(src.preds(spark, sf_dir).withColumn("_s", F.struct(KEY, "horizon")), "_s", ["day"])
    newest = newest.drop("_s", "y_true").withColumn(TIME, F.col("day").cast("timestamp_ntz")).drop("day")
    weights = ops.project_to_simplex(raw_weights(spark, sf_dir), ["horizon"])
    return scoring.forecast_records(newest, weights, F.date_add(F.lit("2001-08-01").cast("date"), 0))


_MAX3 = ", ".join(f"round(max(CASE WHEN horizon = 'hd{i}' THEN blend END), 6) AS blend_hd{i}" for i in (1, 2, 3))


@query(
    "forecast_record",
    f"WITH {SIMPLEX}, w AS (SELECT horizon, "
    + ", ".join(f"max(CASE WHEN model = '{f}' THEN weight END) AS w_{f}" for f in FAMILIES)
    + " FROM simplex GROUP BY 1), newest AS (SELECT * FROM preds QUALIFY row_number() OVER (PARTITION BY station_id, "
    "horizon ORDER BY day DESC) = 1), b AS (SELECT station_id, day, horizon, p_lightgbm, "
    f"least(greatest(({_VALUE}) / ({_TOTAL}), 0), 500) AS blend FROM newest JOIN w USING (horizon)) "
    f"SELECT station_id, CAST(max(day) AS TIMESTAMP) AS latest_feature_timestamp, {_MAX3}, "
    "max(p_lightgbm) AS lightgbm_hd1, DATE '2001-08-02' AS day_1, DATE '2001-08-04' AS day_3, "
    "CASE WHEN blend_hd1 >= 200 THEN 'hazardous' WHEN blend_hd1 >= 150 THEN 'unhealthy' ELSE 'ok' END AS alert "
    "FROM b GROUP BY 1",
)
def forecast_record(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.select(
        KEY, "latest_feature_timestamp",
        *[F.round(F.col("blend")[f"hd{i}"], 6).alias(f"blend_hd{i}") for i in (1, 2, 3)],
        F.col("lightgbm")["hd1"].alias("lightgbm_hd1"),
        F.col("forecast_dates")[0].alias("day_1"), F.col("forecast_dates")[2].alias("day_3"), "alert",
    )


@query(
    "choose_series",
    f"WITH {src.PREDS} SELECT station_id, DATE '2001-08-01' + CAST(horizon[3:] AS INTEGER) AS day, horizon, "
    "p_linear AS value FROM preds QUALIFY row_number() OVER (PARTITION BY station_id, horizon ORDER BY preds.day DESC) = 1",
)
def choose_series(spark, sf_dir):
    return scoring.choose_series(records(spark, sf_dir), "linear")


@query("forecast_json")
def forecast_json(spark, sf_dir):
    path = work_path(spark, "forecast")
    files.write_json_lines(records(spark, sf_dir), path)
    return spark.read.text(path)

