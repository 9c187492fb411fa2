"""Aggregation and profiling queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics, profile
from ..operators.attribution import mean_abs_attribution
from ..operators.blend import gram_long
from ..operators.encode import add_calendar, one_hot
from ..operators.folds import forward_folds
from ..operators.quantiles import exact_quantiles, unpivot
from ..operators.windows import last_n
from ..schemas import FAMILIES, HORIZONS, KEY, MEASURES, SEASONS, TIME
from ..session import stored
from ..sources.artifacts import artifact_matrix as matrix
from . import inputs as src
from . import query
from .features import SEASON_SQL
from .ordered import NUMBERED

LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LONG_M = src.DAILY_M + ", long_m AS (SELECT station_id, event_timestamp, measure, value FROM (UNPIVOT daily_m ON " + \
    ", ".join(MEASURES) + " INTO NAME measure VALUE value) u)"


def long_m(spark, sf_dir):
    """Daily measures in thousandths, one row per measure.

    Profiling takes several passes, so the daily table is stored first, as in practice.
    """
    daily = stored(src.daily_m(spark, sf_dir), "daily")
    return unpivot(daily, [KEY, TIME], MEASURES).dropna(subset=["value"])


@query(
    "quartiles",
    f"WITH {LONG_M} SELECT measure, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, "
    "quantile_cont(value, 0.75) AS p75 FROM long_m GROUP BY measure",
)
def quartiles(spark, sf_dir):
    return exact_quantiles(
        long_m(spark, sf_dir), ["measure"], "value", [0.25, 0.5, 0.75], ["p25", "p50", "p75"], digits=0
    )


@query(
    "column_means",
    f"WITH {src.DAILY_M} SELECT " + ", ".join(f"avg({m}) AS {m}" for m in MEASURES) + " FROM daily_m",
)
def column_means(spark, sf_dir):
    return profile.column_means(src.daily_m(spark, sf_dir), [], MEASURES)


_CAT = "CASE WHEN {x} <= 50 THEN 1 WHEN {x} <= 100 THEN 2 WHEN {x} <= 150 THEN 3 WHEN {x} <= 200 THEN 4 " \
    "WHEN {x} <= 300 THEN 5 ELSE 6 END"
SCORE_SQL = (
    "count(*) AS n, round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 6) AS rmse, "
    "round(avg(abs(y_true - y_pred)), 6) AS mae, "
    "round(1 - avg((y_true - y_pred) * (y_true - y_pred)) / var_pop(y_true), 6) AS r2, "
    "round(avg(abs(y_true - y_pred) / greatest(abs(y_true), 1.0E0)) * 100, 6) AS mape_pct, "
    f"round(avg(CASE WHEN {_CAT.format(x='y_true')} = {_CAT.format(x='y_pred')} THEN 1.0E0 ELSE 0 END), 6) AS acc_category, "
    "round(avg(CASE WHEN abs(y_true - y_pred) <= 15 THEN 1.0E0 ELSE 0 END), 6) AS acc_within_15"
)


def _rounded(df):
    return df.withColumns(
        {c: F.round(c, 6) for c in ("rmse", "mae", "r2", "mape_pct", "acc_category", "acc_within_15")}
    )


@query(
    "regression_metrics",
    f"WITH {src.PREDS_LONG} SELECT family, horizon, {SCORE_SQL} FROM preds_long WHERE y_true IS NOT NULL GROUP BY 1, 2",
)
def regression_metrics(spark, sf_dir):
    return _rounded(metrics.regression_metrics(src.preds_long(spark, sf_dir), ["family", "horizon"], "y_true", "y_pred"))


@query(
    "metrics_last30",
    f"WITH {src.PREDS_LONG}, recent AS (SELECT * FROM preds_long WHERE y_true IS NOT NULL QUALIFY row_number() OVER "
    "(PARTITION BY station_id, family, horizon ORDER BY day DESC) <= 30) "
    f"SELECT station_id, family, horizon, {SCORE_SQL} FROM recent GROUP BY 1, 2, 3",
)
def metrics_last30(spark, sf_dir):
    long = src.preds_long(spark, sf_dir).dropna(subset=["y_true"])
    recent = long.withColumn("_series", F.struct(KEY, "family", "horizon"))
    recent = last_n(recent, "_series", ["day"], 30)
    return _rounded(metrics.regression_metrics(recent, [KEY, "family", "horizon"], "y_true", "y_pred"))


def _describe_sql(c: str) -> str:
    return (
        f"SELECT '{c}' AS measure, count({c}) AS count, "
        f"CAST(sum(CAST(round({c} * 100) AS BIGINT)) AS DOUBLE) / 100.0E0 / count({c}) AS mean, "
        f"round(stddev_samp({c}), 4) AS std, min({c}) AS min, "
        + ", ".join(
            f"quantile_cont(CAST(round({c} * 100) AS BIGINT), {q}) / 100.0E0 AS {n}"
            for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))
        )
        + f", max({c}) AS max FROM lineitem"
    )


@query("describe_numeric", " UNION ALL ".join(_describe_sql(c) for c in LINE_COLS))
def describe_numeric(spark, sf_dir):
    df = profile.describe(src.table(spark, sf_dir, "lineitem"), LINE_COLS, digits=2)
    return df.withColumn("std", F.round("std", 4))


@query(
    "missing_per_column",
    f"WITH {src.DAILY} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) AS rows, count(*) - count({c}) AS missing FROM daily"
        for c, t in [(KEY, "bigint"), (TIME, "timestamp_ntz"), *[(m, "double") for m in MEASURES]]
    ),
)
def missing_per_column(spark, sf_dir):
    return profile.missing_per_column(src.daily(spark, sf_dir))


@query("date_range", "SELECT min(ts) AS first, max(ts) AS last, count(*) AS rows FROM events")
def date_range(spark, sf_dir):
    return profile.date_range(src.table(spark, sf_dir, "events"), "ts")


@query(
    "correlation_matrix",
    f"WITH {src.DAILY_M} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM daily_m" for a in MEASURES for b in MEASURES
    ),
)
def correlation_matrix(spark, sf_dir):
    df = profile.correlation_matrix(src.daily_m(spark, sf_dir), MEASURES)
    return df.withColumn("corr", F.round("corr", 6))


def _hist_sql(source: str, by: str, bins: int) -> str:
    return (
        f"b AS (SELECT {by}, min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / {bins} AS w "
        f"FROM {source} GROUP BY 1), x AS (SELECT {by}, lo, w, CAST(least(floor((value - lo) / w), {bins - 1}) AS BIGINT) "
        f"AS bin FROM {source} JOIN b USING ({by})) "
        f"SELECT {by}, bin, count(*) AS count, lo + bin * w AS bin_lo, lo + (bin + 1) * w AS bin_hi FROM x GROUP BY ALL"
    )


@query("histogram", f"WITH {LONG_M}, {_hist_sql('long_m', 'measure', 30)}")
def histogram(spark, sf_dir):
    return profile.histogram(long_m(spark, sf_dir), ["measure"], "value", 30)


@query(
    "season_distribution",
    f"WITH {src.SERIES}, flagged AS (SELECT {SEASON_SQL.replace('event_timestamp', 'day')} AS season, y AS value "
    f"FROM series), {_hist_sql('flagged', 'season', 20)}",
)
def season_distribution(spark, sf_dir):
    df = one_hot(add_calendar(src.series(spark, sf_dir), "day"), "season", SEASONS)
    flags = df.withColumnsRenamed({f"season_{s}": s for s in SEASONS})
    long = unpivot(flags, ["y"], SEASONS, "season", "flag").where(F.col("flag") == 1)
    return profile.histogram(long, ["season"], "y", 20)


@query(
    "boxplot_stats",
    f"WITH {src.SERIES}, g AS (SELECT CAST(month(day) AS INTEGER) AS month, y_c FROM series), q AS (SELECT month, "
    "quantile_cont(y_c, 0.25) AS a, quantile_cont(y_c, 0.5) AS m, quantile_cont(y_c, 0.75) AS b FROM g GROUP BY 1) "
    "SELECT month, a / 100.0E0 AS q1, m / 100.0E0 AS median, b / 100.0E0 AS q3, "
    "min(CASE WHEN y_c >= a - (b - a) * 1.5 AND y_c <= b + (b - a) * 1.5 THEN y_c END) / 100.0E0 AS whisker_lo, "
    "max(CASE WHEN y_c >= a - (b - a) * 1.5 AND y_c <= b + (b - a) * 1.5 THEN y_c END) / 100.0E0 AS whisker_hi, "
    "sum(CASE WHEN y_c >= a - (b - a) * 1.5 AND y_c <= b + (b - a) * 1.5 THEN 0 ELSE 1 END)::BIGINT AS outliers, "
    "count(*) AS count FROM g JOIN q USING (month) GROUP BY month, a, m, b",
)
def boxplot_stats(spark, sf_dir):
    df = src.series(spark, sf_dir).withColumn("month", F.month("day"))
    return profile.boxplot_stats(df, ["month"], "y", digits=2)


@query(
    "boxplot_weekday",
    "WITH g AS (SELECT isodow(l_shipdate)::INTEGER - 1 AS weekday, CAST(round(l_extendedprice * 100) AS BIGINT) AS v "
    "FROM lineitem), q AS (SELECT weekday, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS m, "
    "quantile_cont(v, 0.75) AS b FROM g GROUP BY 1) SELECT weekday, a / 100.0E0 AS q1, m / 100.0E0 AS median, "
    "b / 100.0E0 AS q3, min(CASE WHEN v >= a - (b - a) * 1.5 AND v <= b + (b - a) * 1.5 THEN v END) / 100.0E0 AS whisker_lo, "
    "max(CASE WHEN v >= a - (b - a) * 1.5 AND v <= b + (b - a) * 1.5 THEN v END) / 100.0E0 AS whisker_hi, "
    "sum(CASE WHEN v >= a - (b - a) * 1.5 AND v <= b + (b - a) * 1.5 THEN 0 ELSE 1 END)::BIGINT AS outliers, "
    "count(*) AS count FROM g JOIN q USING (weekday) GROUP BY weekday, a, m, b",
)
def boxplot_weekday(spark, sf_dir):
    df = src.table(spark, sf_dir, "lineitem").select(F.weekday("l_shipdate").alias("weekday"), "l_extendedprice")
    return profile.boxplot_stats(df, ["weekday"], "l_extendedprice", digits=2)


@query(
    "kde_grid",
    f"WITH {LONG_M}, s AS (SELECT measure, count(*) AS n, min(value) AS lo, max(value) AS hi, "
    "stddev_samp(value) * pow(count(*), -0.2E0) AS h FROM long_m GROUP BY 1), "
    "g AS (SELECT *, lo + (hi - lo) * i / 199 AS x FROM s CROSS JOIN range(200) r(i)), "
    "c AS (SELECT measure, value, count(*) AS c FROM long_m GROUP BY 1, 2) "
    "SELECT measure, CAST(i AS INTEGER) AS i, round(x, 6) AS x, "
    "round(sum(c * exp(-0.5E0 * pow((x - value) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) * 1000, 9) "
    "AS density FROM g JOIN c USING (measure) GROUP BY measure, i, x",
)
def kde_grid(spark, sf_dir):
    out = profile.kde_grid(long_m(spark, sf_dir), ["measure"], "value", 200)
    # thousandths on the value axis, so per unit the density is 1000 times higher
    return out.withColumn("x", F.round("x", 6)).withColumn("density", F.round(F.col("density") * 1000.0, 9))


ATTRIBUTED = ["pm25", "co", "temperature"]


@query(
    "mean_abs_attribution",
    f"WITH {LONG_M} SELECT measure AS feature, round(avg(abs(value - m)), 6) AS mean_abs FROM long_m "
    "JOIN (SELECT station_id, measure, avg(value) AS m FROM long_m GROUP BY 1, 2) USING (station_id, measure) "
    "WHERE measure IN ('pm25', 'co', 'temperature') GROUP BY 1",
)
def mean_abs_attribution_(spark, sf_dir):
    df = src.daily_m(spark, sf_dir)
    w = Window.partitionBy(KEY)
    df = df.withColumns({f"a_{c}": F.col(c) - F.avg(c).over(w) for c in ATTRIBUTED})
    out = mean_abs_attribution(df, [], {c: f"a_{c}" for c in ATTRIBUTED})
    return out.withColumn("mean_abs", F.round("mean_abs", 6))


@query(
    "gram_matrix",
    f"WITH {src.PREDS}, p AS (SELECT horizon, round(y_true * 100) AS y_true, "
    + ", ".join(f"floor(p_{f} * 100) AS p_{f}" for f in FAMILIES) + " FROM preds WHERE y_true IS NOT NULL) "
    + " UNION ALL ".join(
        f"SELECT horizon, 'p_{a}' AS a, 'p_{b}' AS b, sum(p_{a} * p_{b}) AS total FROM p GROUP BY 1"
        for i, a in enumerate(FAMILIES)
        for b in FAMILIES[i:]
    )
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT horizon, 'p_{a}', 'y_true', sum(p_{a} * y_true) FROM p GROUP BY 1" for a in FAMILIES
    ),
)
def gram_matrix(spark, sf_dir):
    # in whole hundredths, so that the sums of products are exact
    df = src.preds(spark, sf_dir).dropna(subset=["y_true"]).withColumn("y_true", F.rint(F.col("y_true") * 100.0))
    df = df.withColumns({f"p_{f}": F.floor(F.col(f"p_{f}") * 100.0).cast("double") for f in FAMILIES})
    return gram_long(df, ["horizon"], "y_true", [f"p_{f}" for f in FAMILIES])


@query(
    "cv_mean_rmse",
    f"WITH {src.PREDS_LONG}, {NUMBERED}, "
    "v AS (SELECT p.family, p.horizon, f.fold, p.y_true, p.y_pred FROM preds_long p JOIN numbered s "
    "USING (station_id, day) CROSS JOIN (VALUES (1), (2), (3)) f(fold) WHERE p.y_true IS NOT NULL "
    "AND s.pos >= s.n - (4 - f.fold) * (s.n // 4) AND s.pos < s.n - (3 - f.fold) * (s.n // 4)), "
    "r AS (SELECT family, horizon, fold, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse FROM v GROUP BY 1, 2, 3) "
    "SELECT family, horizon, round(avg(rmse), 6) AS cv_rmse, count(*) AS folds FROM r GROUP BY 1, 2",
)
def cv_mean_rmse(spark, sf_dir):
    wide = src.preds(spark, sf_dir)
    per_day = wide.groupBy(KEY, "day").agg(
        F.collect_list(F.struct("horizon", "y_true", *[f"p_{f}" for f in FAMILIES])).alias("_h")
    )
    val = forward_folds(per_day, KEY, "day", 3).where(F.col("role") == "val")
    rows = val.select("fold", F.inline("_h")).dropna(subset=["y_true"])
    long = unpivot(
        rows.withColumnsRenamed({f"p_{f}": f for f in FAMILIES}), ["fold", "horizon", "y_true"], FAMILIES, "family", "y_pred"
    )
    out = metrics.cv_mean_rmse(long, ["family", "horizon"], "fold", "y_true", "y_pred")
    return out.withColumn("cv_rmse", F.round("cv_rmse", 6))


# a registry entry per event: the family by event type, the horizon by event number
REGISTRY = (
    "registry AS (SELECT CASE event_type WHEN 'view' THEN 'lightgbm' WHEN 'click' THEN 'linear' "
    "WHEN 'purchase' THEN 'hgbr' ELSE 'randomforest' END AS family, 'hd' || (event_id % 3 + 1) AS horizon, "
    "ts AS created, event_id FROM events WHERE NOT (event_type = 'purchase' AND event_id % 3 = 2))"
)


def registry(spark, sf_dir):
    kind, third = F.col("event_type"), F.col("event_id") % 3
    family = (
        F.when(kind == "view", "lightgbm").when(kind == "click", "linear").when(kind == "purchase", "hgbr")
        .otherwise("randomforest")
    )
    horizon = F.concat(F.lit("hd"), (third + 1).cast("string"))
    # hgbr has no model for the third horizon
    rows = src.table(spark, sf_dir, "events").where(~((kind == "purchase") & (third == 2)))
    return rows.select(family.alias("family"), horizon.alias("horizon"), F.col("ts").alias("created"), "event_id")


@query(
    "artifact_matrix",
    f"WITH {REGISTRY} SELECT family, bool_or(horizon = 'hd1') AS hd1, bool_or(horizon = 'hd2') AS hd2, "
    "bool_or(horizon = 'hd3') AS hd3 FROM registry GROUP BY family",
)
def artifact_matrix(spark, sf_dir):
    return matrix(registry(spark, sf_dir), FAMILIES, HORIZONS)
