"""Window and ordered operators, splits, sorting and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, sampling, windows
from ..operators.blend import project_to_simplex
from ..schemas import FAMILIES, KEY, TIME
from . import inputs as src
from . import query
from .features import FILL, ROLL, W


@query(
    "lag_features",
    f"WITH {src.DAILY} SELECT station_id, event_timestamp, aqi, lag(aqi, 1) OVER {W} AS aqi_lag_1, "
    f"lag(aqi, 2) OVER {W} AS aqi_lag_2 FROM daily",
)
def lag_features(spark, sf_dir):
    return windows.add_lags(src.daily(spark, sf_dir).select(KEY, TIME, "aqi"), KEY, TIME, "aqi")


@query(
    "target_features",
    f"WITH {src.DAILY} SELECT station_id, event_timestamp, aqi, "
    + ", ".join(f"lead(aqi, {h}) OVER {W} AS aqi_t{h}" for h in (1, 2, 3)) + " FROM daily",
)
def target_features(spark, sf_dir):
    return windows.add_targets(src.daily(spark, sf_dir).select(KEY, TIME, "aqi"), KEY, TIME, "aqi")


@query(
    "rolling_mean",
    f"WITH {src.DAILY} SELECT station_id, event_timestamp, round(avg(aqi) OVER {ROLL}, 6) AS aqi_roll_mean_3 FROM daily",
)
def rolling_mean(spark, sf_dir):
    df = windows.add_rolling(src.daily(spark, sf_dir), KEY, TIME, "aqi", std=False)
    return df.select(KEY, TIME, F.round("aqi_roll_mean_3", 6).alias("aqi_roll_mean_3"))


@query(
    "rolling_std",
    f"WITH {src.DAILY} SELECT station_id, event_timestamp, round(stddev_samp(aqi) OVER {ROLL}, 6) AS aqi_roll_std_3 "
    "FROM daily",
)
def rolling_std(spark, sf_dir):
    df = windows.add_rolling(src.daily(spark, sf_dir), KEY, TIME, "aqi")
    return df.select(KEY, TIME, F.round("aqi_roll_std_3", 6).alias("aqi_roll_std_3"))


@query(
    "diff_feature",
    f"WITH {src.DAILY} SELECT station_id, event_timestamp, round(aqi - lag(aqi, 1) OVER {W}, 6) AS aqi_diff FROM daily",
)
def diff_feature(spark, sf_dir):
    df = windows.add_diff(src.daily(spark, sf_dir), KEY, TIME, "aqi")
    return df.select(KEY, TIME, F.round("aqi_diff", 6).alias("aqi_diff"))


@query(
    "forward_fill",
    f"WITH {src.DAILY} SELECT station_id, event_timestamp, "
    + ", ".join(f"last_value({c} IGNORE NULLS) OVER {FILL} AS {c}" for c in ("aqi", "pm25", "co", "temperature"))
    + " FROM daily",
)
def forward_fill(spark, sf_dir):
    cols = ["aqi", "pm25", "co", "temperature"]
    return windows.forward_fill(src.daily(spark, sf_dir).select(KEY, TIME, *cols), KEY, TIME, cols)


@query(
    "last_n_per_station",
    "SELECT user_id AS station_id, ts AS time, event_id, value FROM events "
    "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 30",
)
def last_n_per_station(spark, sf_dir):
    ev = src.events(spark, sf_dir).select(KEY, "time", "event_id", "value")
    return windows.last_n(ev, KEY, ["time", "event_id"], 30)


@query(
    "latest_row",
    "SELECT user_id AS station_id, ts AS time, event_id, event_type, value FROM events "
    "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def latest_row(spark, sf_dir):
    ev = src.events(spark, sf_dir).select(KEY, "time", "event_id", "event_type", "value")
    return windows.latest(ev, KEY, ["time", "event_id"])


NUMBERED = (
    "numbered AS (SELECT station_id, day, y, row_number() OVER (PARTITION BY station_id ORDER BY day) - 1 AS pos, "
    "count(*) OVER (PARTITION BY station_id) AS n FROM series)"
)


@query(
    "holdout_split",
    f"WITH {src.SERIES}, {NUMBERED} SELECT station_id, day, y, "
    "CASE WHEN pos < n - 90 THEN 'train' ELSE 'test' END AS split FROM numbered",
)
def holdout_split(spark, sf_dir):
    df = src.series(spark, sf_dir).select(KEY, "day", "y")
    return folds.holdout_split(df, KEY, "day", 90)


@query(
    "train_val_cut",
    f"WITH {src.SERIES}, {NUMBERED} SELECT station_id, day, y, "
    "CASE WHEN pos < floor(n * 0.85E0) THEN 'train' ELSE 'val' END AS part FROM numbered",
)
def train_val_cut(spark, sf_dir):
    return folds.train_val_cut(src.series(spark, sf_dir).select(KEY, "day", "y"), KEY, "day")


EXPANDING = (
    f"{src.SERIES}, {NUMBERED}, "
    "ends AS (SELECT station_id, n, unnest([1, 2, 3]) AS fold, "
    "unnest([floor(n * 0.6E0), floor(floor(n * 0.75E0) * 0.85E0), floor(floor(n * 0.9E0) * 0.85E0)]) AS train_end, "
    "unnest([floor(n * 0.75E0), floor(n * 0.9E0), CAST(n AS DOUBLE)]) AS val_end "
    "FROM (SELECT DISTINCT station_id, n FROM numbered) d), "
    "ok AS (SELECT * FROM ends WHERE val_end - train_end >= 3 AND train_end >= 10)"
)


@query(
    "expanding_folds",
    f"WITH {EXPANDING} SELECT s.station_id, s.day, s.y, CAST(o.fold AS INTEGER) AS fold, "
    "CASE WHEN s.pos < o.train_end THEN 'train' ELSE 'val' END AS role "
    "FROM numbered s JOIN ok o USING (station_id) WHERE s.pos < o.val_end",
)
def expanding_folds(spark, sf_dir):
    return folds.expanding_folds(src.series(spark, sf_dir).select(KEY, "day", "y"), KEY, "day")


@query(
    "forward_folds",
    f"WITH {src.SERIES}, {NUMBERED} SELECT station_id, day, y, CAST(f.fold AS INTEGER) AS fold, "
    "CASE WHEN pos < n - (4 - f.fold) * (n // 4) THEN 'train' ELSE 'val' END AS role "
    "FROM numbered CROSS JOIN (VALUES (1), (2), (3)) f(fold) WHERE pos < n - (3 - f.fold) * (n // 4)",
)
def forward_folds(spark, sf_dir):
    return folds.forward_folds(src.series(spark, sf_dir).select(KEY, "day", "y"), KEY, "day", 3)


def raw_weights(spark, sf_dir):
    """A weight per horizon and family: best factor of the family alone, stretched."""
    y, p = F.col("y_true"), F.col("y_pred")
    long = src.preds_long(spark, sf_dir).where(y.isNotNull())
    factor = F.sum(y * p) / F.sum(p * p)
    return long.groupBy("horizon", F.col("family").alias("model")).agg(
        F.round(factor * 4.0 - 3.0, 6).alias("weight")
    )


RAW_WEIGHTS = src.PREDS_LONG + (
    ", raw AS (SELECT horizon, family AS model, round(sum(y_true * y_pred) / sum(y_pred * y_pred) * 4.0E0 - 3.0E0, 6) "
    "AS weight FROM preds_long WHERE y_true IS NOT NULL GROUP BY 1, 2)"
)
SIMPLEX = RAW_WEIGHTS + (
    ", ranked AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY weight DESC, model) AS k, "
    "sum(weight) OVER (PARTITION BY horizon ORDER BY weight DESC, model) AS c FROM raw), "
    "theta AS (SELECT horizon, arg_max((c - 1) / k, k) AS theta FROM ranked WHERE weight * k > c - 1 GROUP BY 1), "
    "simplex AS (SELECT horizon, model, greatest(weight - theta, 0) AS weight FROM raw JOIN theta USING (horizon))"
)


@query("simplex_projection", f"WITH {SIMPLEX} SELECT horizon, model, round(weight, 6) AS weight FROM simplex")
def simplex_projection(spark, sf_dir):
    out = project_to_simplex(raw_weights(spark, sf_dir), ["horizon"])
    return out.withColumn("weight", F.round("weight", 6))


@query(
    "sort_by_time",
    "SELECT user_id AS station_id, ts AS time, event_id FROM events ORDER BY time, event_id",
)
def sort_by_time(spark, sf_dir):
    return src.events(spark, sf_dir).select(KEY, "time", "event_id").orderBy("time", "event_id")


OTHERS = ["pm25", "pm10", "no2", "so2", "co", "o3", "temperature", "humidity", "precipitation"]


@query(
    "top_features",
    f"WITH {src.DAILY_M} SELECT * FROM (SELECT unnest([" + ", ".join(f"'{m}'" for m in OTHERS) + "]) AS feature, "
    "unnest([" + ", ".join(f"round(abs(corr({m}, aqi)), 6)" for m in OTHERS) + "]) AS score FROM daily_m) u "
    "ORDER BY score DESC, feature LIMIT 5",
)
def top_features(spark, sf_dir):
    row = src.daily_m(spark, sf_dir).agg(*[F.round(F.abs(F.corr(m, "aqi")), 6).alias(m) for m in OTHERS])
    return sampling.top_by(row.unpivot([], OTHERS, "feature", "score"), "score", 5, "feature")


@query("sort_abs", f"WITH {RAW_WEIGHTS} SELECT horizon, model, weight FROM raw ORDER BY abs(weight) DESC, model")
def sort_abs(spark, sf_dir):
    return sampling.sort_abs(raw_weights(spark, sf_dir), "weight", "model")


@query(
    "capped_sample",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem ORDER BY "
    "md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), "
    "l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5000",
)
def capped_sample(spark, sf_dir):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return sampling.capped_sample(src.table(spark, sf_dir, "lineitem").select(*key, "l_quantity"), key)
