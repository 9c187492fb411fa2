"""Projection, coercion, clamping and imputation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as ops
from ..operators import folds
from ..schemas import CAPPED, CONTRACT, KEY, MEASURES, PUBLISHED, TIME
from ..sources.files import rows_as_json
from . import inputs as src
from . import query
from .features import FEATURES, rounded_features

IMPUTED = ["aqi", "pm25", "co", "temperature"]
HOLDOUT = 3
SPLIT = (
    f"{src.DAILY_M}, split AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY station_id ORDER BY "
    f"event_timestamp DESC) <= {HOLDOUT} THEN 'test' ELSE 'train' END AS split FROM daily_m)"
)


def split_daily(spark, sf_dir):
    """Daily measures in thousandths with the role of the row."""
    return folds.holdout_split(src.daily_m(spark, sf_dir), KEY, TIME, HOLDOUT)


def _published(cols):
    return ", ".join(f'{c} AS "{PUBLISHED.get(c, c)}"' for c in cols)


@query("select_features", f"WITH {FEATURES} SELECT {', '.join(CONTRACT)} FROM features")
def select_features(spark, sf_dir):
    return ops.select_features(rounded_features(spark, sf_dir))


@query(
    "rename_columns",
    f"WITH {src.DAILY} SELECT station_id, event_timestamp, {_published(MEASURES)} FROM daily",
)
def rename_columns(spark, sf_dir):
    return ops.rename(src.daily(spark, sf_dir), PUBLISHED)


RAW_TEXT = (
    "CASE WHEN event_type = 'error' THEN 'n/a' WHEN event_type = 'signup' THEN 'inf' "
    "WHEN event_type = 'click' THEN 'NaN' ELSE CAST(value AS VARCHAR) END"
)


@query(
    "coerce_numeric",
    f"SELECT event_id, CASE WHEN isfinite(x) THEN x END AS reading FROM (SELECT event_id, "
    f"TRY_CAST({RAW_TEXT} AS DOUBLE) AS x FROM events)",
)
def coerce_numeric(spark, sf_dir):
    kind = F.col("event_type")
    text = (
        F.when(kind == "error", "n/a").when(kind == "signup", "inf").when(kind == "click", "NaN")
        .otherwise(F.col("value").cast("string"))
    )
    raw = src.table(spark, sf_dir, "events").select("event_id", text.alias("reading"))
    return ops.coerce_numeric(raw, ["reading"])


@query(
    "normalize_ts",
    "SELECT event_id, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS event_timestamp FROM events",
)
def normalize_ts(spark, sf_dir):
    text = F.when(F.col("event_type") == "error", "not a time").otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    )
    raw = src.table(spark, sf_dir, "events").select("event_id", text.alias(TIME))
    return ops.normalize_time(raw, TIME)


@query("legacy_ts_column", f"WITH {src.DAILY} SELECT station_id, event_timestamp, aqi FROM daily")
def legacy_ts_column(spark, sf_dir):
    old = src.daily(spark, sf_dir).select(KEY, F.date_format(TIME, "yyyy-MM-dd").alias("date"), "aqi")
    return ops.legacy_time(old)


@query(
    "drop_null_target",
    f"WITH {FEATURES} SELECT station_id, event_timestamp, aqi_t1 FROM features WHERE aqi_t1 IS NOT NULL",
)
def drop_null_target(spark, sf_dir):
    return ops.drop_null_target(src.features(spark, sf_dir).select(KEY, TIME, "aqi_t1"), "aqi_t1")


@query(
    "clamp_range",
    f"WITH {src.READINGS} SELECT event_id, CASE WHEN aqi IS NOT NULL THEN least(greatest(aqi * 4 - 20, 0), 500) END "
    "AS aqi FROM readings",
)
def clamp_range(spark, sf_dir):
    df = src.readings(spark, sf_dir).select("event_id", (F.col("aqi") * 4 - 20).alias("aqi"))
    return ops.clamp_columns(df, ["aqi"], 0, 500)


@query(
    "row_to_json",
    f"WITH {src.DAILY_M} SELECT '{{\"station_id\":' || station_id || ',\"day\":\"' || CAST(event_timestamp AS DATE) || "
    "'\",\"aqi\":' || coalesce(CAST(CAST(aqi AS BIGINT) AS VARCHAR), 'null') || ',\"co\":' || "
    "coalesce(CAST(CAST(co AS BIGINT) AS VARCHAR), 'null') || '}' AS json FROM daily_m",
)
def row_to_json(spark, sf_dir):
    df = src.daily_m(spark, sf_dir).select(
        KEY, F.date_format(TIME, "yyyy-MM-dd").alias("day"), F.col("aqi").cast("bigint"), F.col("co").cast("bigint")
    )
    return rows_as_json(df)


_CONTRACT_SQL = ", ".join(
    "0.0E0 AS humidity" if c == "humidity" else f"coalesce(CAST({c} AS DOUBLE), 0.0E0) AS {c}" for c in CONTRACT
)


@query("align_contract", f"WITH {FEATURES} SELECT station_id, event_timestamp, {_CONTRACT_SQL} FROM features")
def align_contract(spark, sf_dir):
    df = rounded_features(spark, sf_dir).drop("humidity")
    return ops.align_contract(df, CONTRACT, [KEY, TIME])


@query("drop_all_null_cols", f"WITH {src.DAILY} SELECT station_id, event_timestamp, aqi, co FROM daily")
def drop_all_null_cols(spark, sf_dir):
    df = src.daily(spark, sf_dir).select(KEY, TIME, "aqi", "co", F.lit(None).cast("double").alias("visibility"))
    return ops.drop_all_null(df, ["aqi", "co", "visibility"])


def _cols(fmt: str) -> str:
    return ", ".join(fmt.format(c=c) for c in IMPUTED)


@query(
    "impute_train_mean",
    f"WITH {SPLIT} SELECT station_id, event_timestamp, split, "
    + _cols("coalesce({c}, avg(CASE WHEN split = 'train' THEN {c} END) OVER (PARTITION BY station_id)) AS {c}")
    + " FROM split",
)
def impute_train_mean(spark, sf_dir):
    df = split_daily(spark, sf_dir).withColumn("_train", F.col("split") == "train")
    return ops.impute_train_mean(df, KEY, IMPUTED, "_train").select(KEY, TIME, "split", *IMPUTED)


@query(
    "impute_self_mean",
    f"WITH {SPLIT} SELECT station_id, event_timestamp, split, "
    + _cols("coalesce({c}, avg({c}) OVER (PARTITION BY station_id, split)) AS {c}") + " FROM split",
)
def impute_self_mean(spark, sf_dir):
    df = split_daily(spark, sf_dir).select(KEY, TIME, "split", *IMPUTED)
    return ops.impute_self_mean(df, [KEY, "split"], IMPUTED)


@query(
    "impute_zero",
    f"WITH {SPLIT} SELECT station_id, event_timestamp, split, " + _cols("coalesce({c}, 0.0E0) AS {c}") + " FROM split",
)
def impute_zero(spark, sf_dir):
    return ops.impute_zero(split_daily(spark, sf_dir).select(KEY, TIME, "split", *IMPUTED), IMPUTED)


@query(
    "impute_latest_hist",
    f"WITH {src.DAILY_M}, m AS (SELECT station_id, " + _cols("avg({c}) AS m_{c}") + " FROM daily_m GROUP BY 1), "
    "l AS (SELECT * FROM daily_m QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY event_timestamp DESC) = 1) "
    "SELECT station_id, event_timestamp, " + _cols("coalesce({c}, m_{c}, 0) AS {c}") + " FROM l JOIN m USING (station_id)",
)
def impute_latest_hist(spark, sf_dir):
    df = src.daily_m(spark, sf_dir).select(KEY, TIME, *IMPUTED)
    return ops.impute_latest_from_history(df, KEY, TIME, IMPUTED)


_BOUNDS = ", ".join(
    f"quantile_cont({c}, 0.25) AS lo_{c}, quantile_cont({c}, 0.75) AS hi_{c}" for c in CAPPED
)
_CAP = ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, lo_{c} - (hi_{c} - lo_{c}) * 1.5E0), "
    f"hi_{c} + (hi_{c} - lo_{c}) * 1.5E0) END AS {c}"
    for c in CAPPED
)


@query(
    "iqr_cap",
    f"WITH {src.DAILY_M}, q AS (SELECT station_id, {_BOUNDS} FROM daily_m GROUP BY 1) "
    f"SELECT station_id, event_timestamp, aqi, {_CAP} FROM daily_m JOIN q USING (station_id)",
)
def iqr_cap(spark, sf_dir):
    df = src.daily_m(spark, sf_dir).select(KEY, TIME, "aqi", *CAPPED)
    return ops.iqr_cap(df, KEY, CAPPED)
