"""Sources and sinks: what is written to the shared folder is read back as the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.resample import resample_hourly
from ..plans.features import publish
from ..schemas import (
    AIR, AIR_PAYLOAD, FEATURE_SCHEMA, KEY, MEASURES, PUBLISHED, READING_SCHEMA, TIME, check_schema,
)
from ..session import work_path
from ..sources import artifacts, files, payloads
from . import inputs as src
from . import query
from .aggregates import REGISTRY, registry
from .features import FEATURES, ROUNDED

EVENT_COLS = "event_id, ts, user_id, event_type, value, props"
READING_COLS = "station_id, time, " + ", ".join(MEASURES)


def _readings(spark, sf_dir):
    return src.readings(spark, sf_dir).drop("event_id")


@query("scan_parquet", f"SELECT {EVENT_COLS} FROM events")
def scan_parquet(spark, sf_dir):
    return files.read_parquet(spark, f"{sf_dir}/events.parquet")


@query("scan_csv_roundtrip", f"WITH {src.READINGS} SELECT {READING_COLS} FROM readings")
def scan_csv_roundtrip(spark, sf_dir):
    path = work_path(spark, "readings-csv")
    files.write_csv(_readings(spark, sf_dir), path)
    return files.read_csv(spark, path, READING_SCHEMA)


@query("scan_fallback", f"WITH {src.READINGS} SELECT {READING_COLS} FROM readings")
def scan_fallback(spark, sf_dir):
    path = work_path(spark, "readings")
    _readings(spark, sf_dir).write.parquet(f"{path}/parquet")
    return files.read_any(spark, f"{path}/csv", f"{path}/parquet", READING_SCHEMA)


@query("csv_to_parquet", f"WITH {src.DAILY} SELECT station_id, event_timestamp, aqi, precipitation FROM daily")
def csv_to_parquet(spark, sf_dir):
    path = work_path(spark, "convert")
    df = src.daily(spark, sf_dir).select(KEY, F.date_format(TIME, "yyyy-MM-dd").alias(TIME), "aqi", "precipitation")
    files.write_csv(df, f"{path}/csv")
    for _ in range(2):  # the second call finds the target and leaves it
        files.csv_to_parquet(spark, f"{path}/csv", f"{path}/parquet", df.schema, [TIME])
    return files.read_parquet(spark, f"{path}/parquet")


@query(
    "json_arrays_to_rows",
    f"WITH {src.READINGS} SELECT station_id, date_trunc('hour', time) AS time, "
    + ", ".join(f"{src.mean3(c)} AS {c}" for c in AIR) + " FROM readings GROUP BY 1, 2",
)
def json_arrays_to_rows(spark, sf_dir):
    hourly = resample_hourly(src.readings(spark, sf_dir), KEY, "time", AIR, digits=src.DIGITS).withColumn("day", F.to_date("hour"))
    path = work_path(spark, "payloads")
    payloads.build_payloads(hourly, [KEY, "day"], "hour", AIR_PAYLOAD).write.parquet(path)
    rows, _ = payloads.parse_payloads(files.read_parquet(spark, path), [KEY], "payload", AIR_PAYLOAD)
    return rows


@query(
    "payloads_rejected",
    "SELECT event_id, CASE WHEN event_type = 'click' THEN '' ELSE '{\"hourly\":{\"time\":[]}}' END AS payload "
    "FROM events WHERE event_type IN ('click', 'error')",
)
def payloads_rejected(spark, sf_dir):
    kind = F.col("event_type")
    one = F.to_json(
        F.struct(F.struct(F.array(F.date_format("ts", payloads.TIME_FORMAT)).alias("time"),
                          F.array("value").alias("us_aqi")).alias("hourly"))
    )
    text = F.when(kind == "click", "").when(kind == "error", '{"hourly":{"time":[]}}').otherwise(one)
    df = src.table(spark, sf_dir, "events").select("event_id", text.alias("payload"))
    return payloads.parse_payloads(df, ["event_id"], "payload", {"us_aqi": "aqi"})[1]


@query(
    "registry_latest",
    f"WITH {REGISTRY} SELECT family, horizon, max(created) AS created, arg_max(event_id, created) AS event_id "
    "FROM registry GROUP BY 1, 2",
)
def registry_latest(spark, sf_dir):
    return artifacts.latest_artifacts(registry(spark, sf_dir))


@query(
    "preds_load",
    f"WITH {src.PREDS_LONG} SELECT family, horizon, CAST(day AS TIMESTAMP) AS event_timestamp, station_id, "
    "y_true, y_pred FROM preds_long WHERE y_true IS NOT NULL",
)
def preds_load(spark, sf_dir):
    long = src.preds_long(spark, sf_dir).dropna(subset=["y_true"])
    stamps = {"2024-01-01 00:00:00": 100.0, "2024-02-01 00:00:00": 0.0}  # the older run was off by 100
    runs = F.explode(F.array(*[
        F.struct(F.lit(s).cast("timestamp_ntz").alias("created"), F.lit(v).alias("off")) for s, v in stamps.items()
    ]))
    target = F.concat(F.lit("AQI_t+"), F.substring("horizon", 3, 1))
    df = long.withColumn("_r", runs).select(
        F.col("day").cast("timestamp_ntz").alias(TIME), "y_true",
        (F.col("y_pred") + F.col("_r.off")).alias("y_pred"), KEY,
        artifacts.artifact_name(F.col("family"), target, F.col("_r.created")).alias("artifact"),
    )
    path = work_path(spark, "predictions")
    artifacts.write_predictions(df, path)
    return artifacts.load_predictions(spark, path, {KEY: "string"})


@query(
    "write_verify",
    f"WITH {src.DAILY} SELECT count(*) AS rows, min(event_timestamp) AS first, max(event_timestamp) AS last, "
    "true AS ok FROM daily",
)
def write_verify(spark, sf_dir):
    return files.write_verified(src.daily(spark, sf_dir), work_path(spark, "verified"), TIME)


@query(
    "feature_table_roundtrip",
    f"WITH {src.DAILY} SELECT station_id, event_timestamp, aqi, CAST(event_timestamp AS DATE) AS day FROM daily",
)
def feature_table_roundtrip(spark, sf_dir):
    path = work_path(spark, "feature-table")
    df = src.daily(spark, sf_dir).select(KEY, TIME, "aqi", F.to_date(TIME).alias("day"))
    files.write_partitioned(df, path, "day", [KEY])
    return files.read_parquet(spark, path)


_PUBLISHED = ", ".join(f'{f.name} AS "{PUBLISHED.get(f.name, f.name)}"' for f in FEATURE_SCHEMA)


@query(
    "publish_features",
    f"WITH {FEATURES} SELECT {_PUBLISHED}, TIMESTAMP '2024-02-01' AS created FROM features",
)
def publish_features(spark, sf_dir):
    df = src.features(spark, sf_dir)
    check_schema(df, FEATURE_SCHEMA)
    df = df.withColumns({c: F.round(c, 6) for c in ROUNDED})
    return publish(df, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
