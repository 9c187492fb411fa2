"""Joins, as-of lookup, set operations and upsert."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as ops
from ..operators import upsert as sets
from ..operators.asof import asof_latest
from ..operators.resample import resample_daily, resample_hourly
from ..schemas import AIR, FAMILIES, KEY, TIME, WEATHER
from . import inputs as src
from . import query

TTL_SECONDS = 2 * 24 * 3600


def _hour_sql(cols: list[str], name: str) -> str:
    any_value = " OR ".join(f"{c} IS NOT NULL" for c in cols)
    return (
        f"{name} AS (SELECT station_id, date_trunc('hour', time) AS hour, "
        + ", ".join(f"{src.mean3(c)} AS {c}" for c in cols)
        + f" FROM readings WHERE {any_value} GROUP BY 1, 2)"
    )


def hourly(df, cols):
    """Mean per station and hour of the readings that have any of the measures."""
    present = df.where(F.coalesce(*[F.col(c) for c in cols]).isNotNull())
    return resample_hourly(present, KEY, "time", cols, digits=src.DIGITS)


HOURLY = f"{src.READINGS}, {_hour_sql(AIR, 'air')}, {_hour_sql(WEATHER, 'weather')}"


@query("outer_join_sources", f"WITH {HOURLY} SELECT * FROM air FULL JOIN weather USING (station_id, hour)")
def outer_join_sources(spark, sf_dir):
    df = src.readings(spark, sf_dir)
    return ops.outer_join(hourly(df, AIR), hourly(df, WEATHER), [KEY, "hour"])


ALIGNED = src.PREDS + (
    ", aligned AS (SELECT station_id, day, horizon, y_true, p_lightgbm, p_linear, p_hgbr, p_randomforest FROM preds "
    "WHERE y_true IS NOT NULL)"
)


def aligned(spark, sf_dir):
    long = src.preds_long(spark, sf_dir)
    return ops.align_predictions(long, [KEY, "day", "horizon"], "family", FAMILIES, "y_true", "y_pred")


@query("align_predictions", f"WITH {ALIGNED} SELECT * FROM aligned")
def align_predictions(spark, sf_dir):
    df = aligned(spark, sf_dir).withColumnRenamed(f"y_{FAMILIES[0]}", "y_true")
    return df.select(KEY, "day", "horizon", "y_true", *[f"p_{f}" for f in FAMILIES])


@query(
    "truth_mismatch",
    f"WITH {src.PREDS} SELECT horizon, count(*) AS n, "
    "sum(CASE WHEN y_true > 400 THEN 1 ELSE 0 END)::BIGINT AS mismatches FROM preds WHERE y_true IS NOT NULL GROUP BY 1",
)
def truth_mismatch(spark, sf_dir):
    # one family was scored against a truth that is off above 400
    wrong = (F.col("family") == "hgbr") & (F.col("y_true") > 400)
    long = src.preds_long(spark, sf_dir).withColumn(
        "y_true", F.when(wrong, F.col("y_true") + 1.0).otherwise(F.col("y_true"))
    )
    wide = ops.align_predictions(long, [KEY, "day", "horizon"], "family", FAMILIES, "y_true", "y_pred")
    bad = ops.truth_mismatch(wide, FAMILIES)
    return wide.groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("bigint")).alias("mismatches"))


@query(
    "align_features",
    f"WITH {src.SERIES}, l AS (SELECT l_shipdate::DATE AS day, count(*) AS shipped FROM lineitem GROUP BY 1) "
    "SELECT station_id, day, y, shipped FROM series JOIN l USING (day)",
)
def align_features(spark, sf_dir):
    shipped = src.table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(
        F.count(F.lit(1)).alias("shipped")
    )
    return ops.align_features(src.series(spark, sf_dir).select(KEY, "day", "y"), shipped, ["day"])


# a re-delivery: everything from the 20th of the month on arrives again, with another value
CUT = "2024-01-20"
REDELIVERED = f"{src.DAILY}, new AS (SELECT station_id, event_timestamp, aqi, pm25, co FROM daily " \
    f"WHERE event_timestamp >= TIMESTAMP '{CUT}')"


def old_and_new(spark, sf_dir):
    daily = src.daily(spark, sf_dir).select(KEY, TIME, "aqi", "pm25", "co")
    new = daily.where(F.col(TIME) >= F.lit(CUT).cast("timestamp_ntz")).withColumn("aqi", F.col("aqi") + 1.0)
    return daily.drop("co"), new.drop("pm25")


@query(
    "anti_join_existing",
    f"WITH {src.DAILY} SELECT station_id, event_timestamp, aqi, pm25 FROM daily "
    f"WHERE event_timestamp < TIMESTAMP '{CUT}'",
)
def anti_join_existing(spark, sf_dir):
    old, new = old_and_new(spark, sf_dir)
    return sets.not_replaced(old, new, [KEY, TIME])


@query(
    "missing_dates",
    f"WITH {src.DAILY}, days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-24', TIMESTAMP '2024-01-30', "
    "INTERVAL 1 DAY)) AS DATE) AS day) SELECT s.station_id, d.day FROM (SELECT DISTINCT station_id FROM daily) s "
    "CROSS JOIN days d ANTI JOIN daily x ON x.station_id = s.station_id AND CAST(x.event_timestamp AS DATE) = d.day",
)
def missing_dates(spark, sf_dir):
    days = src.events(spark, sf_dir).select(KEY, F.to_date("time").alias("day"))
    end = F.lit("2024-01-30").cast("date")
    return ops.missing_dates(days, KEY, "day", F.date_sub(end, 6), end)


@query(
    "asof_latest_ttl",
    "WITH f AS (SELECT user_id, date_trunc('hour', ts) AS event_timestamp, max(ts) AS created, "
    "arg_max(value, ts) AS temperature FROM events WHERE event_type = 'signup' GROUP BY 1, 2), "
    "j AS (SELECT r.user_id AS station_id, r.event_id, r.ts AS asked, f.event_timestamp, f.created, f.temperature "
    "FROM (SELECT * FROM events WHERE event_type = 'view') r ASOF LEFT JOIN f "
    "ON r.user_id = f.user_id AND r.ts >= f.event_timestamp) "
    "SELECT station_id, event_id, asked, "
    "CASE WHEN asked <= event_timestamp + INTERVAL 2 DAYS THEN event_timestamp END AS event_timestamp, "
    "CASE WHEN asked <= event_timestamp + INTERVAL 2 DAYS THEN created END AS created, "
    "CASE WHEN asked <= event_timestamp + INTERVAL 2 DAYS THEN temperature END AS temperature FROM j",
)
def asof_latest_ttl(spark, sf_dir):
    ev = src.events(spark, sf_dir)
    asked = ev.where(F.col("event_type") == "view").select(KEY, "event_id", F.col("time").alias("asked"))
    rows = ev.where(F.col("event_type") == "signup").select(
        KEY, F.date_trunc("hour", "time").cast("timestamp_ntz").alias(TIME), F.col("time").alias("created"),
        F.col("value").alias("temperature"),
    )
    return asof_latest(asked, rows, KEY, "asked", TIME, "created", TTL_SECONDS)


@query("union_batches", f"WITH {src.DAILY} SELECT event_timestamp, station_id, aqi, co FROM daily")
def union_batches(spark, sf_dir):
    df = src.daily(spark, sf_dir).select(KEY, TIME, "aqi", "co")
    cut = F.lit(CUT).cast("timestamp_ntz")
    first, second = df.where(F.col(TIME) < cut), df.where(F.col(TIME) >= cut)
    return sets.union_batches([first, second.select("co", "aqi", TIME, KEY)])


@query(
    "union_missing_cols",
    f"WITH {REDELIVERED} SELECT station_id, event_timestamp, aqi, pm25, NULL::DOUBLE AS co FROM daily UNION ALL "
    "SELECT station_id, event_timestamp, aqi + 1, NULL::DOUBLE, co FROM new",
)
def union_missing_cols(spark, sf_dir):
    return sets.union_missing(*old_and_new(spark, sf_dir))


@query(
    "upsert_features",
    f"WITH {REDELIVERED} SELECT station_id, event_timestamp, aqi, pm25, NULL::DOUBLE AS co FROM daily "
    f"WHERE event_timestamp < TIMESTAMP '{CUT}' UNION ALL "
    "SELECT station_id, event_timestamp, aqi + 1, NULL::DOUBLE, co FROM new",
)
def upsert_features(spark, sf_dir):
    return sets.upsert(*old_and_new(spark, sf_dir), [KEY, TIME])


@query(
    "date_difference",
    "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders "
    "WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem)",
)
def date_difference(spark, sf_dir):
    ordered = src.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    shipped = src.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    return sets.date_difference(ordered, shipped)


@query(
    "distinct_dates",
    "SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem ORDER BY 1",
)
def distinct_dates(spark, sf_dir):
    return sets.distinct_dates(src.table(spark, sf_dir, "lineitem"), "l_shipdate")


@query(
    "daily_from_orders",
    "SELECT o_custkey AS station_id, CAST(o_orderdate AS DATE) AS day, "
    + src.mean3("o_totalprice") + " AS o_totalprice FROM orders GROUP BY 1, 2",
)
def daily_from_orders(spark, sf_dir):
    orders = src.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", KEY)
    return resample_daily(orders, KEY, "o_orderdate", ["o_totalprice"], digits=src.DIGITS)
