"""Inputs the queries derive from the given tables, and the same inputs as SQL.

Stations are the users of ``events``; a reading is an event, its measure is chosen by the
event type, and the number in ``props`` serves a second measure. ``orders`` gives a long
daily series per priority, on the scale of the index. The SQL sums integers and divides
last, so that both engines agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import from_units, to_units
from ..operators.quantiles import unpivot
from ..operators.resample import widen
from ..plans import features as plans
from ..schemas import AVERAGED, FAMILIES, HORIZONS, KEY, MEASURES, SUMMED, TIME

DIGITS = 2  # decimals that the given numbers have at most

# measure -> (event type, column)
SOURCES = {
    "aqi": ("view", "value"),
    "pm25": ("click", "value"),
    "pm10": ("view", "k"),
    "no2": ("click", "k"),
    "so2": ("purchase", "k"),
    "co": ("purchase", "value"),
    "o3": ("error", "k"),
    "temperature": ("signup", "value"),
    "humidity": ("signup", "k"),
    "precipitation": ("error", "value"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir) -> DataFrame:
    """Events with the station key and the number in ``props``."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").withColumns({KEY: F.col("user_id"), "k": k, "time": F.col("ts")})


def readings(spark, sf_dir) -> DataFrame:
    return widen(events(spark, sf_dir), [KEY, "time", "event_id"], "event_type", SOURCES)


def daily(spark, sf_dir) -> DataFrame:
    return plans.daily_frame(readings(spark, sf_dir), digits=DIGITS)


def daily_m(spark, sf_dir) -> DataFrame:
    """Daily measures in thousandths: whole numbers, whose sums are exact in any order."""
    df = daily(spark, sf_dir)
    return df.withColumns({m: F.rint(F.col(m) * 1000.0) for m in MEASURES})


def features(spark, sf_dir) -> DataFrame:
    return plans.add_features(daily(spark, sf_dir))


def series(spark, sf_dir) -> DataFrame:
    """Daily series per order priority: mean order value on the scale 0 to 500, two digits."""
    orders = table(spark, sf_dir, "orders")
    s, n = F.sum(to_units(F.col("o_totalprice"), 2)), F.count(F.lit(1))
    return (
        orders.groupBy(F.col("o_orderpriority").alias(KEY), F.to_date("o_orderdate").alias("day"))
        .agg(F.call_function("div", s, n * F.lit(1000)).alias("y_c"))
        .withColumn("y", from_units(F.col("y_c"), 2))
    )


def preds(spark, sf_dir) -> DataFrame:
    """Four simple forecasts of the series for three horizons, one column per family."""
    w = Window.partitionBy(KEY).orderBy("day")

    def mean(frame):
        return F.sum("y_c").over(frame).cast("double") / F.count("y_c").over(frame) / 100.0

    first = Window.unboundedPreceding
    forecasts = [F.col("y"), mean(w.rowsBetween(-2, 0)), mean(w.rowsBetween(-6, 0)), mean(w.rowsBetween(first, 0))]
    truth = F.array(*[
        F.struct(F.lit(h).alias("horizon"), (F.lead("y_c", i + 1).over(w) / 100.0).alias("y_true"))
        for i, h in enumerate(HORIZONS)
    ])
    return (
        series(spark, sf_dir)
        .withColumns({f"p_{f}": c for f, c in zip(FAMILIES, forecasts)})
        .withColumn("_t", truth)
        .select(KEY, "day", F.inline("_t"), *[f"p_{f}" for f in FAMILIES])
    )


def preds_long(spark, sf_dir) -> DataFrame:
    df = preds(spark, sf_dir).withColumnsRenamed({f"p_{f}": f for f in FAMILIES})
    return unpivot(df, [KEY, "day", "horizon", "y_true"], FAMILIES, "family", "y_pred")


# ------------------------------------------------------------------ the same as SQL

def _measure(m: str) -> str:
    kind, col = SOURCES[m]
    value = "value" if col == "value" else "CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS DOUBLE)"
    return f"CASE WHEN event_type = '{kind}' THEN {value} END AS {m}"


READINGS = (
    "readings AS (SELECT user_id AS station_id, ts AS time, event_id, "
    + ", ".join(_measure(m) for m in MEASURES)
    + " FROM events)"
)


def mean3(m: str) -> str:
    """Mean of two-digit values rounded to three digits, in integers."""
    s, n = f"sum(CAST(round({m} * 100) AS BIGINT))", f"count({m})"
    return f"CAST((20 * {s} + {n}) // (2 * {n}) AS DOUBLE) / 1000.0E0"


def sum2(m: str) -> str:
    return f"CAST(coalesce(sum(CAST(round({m} * 100) AS BIGINT)), 0) AS DOUBLE) / 100.0E0"


_DAY_COLS = ", ".join([f"{mean3(m)} AS {m}" for m in AVERAGED] + [f"{sum2(m)} AS {m}" for m in SUMMED])
_ONLY_DAILY = (
    f"daily AS (SELECT station_id, CAST(CAST(time AS DATE) AS TIMESTAMP) AS {TIME}, {_DAY_COLS} "
    "FROM readings GROUP BY station_id, CAST(time AS DATE))"
)
DAILY = f"{READINGS}, {_ONLY_DAILY}"
DAILY_M = DAILY + ", daily_m AS (SELECT station_id, event_timestamp, " + ", ".join(
    f"round({m} * 1000) AS {m}" for m in MEASURES
) + " FROM daily)"

SERIES = (
    "series AS (SELECT *, CAST(y_c AS DOUBLE) / 100.0E0 AS y FROM (SELECT o_orderpriority AS station_id, "
    "CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) // (count(*) * 1000) "
    "AS BIGINT) AS y_c FROM orders GROUP BY 1, 2) s0)"
)


def _run_mean(back: str) -> str:
    over = f"OVER (PARTITION BY station_id ORDER BY day ROWS BETWEEN {back} PRECEDING AND CURRENT ROW)"
    return f"CAST(sum(y_c) {over} AS DOUBLE) / (count(y_c) {over}) / 100.0E0"


_LEADS = ", ".join(
    f"CAST(lead(y_c, {i}) OVER (PARTITION BY station_id ORDER BY day) AS DOUBLE) / 100.0E0 AS t{i}" for i in (1, 2, 3)
)
PREDS = (
    f"{SERIES}, fc AS (SELECT station_id, day, y AS p_lightgbm, {_run_mean('2')} AS p_linear, "
    f"{_run_mean('6')} AS p_hgbr, {_run_mean('UNBOUNDED')} AS p_randomforest, {_LEADS} FROM series), "
    "preds AS (SELECT station_id, day, horizon, CASE horizon WHEN 'hd1' THEN t1 WHEN 'hd2' THEN t2 ELSE t3 END "
    "AS y_true, p_lightgbm, p_linear, p_hgbr, p_randomforest "
    "FROM fc CROSS JOIN (VALUES ('hd1'), ('hd2'), ('hd3')) h(horizon))"
)
PREDS_LONG = PREDS + (
    ", preds_long AS (SELECT station_id, day, horizon, y_true, family, "
    "CASE family WHEN 'lightgbm' THEN p_lightgbm WHEN 'linear' THEN p_linear WHEN 'hgbr' THEN p_hgbr "
    "ELSE p_randomforest END AS y_pred "
    "FROM preds CROSS JOIN (VALUES ('lightgbm'), ('linear'), ('hgbr'), ('randomforest')) f(family))"
)
