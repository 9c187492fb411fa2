"""Feature columns: calendar, transforms, one-hots, scales, dates, documented extras."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import airquality as aq
from ..functions import calendar, naming
from ..operators import encode, subindex, windows
from ..operators.cleaning import iqr_bounds
from ..operators.resample import daily_max_of_moving_mean, resample_daily
from ..plans import features as plans
from ..plans.update import FeatureTables
from ..schemas import AVERAGED, CAPPED, KEY, MEASURES, SEASONS, STATISTICS, SUMMED, TARGETS, TIME, WEEKDAYS
from ..session import stored, work_path
from . import inputs as src
from . import query
from .joins import CUT

ROUNDED = ["log_pm25", "log_co", "aqi_roll_mean_3", "aqi_roll_std_3", "aqi_diff", *CAPPED]
W = "(PARTITION BY station_id ORDER BY event_timestamp)"
ROLL = "(PARTITION BY station_id ORDER BY event_timestamp ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
FILL = "(PARTITION BY station_id ORDER BY event_timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

SEASON_SQL = (
    "CASE WHEN month(event_timestamp) IN (3, 4, 5) THEN 'Spring' "
    "WHEN month(event_timestamp) IN (6, 7, 8) THEN 'Summer' ELSE 'Winter' END"
)
ONE_HOT_SQL = ", ".join(
    [f"CAST({SEASON_SQL} = '{s}' AS INTEGER) AS season_{s}" for s in SEASONS]
    + [f"CAST(isodow(event_timestamp) - 1 = {d} AS INTEGER) AS weekday_{d}" for d in WEEKDAYS[1:]]
)


def _cap_sql(c: str, rows: str = "") -> str:
    q1, q3 = (f"quantile_cont({c}, {p}) {rows} OVER (PARTITION BY station_id)" for p in (0.25, 0.75))
    return f"{q1} AS q1_{c}, {q3} AS q3_{c}"


def _capped(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, q1_{c} - (q3_{c} - q1_{c}) * 1.5E0), "
        f"q3_{c} + (q3_{c} - q1_{c}) * 1.5E0) END AS {c}"
    )


def _filled(c: str) -> str:
    last = f"last_value({c} IGNORE NULLS) OVER {FILL}"
    return f"round({last}, 6) AS {c}" if c in ROUNDED else f"{last} AS {c}"


def features_sql(capped_on: str = "") -> str:
    """The feature table; ``capped_on`` is a filter of the rows that the bounds are taken from."""
    return (
        f"{src.DAILY}, step AS (SELECT *, CAST(month(event_timestamp) AS INTEGER) AS month, "
        "ln(1 + pm25) AS log_pm25, ln(1 + co) AS log_co, "
        f"lag(aqi, 1) OVER {W} AS aqi_lag_1, lag(aqi, 2) OVER {W} AS aqi_lag_2, "
        f"avg(aqi) OVER {ROLL} AS aqi_roll_mean_3, stddev_samp(aqi) OVER {ROLL} AS aqi_roll_std_3, "
        f"aqi - lag(aqi, 1) OVER {W} AS aqi_diff, "
        + ", ".join(f"lead(aqi, {i}) OVER {W} AS aqi_t{i}" for i in (1, 2, 3))
        + ", " + ", ".join(_cap_sql(c, capped_on) for c in CAPPED)
        + f", {ONE_HOT_SQL} FROM daily), "
        "capped AS (SELECT * REPLACE (" + ", ".join(_capped(c) for c in CAPPED) + ") FROM step), "
        f"features AS (SELECT station_id, {TIME}, "
        + ", ".join(_filled(c) for c in MEASURES)
        + ", month, " + ", ".join(_filled(c) for c in STATISTICS) + ", " + ", ".join(TARGETS)
        + ", " + ", ".join([f"season_{s}" for s in SEASONS] + [f"weekday_{d}" for d in WEEKDAYS[1:]])
        + " FROM capped)"
    )


FEATURES = features_sql()


def rounded_features(spark, sf_dir):
    df = src.features(spark, sf_dir)
    return df.withColumns({c: F.round(c, 6) for c in ROUNDED})


@query("daily_features", f"WITH {FEATURES} SELECT * FROM features")
def daily_features(spark, sf_dir):
    return rounded_features(spark, sf_dir)


CAPPED_ON = f"FILTER (WHERE {TIME} < TIMESTAMP '{CUT}')"


def bounds_before_cut(daily):
    """Capping bounds of the days before the cut, stored once: what was known when the later days came."""
    rows = daily.where(F.col(TIME) < F.lit(CUT).cast("timestamp_ntz"))
    return stored(iqr_bounds(rows, KEY, CAPPED), "bounds")


@query("train_capped_features", f"WITH {features_sql(CAPPED_ON)} SELECT * FROM features")
def train_capped_features(spark, sf_dir):
    """The feature table with outliers capped by bounds of the training rows only."""
    daily = src.daily(spark, sf_dir)
    df = plans.add_features(daily, bounds=bounds_before_cut(daily))
    return df.withColumns({c: F.round(c, 6) for c in ROUNDED})


@query("update_features", f"WITH {FEATURES} SELECT * FROM features")
def update_features(spark, sf_dir):
    """History up to the 20th, then the remaining readings as an update."""
    readings = src.readings(spark, sf_dir)
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    history = plans.daily_frame(readings.where(F.col("time") < cut), digits=src.DIGITS)
    _, features = plans.update_features(history, readings.where(F.col("time") >= cut), digits=src.DIGITS)
    return features.withColumns({c: F.round(c, 6) for c in ROUNDED})


@query("update_feature_tables", f"WITH {features_sql(CAPPED_ON)} SELECT * FROM features")
def update_feature_tables(spark, sf_dir):
    """Stored tables of the days before the cut but one, then the later days, then the one as a late delivery."""
    readings, daily = src.readings(spark, sf_dir), src.daily(spark, sf_dir)
    day = F.to_date("time")
    late, new = day == F.lit("2024-01-08").cast("date"), day >= F.lit(CUT).cast("date")
    tables = FeatureTables(spark, work_path(spark, "tables"), span=5)
    tables.create(plans.daily_frame(readings.where(~late & ~new), digits=src.DIGITS), bounds_before_cut(daily))
    for part in (new, late):
        tables.update(readings.where(part), digits=src.DIGITS)
    return tables.features().withColumns({c: F.round(c, 6) for c in ROUNDED})


@query(
    "daily_resample",
    f"WITH {src.DAILY} SELECT * FROM daily",
)
def daily_resample(spark, sf_dir):
    return src.daily(spark, sf_dir)


@query(
    "daily_counts",
    f"WITH {src.READINGS} SELECT station_id, CAST(time AS DATE) AS day, {src.mean3('aqi')} AS aqi, "
    "count(*) AS n_readings FROM readings GROUP BY 1, 2",
)
def daily_counts(spark, sf_dir):
    return resample_daily(src.readings(spark, sf_dir), KEY, "time", ["aqi"], count="n_readings", digits=src.DIGITS)


@query(
    "calendar_features",
    f"WITH {src.DAILY} SELECT station_id, event_timestamp, CAST(month(event_timestamp) AS INTEGER) AS month, "
    f"{SEASON_SQL} AS season, dayname(event_timestamp) AS weekday FROM daily",
)
def calendar_features(spark, sf_dir):
    ts = F.col(TIME)
    return src.daily(spark, sf_dir).select(
        KEY, TIME, F.month(ts).alias("month"), calendar.season(F.month(ts)).alias("season"),
        calendar.weekday_name(ts).alias("weekday"),
    )


@query(
    "log_features",
    f"WITH {src.DAILY} SELECT station_id, event_timestamp, round(ln(1 + pm25), 6) AS log_pm25, "
    "round(ln(1 + co), 6) AS log_co FROM daily",
)
def log_features(spark, sf_dir):
    df = encode.add_logs(src.daily(spark, sf_dir), ["pm25", "co"])
    return df.select(KEY, TIME, F.round("log_pm25", 6).alias("log_pm25"), F.round("log_co", 6).alias("log_co"))


@query("one_hot", f"WITH {src.DAILY} SELECT station_id, event_timestamp, {ONE_HOT_SQL} FROM daily")
def one_hot(spark, sf_dir):
    df = encode.add_calendar(src.daily(spark, sf_dir).select(KEY, TIME), TIME).drop("month")
    df = encode.one_hot(df, "season", SEASONS)
    return encode.one_hot(df, "weekday", WEEKDAYS, drop_first=True)


def _steps_sql(values: list[str]) -> str:
    whens = " ".join(f"WHEN value <= {b} THEN {v}" for b, v in zip(aq.CATEGORY_BOUNDS, values))
    return f"CASE WHEN value IS NULL THEN NULL {whens} ELSE {values[-1]} END"


@query(
    "aqi_category",
    f"SELECT event_id, value, CAST({_steps_sql(['1', '2', '3', '4', '5', '6'])} AS INTEGER) AS category FROM events",
)
def aqi_category(spark, sf_dir):
    ev = src.table(spark, sf_dir, "events")
    return ev.select("event_id", "value", aq.category(F.col("value")).alias("category"))


_quoted = lambda xs: [f"'{x}'" for x in xs]


@query(
    "aqi_label",
    f"SELECT event_id, {_steps_sql(_quoted(aq.CATEGORY_LABELS))} AS label, "
    f"{_steps_sql(_quoted(aq.CATEGORY_COLOURS))} AS colour FROM events",
)
def aqi_label(spark, sf_dir):
    v = F.col("value")
    return src.table(spark, sf_dir, "events").select(
        "event_id", aq.category_label(v).alias("label"), aq.category_colour(v).alias("colour")
    )


@query(
    "alert_level",
    "SELECT alert, count(*) AS readings FROM (SELECT CASE WHEN value >= 200 THEN 'hazardous' "
    "WHEN value >= 150 THEN 'unhealthy' ELSE 'ok' END AS alert FROM events) GROUP BY alert",
)
def alert_level(spark, sf_dir):
    ev = src.table(spark, sf_dir, "events").select(aq.alert_level(F.col("value")).alias("alert"))
    return ev.groupBy("alert").agg(F.count(F.lit(1)).alias("readings"))


@query(
    "forecast_dates",
    "SELECT user_id AS station_id, CAST(max(ts) AS DATE) AS base, CAST(max(ts) AS DATE) + 1 AS d1, "
    "CAST(max(ts) AS DATE) + 2 AS d2, CAST(max(ts) AS DATE) + 3 AS d3, "
    "dayname(CAST(max(ts) AS DATE) + 1) AS d1_name FROM events GROUP BY 1",
)
def forecast_dates(spark, sf_dir):
    base = src.events(spark, sf_dir).groupBy(KEY).agg(F.to_date(F.max("time")).alias("base"))
    dates = base.withColumn("_d", calendar.horizon_dates(F.col("base")))
    return dates.select(
        KEY, "base", *[F.col("_d")[i].alias(f"d{i + 1}") for i in range(3)],
        calendar.weekday_name(F.col("_d")[0]).alias("d1_name"),
    )


@query(
    "horizon_map",
    f"WITH {src.PREDS} SELECT horizon, 'AQI_t+' || horizon[3:] AS target, horizon AS code, count(*) AS n "
    "FROM preds GROUP BY horizon",
)
def horizon_map(spark, sf_dir):
    n = src.preds(spark, sf_dir).groupBy("horizon").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("target", naming.horizon_target(F.col("horizon")))
    return n.withColumn("code", naming.horizon_code(F.col("target")))


@query(
    "cyclic_calendar",
    f"WITH {src.DAILY} SELECT station_id, event_timestamp, "
    "round(sin(dayofyear(event_timestamp) * (2 * pi() / 365.25E0)), 6) AS doy_sin, "
    "round(cos(dayofyear(event_timestamp) * (2 * pi() / 365.25E0)), 6) AS doy_cos, "
    "round(sin((isodow(event_timestamp) - 1) * (2 * pi() / 7)), 6) AS dow_sin, "
    "round(cos((isodow(event_timestamp) - 1) * (2 * pi() / 7)), 6) AS dow_cos, "
    "CAST(day(event_timestamp) AS INTEGER) AS day, CAST(weekofyear(event_timestamp) AS INTEGER) AS week_of_year, "
    "CAST(isodow(event_timestamp) >= 6 AS INTEGER) AS is_weekend FROM daily",
)
def cyclic_calendar(spark, sf_dir):
    df = encode.add_cyclic_calendar(src.daily(spark, sf_dir).select(KEY, TIME), TIME)
    return df.withColumns({c: F.round(c, 6) for c in ("doy_sin", "doy_cos", "dow_sin", "dow_cos")})


def _roll_sql(c: str, n: int) -> str:
    over = f"OVER (PARTITION BY station_id ORDER BY event_timestamp ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"avg({c}) {over} AS {c}_roll_mean_{n}, round(stddev_samp({c}) {over}, 4) AS {c}_roll_std_{n}"


@query(
    "multi_window_features",
    f"WITH {src.DAILY_M} SELECT station_id, event_timestamp, "
    + ", ".join(_roll_sql(c, n) for c in ("aqi", "temperature") for n in (3, 7, 14))
    + ", " + ", ".join(f"lag({c}, {k}) OVER {W} AS {c}_lag_{k}" for c in ("temperature", "humidity") for k in (1, 3))
    + " FROM daily_m",
)
def multi_window_features(spark, sf_dir):
    df = src.daily_m(spark, sf_dir).select(KEY, TIME, "aqi", "temperature", "humidity")
    for c in ("aqi", "temperature"):
        for n in (3, 7, 14):
            df = windows.add_rolling(df, KEY, TIME, c, n)
    for c in ("temperature", "humidity"):
        df = windows.add_lags(df, KEY, TIME, c, (1, 3))
    stds = [c for c in df.columns if "_roll_std_" in c]
    return df.withColumns({c: F.round(c, 4) for c in stds}).drop("aqi", "temperature", "humidity")


def _ozone_sql(hours: int) -> str:
    """Steps up to the daily maximum of the trailing mean; needs ``readings``, ends in table ``m``."""
    return (
        "h AS (SELECT station_id, date_trunc('hour', time) AS hr, "
        "sum(CAST(round(o3 * 100) AS BIGINT)) AS s, count(*) AS n FROM readings WHERE o3 IS NOT NULL GROUP BY 1, 2), "
        "m AS (SELECT station_id, hr, CAST(sum(s) OVER w AS BIGINT) AS s, CAST(sum(n) OVER w AS BIGINT) AS n FROM h "
        f"WINDOW w AS (PARTITION BY station_id ORDER BY hr RANGE BETWEEN INTERVAL {hours - 1} HOURS PRECEDING AND CURRENT ROW))"
    )


OZONE_MAX = "max(CAST((20 * s + n) // (2 * n) AS DOUBLE) / 1000.0E0)"


@query(
    "ozone_8h_daily_max",
    f"WITH {src.READINGS}, {_ozone_sql(8)} "
    f"SELECT station_id, CAST(hr AS DATE) AS day, {OZONE_MAX} AS o3_8h_max FROM m GROUP BY 1, 2",
)
def ozone_8h_daily_max(spark, sf_dir):
    return daily_max_of_moving_mean(src.readings(spark, sf_dir), KEY, "time", "o3", 8, out="o3_8h_max", digits=src.DIGITS)


def _index_sql(p: str, steps=None, index=aq.INDEX_STEPS, digits=None) -> str:
    t = 10 ** (aq.TRUNCATION[p] if digits is None else digits)
    x, steps = f"(floor({p} * {t}.0E0) / {t}.0E0)", steps or aq.BREAKPOINTS[p]
    whens = " ".join(
        f"WHEN {x} <= {float(ch)}E0 THEN {float(il)}E0 + {float(ih - il)}E0 / {float(ch) - float(cl)}E0 * "
        f"({x} - {float(cl)}E0)"
        for (il, ih), (cl, ch) in zip(index, steps)
    )
    none = f"{p} IS NULL OR {x} < {float(steps[0][0])}E0" if steps[0][0] else f"{p} IS NULL"
    return f"CASE WHEN {none} THEN NULL {whens} ELSE {float(index[len(steps) - 1][1])}E0 END"


def _dated_sql(p: str) -> str:
    out = f"round({_index_sql(p)}, 0)"
    for since, steps in aq.REVISED.get(p, ()):
        out = f"CASE WHEN {TIME} >= DATE '{since}' THEN round({_index_sql(p, steps)}, 0) ELSE {out} END"
    return out


def _highest_sql(hours: int) -> str:
    return f"SELECT station_id, CAST(hr AS DATE) AS day, {OZONE_MAX} AS o{hours} FROM (WITH {_ozone_sql(hours)} SELECT * FROM m) GROUP BY 1, 2"


@query(
    "aqi_with_ozone",
    f"WITH {src.DAILY}, idx AS (SELECT station_id, event_timestamp, "
    + ", ".join(f"{_dated_sql(p)} AS i_{p}" for p in aq.BREAKPOINTS)
    + f", greatest(round({_index_sql('o8', aq.OZONE_8H, digits=0)}, 0), "
    f"round({_index_sql('o1', aq.OZONE_1H, aq.OZONE_1H_INDEX, 0)}, 0)) AS i_o3 FROM (SELECT *, CAST({TIME} AS DATE) AS day FROM daily) d "
    f"LEFT JOIN ({_highest_sql(8)}) a USING (station_id, day) LEFT JOIN ({_highest_sql(1)}) b USING (station_id, day)) "
    "SELECT *, greatest(" + ", ".join(f"i_{p}" for p in [*aq.BREAKPOINTS, "o3"]) + ") AS aqi_computed FROM idx",
)
def aqi_with_ozone(spark, sf_dir):
    """Index from six pollutants: ozone by its eight-hour and one-hour means, steps in force on the day."""
    daily, readings = src.daily(spark, sf_dir), src.readings(spark, sf_dir)
    df = subindex.add_index_with_ozone(daily, readings, KEY, "time", TIME, digits=src.DIGITS)
    return df.select(KEY, TIME, *[f"i_{p}" for p in [*aq.BREAKPOINTS, "o3"]], "aqi_computed")


@query(
    "aqi_from_subindices",
    f"WITH {src.DAILY}, idx AS (SELECT station_id, event_timestamp, "
    + ", ".join(f"round({_index_sql(p)}, 0) AS i_{p}" for p in aq.BREAKPOINTS)
    + " FROM daily) SELECT *, greatest(" + ", ".join(f"i_{p}" for p in aq.BREAKPOINTS) + ") AS aqi_computed FROM idx",
)
def aqi_from_subindices(spark, sf_dir):
    df = subindex.add_index(src.daily(spark, sf_dir), list(aq.BREAKPOINTS))
    return df.select(KEY, TIME, *[f"i_{p}" for p in aq.BREAKPOINTS], "aqi_computed")


@query(
    "freshness",
    "SELECT user_id AS station_id, CAST(max(ts) AS DATE) AS latest, "
    "CAST(max(ts) AS DATE) >= DATE '2024-01-30' AS is_fresh FROM events GROUP BY 1",
)
def freshness(spark, sf_dir):
    return plans.freshness(src.events(spark, sf_dir), KEY, "time", F.lit("2024-01-30").cast("date"))
