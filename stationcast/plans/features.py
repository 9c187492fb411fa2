"""From readings to the daily feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import encode, windows
from ..operators.cleaning import cap_to, iqr_cap, rename
from ..operators.resample import resample_daily
from ..operators.upsert import upsert
from ..schemas import (
    AVERAGED, CAPPED, KEY, MEASURES, PUBLISHED, SEASONS, STATISTICS, SUMMED, TARGETS, TIME, WEEKDAYS,
)


def daily_frame(readings: DataFrame, time: str = "time", digits: int | None = None, zone: str | None = None) -> DataFrame:
    """One row per station and day (of the time zone, else UTC) with the ten measures."""
    daily = resample_daily(readings, KEY, time, AVERAGED, SUMMED, day=TIME, digits=digits, zone=zone)
    return daily.withColumn(TIME, F.col(TIME).cast("timestamp_ntz"))


def capped_columns(measures=tuple(MEASURES), capped=tuple(CAPPED)) -> list[str]:
    return [c for c in capped if c in measures]


def finished(df: DataFrame, measures=tuple(MEASURES), keep=()) -> DataFrame:
    """Calendar columns, and the feature table's columns in their order, then those of ``keep``."""
    df = encode.add_calendar(df, TIME)
    df = encode.one_hot(df, "season", SEASONS)
    df = encode.one_hot(df, "weekday", WEEKDAYS, drop_first=True)
    stats = [c for c in STATISTICS if c in df.columns]
    hots = [c for c in df.columns if c.startswith(("season_", "weekday_"))]
    return df.select(KEY, TIME, *measures, "month", *stats, *TARGETS, *hots, *keep)


def add_features(daily: DataFrame, measures=tuple(MEASURES), capped=tuple(CAPPED), bounds: DataFrame | None = None) -> DataFrame:
    """Calendar, lag, rolling, difference and target columns, capping, one-hots and filling.

    Everything ordered runs over the same (station, time) window: one shuffle on the
    station and one sort for the whole chain. Targets are never filled, and features look
    backwards only. Outliers are capped by stored ``bounds`` (``iqr_bounds`` of training
    rows), or by those of all rows if none are given.
    """
    df = encode.add_logs(daily, [c for c in ("pm25", "co") if c in measures])
    if bounds is not None:
        df = cap_to(df, bounds, KEY, capped_columns(measures, capped))
    df = windows.add_lags(df, KEY, TIME, "aqi")
    df = windows.add_rolling(df, KEY, TIME, "aqi")
    df = windows.add_diff(df, KEY, TIME, "aqi")
    df = windows.add_targets(df, KEY, TIME, "aqi")
    if bounds is None:
        df = iqr_cap(df, KEY, capped_columns(measures, capped))
    df = windows.forward_fill(df, KEY, TIME, [*measures, *[c for c in STATISTICS if c in df.columns]])
    return finished(df, measures)


def daily_features(readings: DataFrame, time: str = "time", digits: int | None = None, zone: str | None = None) -> DataFrame:
    return add_features(daily_frame(readings, time, digits, zone))


def update_features(
    daily: DataFrame, readings: DataFrame, time: str = "time", digits: int | None = None, zone: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(daily table, feature table) after new readings.

    The days of the new readings replace the stored ones. Features are computed over history
    and new days together, so that lags and targets reach across the seam.
    """
    merged = upsert(daily, daily_frame(readings, time, digits, zone), [KEY, TIME])
    return merged, add_features(merged)


def publish(features: DataFrame, created=None) -> DataFrame:
    """Published column names and the processing time."""
    now = F.current_timestamp() if created is None else created
    return rename(features, PUBLISHED).withColumn("created", now)


def freshness(df: DataFrame, key: str, time: str, current) -> DataFrame:
    """Newest date per key and whether it reaches ``current``."""
    latest = df.groupBy(key).agg(F.to_date(F.max(time)).alias("latest"))
    return latest.withColumn("is_fresh", F.col("latest") >= current)
