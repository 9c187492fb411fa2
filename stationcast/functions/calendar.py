"""Calendar column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: months of the named seasons; every other month is Winter ----
SEASON_MONTHS = {"Spring": [3, 4, 5], "Summer": [6, 7, 8]}


def season(month: Column) -> Column:
    out = F.lit("Winter")
    for name, months in SEASON_MONTHS.items():
        out = F.when(month.isin(months), F.lit(name)).otherwise(out)
    return out


def weekday_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def weekday_number(ts: Column) -> Column:
    """Monday = 0."""
    return F.weekday(ts)


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * F.lit(2.0 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def horizon_dates(base: Column, days: int = 3) -> Column:
    """Array of the next ``days`` dates."""
    return F.transform(F.sequence(F.lit(1), F.lit(days)), lambda d: F.date_add(base, d))


def utc_time(c: Column) -> Column:
    """Text to a UTC time without zone: an offset is converted, text without one is UTC already.

    What does not parse becomes null. The result does not depend on the session's time zone.
    """
    text = F.trim(c.cast("string"))
    local = F.regexp_replace(text, r"\s*(Z|[+-]\d{2}(:?\d{2})?)$", "").try_cast("timestamp_ntz")
    offset = F.regexp_extract(text, r":\d{2}(?:\.\d+)?\s*(Z|[+-]\d{2}(?::?\d{2})?)$", 1)
    hours = F.coalesce(F.substring(offset, 2, 2).try_cast("int"), F.lit(0))
    minutes = F.coalesce(F.substring(F.regexp_replace(offset, ":", ""), 4, 2).try_cast("int"), F.lit(0))
    seconds = F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1) * (hours * 3600 + minutes * 60)
    shifted = local - F.make_dt_interval(secs=seconds)
    return F.when(F.coalesce(offset, F.lit("")) == "", text.try_cast("timestamp_ntz")).otherwise(shifted)
