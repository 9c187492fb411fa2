"""Air-quality index from pollutant concentrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.airquality import BREAKPOINTS, INDEX_STEPS, OZONE_1H, OZONE_1H_INDEX, OZONE_8H, REVISED, TRUNCATION
from .resample import daily_max_of_moving_mean


def interpolated(c: Column, index: list, concentrations: list, digits: int = 0) -> Column:
    """Linear interpolation between steps, rounded to a whole number; below the first step null, above the last its end.

    Literal steps as a conditional: they stay inside the scan's code generation, while a range join
    with the breakpoint table would compare every row with every step.
    """
    unit = F.lit(float(10 ** digits))
    x = F.floor(c * unit) / unit
    out = F.lit(float(index[len(concentrations) - 1][1]))
    for (i_lo, i_hi), (c_lo, c_hi) in reversed(list(zip(index, concentrations))):
        slope = F.lit(float(i_hi - i_lo)) / F.lit(float(c_hi) - float(c_lo))
        out = F.when(x <= float(c_hi), F.lit(float(i_lo)) + slope * (x - F.lit(float(c_lo)))).otherwise(out)
    given = c.isNotNull() & (x >= float(concentrations[0][0])) if concentrations[0][0] else c.isNotNull()
    return F.when(given, F.round(out, 0))


def pollutant_index(c: Column, pollutant: str, day: Column | None = None) -> Column:
    """Sub-index of one pollutant, by the steps in force on ``day`` where a day is given."""
    out = interpolated(c, INDEX_STEPS, BREAKPOINTS[pollutant], TRUNCATION[pollutant])
    for since, steps in REVISED.get(pollutant, ()) if day is not None else ():
        out = F.when(day >= F.lit(since).cast("date"), interpolated(c, INDEX_STEPS, steps, TRUNCATION[pollutant])).otherwise(out)
    return out


def ozone_index(mean_8h: Column, mean_1h: Column) -> Column:
    """The greater of the indices of a day's highest eight-hour and one-hour means, in ppb.

    The eight-hour scale ends at 300, the one-hour scale begins at 101.
    """
    return F.greatest(interpolated(mean_8h, INDEX_STEPS, OZONE_8H), interpolated(mean_1h, OZONE_1H_INDEX, OZONE_1H))


def add_index_with_ozone(daily: DataFrame, readings: DataFrame, key: str, time: str, day: str, *, digits: int | None = None) -> DataFrame:
    """Daily rows with the sub-index of six pollutants and their maximum, by the steps in force on the row's day.

    Ozone comes from the moving means of the hourly ``readings``; a day without ozone has no index of it.
    """
    out = daily.withColumn("_day", F.to_date(day))
    for hours in (8, 1):
        highest = daily_max_of_moving_mean(readings, key, time, "o3", hours, day="_day", out=f"_o3_{hours}h", digits=digits)
        out = out.join(highest, [key, "_day"], "left")
    indices = {f"i_{p}": pollutant_index(F.col(p), p, F.col("_day")) for p in BREAKPOINTS}
    out = out.withColumns(indices | {"i_o3": ozone_index(F.col("_o3_8h"), F.col("_o3_1h"))})
    return out.withColumn("aqi_computed", F.greatest(*indices, "i_o3")).drop("_day", "_o3_8h", "_o3_1h").select(
        *daily.columns, *indices, "i_o3", "aqi_computed")


def add_index(df: DataFrame, pollutants: list[str]) -> DataFrame:
    """Sub-index per pollutant and their maximum; missing pollutants do not count."""
    df = df.withColumns({f"i_{p}": pollutant_index(F.col(p), p) for p in pollutants})
    return df.withColumn("aqi_computed", F.greatest(*[f"i_{p}" for p in pollutants]))
