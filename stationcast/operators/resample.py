"""Daily aggregation of readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import exact_mean, finite, from_units, to_units


def measure_sums(means: list[str], sums: list[str] = (), digits: int | None = None) -> list[Column]:
    """Sums and counts behind the means and sums of the measures; NaN counts as missing.

    Sums are doubles, or integers if the measures are known to have at most ``digits`` decimals.
    """
    aggs = []
    for c in [*means, *sums]:
        value = finite(F.col(c).cast("double"))
        aggs.append(F.sum(value if digits is None else to_units(value, digits)).alias(f"_s_{c}"))
        if c not in sums:
            aggs.append(F.count(value).alias(f"_n_{c}"))
    return aggs


def _mean(total: Column, n: Column, digits: int | None, places: int | None) -> Column:
    if digits is not None and places is not None:
        return exact_mean(total, n, digits, places)
    mean = (total if digits is None else from_units(total, digits)) / F.when(n > 0, n)
    return mean if places is None else F.round(mean, places)


def from_sums(means: list[str], sums: list[str] = (), digits: int | None = None, places: int | None = 3) -> list[Column]:
    """Means, rounded to ``places``, and sums; a sum without values is 0, a mean is null."""
    total = lambda c: F.col(f"_s_{c}") if digits is None else from_units(F.col(f"_s_{c}"), digits)
    return [
        *[_mean(F.col(f"_s_{c}"), F.col(f"_n_{c}"), digits, places).alias(c) for c in means],
        *[F.coalesce(total(c), F.lit(0.0)).alias(c) for c in sums],
    ]


def resample_daily(
    df: DataFrame,
    key: str,
    time: str,
    means: list[str],
    sums: list[str] = (),
    *,
    day: str = "day",
    places: int | None = 3,
    digits: int | None = None,
    count: str | None = None,
    zone: str | None = None,
) -> DataFrame:
    """One row per key and day: means and sums of the measures; means are rounded to ``places``.

    A day without any value has a null mean and a sum of 0. The buffers are sums and counts,
    so the map side combines a hot station to one row per day before the shuffle on
    (key, day). ``digits`` states that the measures have at most so many decimals: sums are
    then integers and bit-equal in every run. Times are UTC; with ``zone``, days are those of
    that time zone.
    """
    aggs = measure_sums(means, sums, digits)
    if count:
        aggs.append(F.count(F.lit(1)).alias(count))
    daily = df.groupBy(key, F.to_date(local_time(F.col(time), zone)).alias(day)).agg(*aggs)
    return daily.select(key, day, *from_sums(means, sums, digits, places), *([count] if count else []))


def local_time(time: Column, zone: str | None) -> Column:
    """Wall clock of a time zone from a UTC time without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), time.cast("timestamp_ntz")) if zone else time


def resample_hourly(
    df: DataFrame, key: str, time: str, means: list[str], *, hour: str = "hour", places: int | None = 3,
    digits: int | None = None,
) -> DataFrame:
    """One row per key and hour with the mean of each measure."""
    at = F.date_trunc("hour", F.col(time)).cast("timestamp_ntz").alias(hour)
    hourly = df.groupBy(key, at).agg(*measure_sums(means, digits=digits))
    return hourly.select(key, hour, *from_sums(means, digits=digits, places=places))


def widen(df: DataFrame, key: list[str], metric: str, values: dict[str, tuple[str, str]]) -> DataFrame:
    """Long readings to one nullable column per measure; a projection, no shuffle.

    ``values`` maps a measure to (metric name, value column).
    """
    cols = [F.when(F.col(metric) == m, F.col(v)).alias(name) for name, (m, v) in values.items()]
    return df.select(*key, *cols)


def daily_max_of_moving_mean(
    df: DataFrame, key: str, time: str, value: str, hours: int = 8, *, day: str = "day", out: str,
    digits: int | None = None, places: int | None = 3,
) -> DataFrame:
    """Daily maximum of the mean over the trailing ``hours`` hours.

    Readings are first summed per key and hour. An hourly row then contributes to its own
    and the following ``hours - 1`` hours, so the moving mean is a plain aggregation on
    (key, hour): no window over a whole station, however long its history.
    """
    hour = F.date_trunc("hour", F.col(time)).cast("timestamp_ntz").alias("_h")
    valid = df.select(key, hour, finite(F.col(value).cast("double")).alias("_v")).where(F.col("_v").isNotNull())
    hourly = valid.groupBy(key, "_h").agg(F.sum(F.col("_v") if digits is None else to_units(F.col("_v"), digits)).alias("_s"), F.count(F.lit(1)).alias("_n"))
    spread = hourly.select(
        key,
        F.posexplode(F.sequence(F.col("_h"), F.col("_h") + F.expr(f"interval {hours - 1} hours"),
                                F.expr("interval 1 hour"))).alias("_ago", "_at"),
        "_s",
        "_n",
    )
    moving = spread.groupBy(key, "_at").agg(
        F.sum("_s").alias("_s"), F.sum("_n").alias("_n"), F.min("_ago").alias("_ago")
    )
    # only hours that have a reading of their own
    return (
        moving.where(F.col("_ago") == 0)
        .groupBy(key, F.to_date("_at").alias(day))
        .agg(F.max(_mean(F.col("_s"), F.col("_n"), digits, places)).alias(out))
    )
