"""Ordered operators over daily series.

They expect one row per key and day, which ``resample_daily`` guarantees, so a window
partition is bounded by the calendar, not by the number of readings. All functions share
the same partitioning and ordering: chained, they cost one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def series(key: str, time: str):
    return Window.partitionBy(key).orderBy(time)


def add_lags(df: DataFrame, key: str, time: str, col: str, ks=(1, 2)) -> DataFrame:
    w = series(key, time)
    return df.withColumns({f"{col}_lag_{k}": F.lag(col, k).over(w) for k in ks})


def add_targets(df: DataFrame, key: str, time: str, col: str, hs=(1, 2, 3)) -> DataFrame:
    w = series(key, time)
    return df.withColumns({f"{col}_t{h}": F.lead(col, h).over(w) for h in hs})


def add_rolling(df: DataFrame, key: str, time: str, col: str, n: int = 3, *, std: bool = True) -> DataFrame:
    """Mean (from one value on) and sample deviation (from two) of the last ``n`` rows."""
    w = series(key, time).rowsBetween(-(n - 1), 0)
    out = {f"{col}_roll_mean_{n}": F.avg(col).over(w)}
    if std:
        out[f"{col}_roll_std_{n}"] = F.stddev_samp(col).over(w)
    return df.withColumns(out)


def add_diff(df: DataFrame, key: str, time: str, col: str) -> DataFrame:
    return df.withColumn(f"{col}_diff", F.col(col) - F.lag(col, 1).over(series(key, time)))


def forward_fill(df: DataFrame, key: str, time: str, cols: list[str]) -> DataFrame:
    w = series(key, time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def last_n(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """Newest ``n`` rows per key.

    Spark limits each key to ``n`` rows per map task before the shuffle, so this is also
    safe on raw readings with a hot key.
    """
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return last_n(df, key, order, 1)
