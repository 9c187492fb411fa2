"""Feature columns that depend on one row only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar


def add_calendar(df: DataFrame, time: str) -> DataFrame:
    ts = F.col(time)
    return df.withColumns(
        {
            "month": F.month(ts),
            "season": calendar.season(F.month(ts)),
            "weekday": calendar.weekday_number(ts),
        }
    )


def add_logs(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({f"log_{c}": F.log1p(c) for c in cols})


def one_hot(df: DataFrame, col: str, vocab: list, *, drop_first: bool = False) -> DataFrame:
    """0/1 columns from a fixed vocabulary, so the schema never depends on the data."""
    levels = vocab[1:] if drop_first else vocab
    flags = {f"{col}_{v}": F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0)) for v in levels}
    return df.withColumns(flags).drop(col)


def add_cyclic_calendar(df: DataFrame, time: str) -> DataFrame:
    ts = F.col(time)
    sin_y, cos_y = calendar.cyclic(F.dayofyear(ts), 365.25)
    sin_w, cos_w = calendar.cyclic(F.weekday(ts), 7.0)
    return df.withColumns(
        {
            "doy_sin": sin_y,
            "doy_cos": cos_y,
            "dow_sin": sin_w,
            "dow_cos": cos_w,
            "day": F.dayofmonth(ts),
            "week_of_year": F.weekofyear(ts),
            "is_weekend": calendar.is_weekend(ts),
        }
    )
