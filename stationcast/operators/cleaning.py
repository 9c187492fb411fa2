"""Projection, coercion, clamping and imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import utc_time
from ..functions.numeric import clamp, to_number
from ..schemas import NOT_FEATURES, TIME


def feature_columns(df: DataFrame, exclude=NOT_FEATURES) -> list[str]:
    return [c for c in df.columns if c not in exclude]


def select_features(df: DataFrame, exclude=NOT_FEATURES) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in feature_columns(df, exclude)])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: to_number(F.col(c)) for c in cols})


def normalize_time(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Text to UTC timestamp; what does not parse becomes null."""
    return df.withColumn(out or col, utc_time(F.col(col)))


def legacy_time(df: DataFrame, legacy: str = "date", time: str = TIME) -> DataFrame:
    """Use an old date column where the time column is absent, then drop it."""
    if time not in df.columns:
        if legacy not in df.columns:
            raise ValueError("no timestamp column")
        df = df.withColumn(time, utc_time(F.col(legacy)))
    return df.drop(legacy)


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.dropna(subset=[target])


def clamp_columns(df: DataFrame, cols: list[str], lo: float, hi: float) -> DataFrame:
    return df.withColumns({c: clamp(F.col(c), lo, hi) for c in cols})


def align_contract(df: DataFrame, contract: list[str], keep: list[str] = ()) -> DataFrame:
    """Exactly the contract's columns in its order; absent, null and non-finite values are 0."""
    have = set(df.columns)
    cols = [
        (F.coalesce(to_number(F.col(f"`{c}`")), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c)
        for c in contract
    ]
    return df.select(*keep, *cols)


def all_null_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """Columns without any value; one aggregate, one row to the driver."""
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] == 0]


def drop_all_null(df: DataFrame, cols: list[str], fitted_on: DataFrame | None = None) -> DataFrame:
    return df.drop(*all_null_columns(df if fitted_on is None else fitted_on, cols))


def iqr_cap(df: DataFrame, key: str, cols: list[str], k: float = 1.5, is_train: str | None = None) -> DataFrame:
    """Limit each column to [Q1 - k IQR, Q3 + k IQR] of its station.

    ``is_train`` names a flag of the rows that the quartiles are taken from, so that later rows do
    not change earlier ones; without it all rows count. The quartiles are window aggregates over the key, so capping shares the shuffle of
    the other series features and needs no join.
    """
    w = Window.partitionBy(key)
    fitted = lambda c: F.when(F.col(is_train), F.col(c)) if is_train else F.col(c)
    df = df.withColumns({f"_q_{c}": F.percentile(fitted(c), [0.25, 0.75]).over(w) for c in cols})
    capped = {}
    for c in cols:
        q1, q3 = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
        reach = (q3 - q1) * F.lit(k)
        capped[c] = clamp(F.col(c), q1 - reach, q3 + reach)
    return df.withColumns(capped).drop(*[f"_q_{c}" for c in cols])


def iqr_bounds(df: DataFrame, key: str, cols: list[str], k: float = 1.5) -> DataFrame:
    """(key, <column>_lo, <column>_hi): [Q1 - k IQR, Q3 + k IQR] of each key's rows, to be stored and reused.

    Taken from training rows, the limits of a day do not depend on later ones.
    """
    quartiles = df.groupBy(key).agg(*[F.percentile(c, [0.25, 0.75]).alias(c) for c in cols])
    out = []
    for c in cols:
        q1, q3 = F.col(c)[0], F.col(c)[1]
        reach = (q3 - q1) * F.lit(k)
        out += [(q1 - reach).alias(f"{c}_lo"), (q3 + reach).alias(f"{c}_hi")]
    return quartiles.select(key, *out)


def cap_to(df: DataFrame, bounds: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Limit each column to its key's stored bounds; a key without bounds stays as it is. Also for streams."""
    names = [f"{c}_{end}" for c in cols for end in ("lo", "hi")]
    limits = bounds.select(F.col(key).alias("_key"), *[F.col(n).alias(f"_{n}") for n in names])
    out = df.join(limits, df[key] == limits["_key"], "left")
    return out.withColumns({c: clamp(F.col(c), F.col(f"_{c}_lo"), F.col(f"_{c}_hi")) for c in cols}).drop("_key", *[f"_{n}" for n in names])


def impute_train_mean(df: DataFrame, key: str, cols: list[str], is_train: str) -> DataFrame:
    """Missing values become the station's mean over its training rows."""
    w = Window.partitionBy(key)
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.avg(F.when(F.col(is_train), F.col(c))).over(w)) for c in cols}
    )


def impute_self_mean(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Missing values become the mean of the row's own frame (station and split)."""
    w = Window.partitionBy(*by)
    return df.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(w)) for c in cols})


def impute_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.fillna(0.0, subset=cols)


def impute_latest_from_history(df: DataFrame, key: str, time: str, cols: list[str]) -> DataFrame:
    """Newest row per key; gaps take the mean of the key's history, then 0.

    One aggregation: the newest row and the means come out of the same map-side combine.
    """
    rest = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(
        F.max(F.struct(time, *[c for c in rest if c != time])).alias("_latest"),
        *[F.avg(c).alias(f"_m_{c}") for c in cols],
    )
    return agg.select(
        key,
        *[
            F.coalesce(F.col("_latest")[c], F.col(f"_m_{c}"), F.lit(0.0)).alias(c)
            if c in cols
            else F.col("_latest")[c].alias(c)
            for c in rest
        ],
    )
