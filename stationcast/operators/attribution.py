"""Contribution of features and models to predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import nz_div
from .blend import weights_by_horizon
from .quantiles import unpivot


def linear_attribution(df: DataFrame, key: str, coefs: dict[str, float], is_train: str) -> DataFrame:
    """coef * (x - mean of x over the station's training rows), per row and feature."""
    w = Window.partitionBy(key)
    mean = lambda c: F.avg(F.when(F.col(is_train), F.col(c))).over(w)
    return df.withColumns({f"a_{c}": (F.col(c) - mean(c)) * F.lit(v) for c, v in coefs.items()})


def mean_abs_attribution(df: DataFrame, by: list[str], cols: dict[str, str]) -> DataFrame:
    """Mean absolute value per feature; ``cols`` maps feature to attribution column."""
    frame = df.select(*by, *[F.abs(F.col(c)).alias(f) for f, c in cols.items()])
    means = frame.groupBy(*by).agg(*[F.avg(f).alias(f) for f in cols])
    return unpivot(means, by, list(cols), "feature", "mean_abs")


def ensemble_attribution(
    df: DataFrame, weights: DataFrame, families: dict[str, str], features: list[str], horizon: str = "horizon"
) -> DataFrame:
    """Mean absolute value per horizon and feature of the families' weighted mean attribution.

    ``families`` maps a family to its array column, one entry per feature. The weights are
    one map per horizon, so rows are combined in place; only the final means are shuffled.
    """
    df = df.join(F.broadcast(weights_by_horizon(weights, horizon)), horizon)
    size = sum((F.abs(F.coalesce(F.col("_w")[f], F.lit(0.0))) for f in families), F.lit(0.0))
    entries = []
    for i, name in enumerate(features):
        total = sum(
            (F.coalesce(F.col("_w")[f], F.lit(0.0)) * F.col(c)[i] for f, c in families.items()), F.lit(0.0)
        )
        entries.append(F.avg(F.abs(nz_div(total, size))).alias(name))
    return unpivot(df.groupBy(horizon).agg(*entries), [horizon], features, "feature", "mean_abs")
