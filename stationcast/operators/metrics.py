"""Accuracy of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.airquality import category

WITHIN = 15.0


def regression_metrics(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """rmse, mae, r2, mape, category accuracy and share within 15, one aggregate per group.

    r2 is 1 - SSE/SST (not a squared correlation); a constant truth scores 1 when hit
    exactly and 0 otherwise. The mape denominator is at least 1.
    """
    t, q = F.col(y), F.col(p)
    err = t - q
    agg = df.where(t.isNotNull() & q.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(err * err).alias("_mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.var_pop(t).alias("_var"),
        (F.avg(F.abs(err) / F.greatest(F.abs(t), F.lit(1.0))) * 100.0).alias("mape_pct"),
        F.avg((category(t) == category(q)).cast("int")).alias("acc_category"),
        F.avg((F.abs(err) <= WITHIN).cast("int")).alias("acc_within_15"),
    )
    mse, var = F.col("_mse"), F.col("_var")
    r2 = F.when(var > 0, 1.0 - mse / F.when(var > 0, var)).otherwise(F.when(mse == 0, 1.0).otherwise(0.0))
    return agg.select(
        *by, "n", F.sqrt(mse).alias("rmse"), "mae", r2.alias("r2"), "mape_pct", "acc_category", "acc_within_15"
    )


def cv_mean_rmse(df: DataFrame, candidate: list[str], fold: str, y: str, p: str) -> DataFrame:
    """Mean over folds of the fold's rmse."""
    err = F.col(y) - F.col(p)
    folds = df.groupBy(*candidate, fold).agg(F.sqrt(F.avg(err * err)).alias("_rmse"))
    return folds.groupBy(*candidate).agg(F.avg("_rmse").alias("cv_rmse"), F.count(F.lit(1)).alias("folds"))
