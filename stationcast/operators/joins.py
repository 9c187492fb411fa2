"""Joins of sources, predictions and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outer_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "full_outer")


def missing_dates(present: DataFrame, key: str, day: str, start: Column, end: Column) -> DataFrame:
    """Expected days of each key in [start, end] that are not present.

    Days are folded into one array per key (bounded by the length of the range), so the
    data is shuffled once and not joined with a calendar.
    """
    in_range = F.col(day).between(start, end)
    have = present.groupBy(key).agg(F.collect_set(F.when(in_range, F.col(day))).alias("_have"))
    expected = F.sequence(start, end, F.expr("interval 1 day"))
    return have.select(key, F.explode(F.array_except(expected, F.col("_have"))).alias(day))


def align_predictions(
    preds: DataFrame, keys: list[str], family: str, families: list[str], y_true: str, y_pred: str,
    created: str | None = None,
) -> DataFrame:
    """Rows for which every family has a prediction, one column per family.

    A conditional aggregate over the long table: one shuffle instead of a chain of joins. Of
    repeated predictions the newest by ``created`` counts; without that column, different
    predictions of one family and row are an error.
    """
    cols = []
    for f in families:
        is_f = F.col(family) == f
        p, y = F.when(is_f, F.col(y_pred)), F.when(is_f, F.col(y_true))
        if created:
            newest = F.max_by(F.when(is_f, F.struct(p.alias("p"), y.alias("y"))), F.when(is_f, F.col(created)))
            cols += [newest["p"].alias(f"p_{f}"), newest["y"].alias(f"y_{f}")]
        else:
            several = F.raise_error(F.lit(f"several predictions of {f} for one row")).cast("double")
            cols += [F.when(F.min(p) != F.max(p), several).otherwise(F.max(p)).alias(f"p_{f}"), F.max(y).alias(f"y_{f}")]
    wide = preds.where(F.col(y_pred).isNotNull() & F.col(y_true).isNotNull()).groupBy(*keys).agg(*cols)
    return wide.dropna(subset=[f"p_{f}" for f in families])


def truth_mismatch(wide: DataFrame, families: list[str], tol: float = 1e-6, rel: float = 1e-5) -> Column:
    """True where a family was scored against another truth than the first one."""
    first = F.col(f"y_{families[0]}")
    bad = F.lit(False)
    for f in families[1:]:
        other = F.col(f"y_{f}")
        bad = bad | (F.abs(first - other) > F.lit(tol) + F.lit(rel) * F.abs(other))
    return bad


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Raise when a join left nothing."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def align_features(features: DataFrame, preds: DataFrame, keys: list[str]) -> DataFrame:
    """Features of the predicted rows, matched by key and not by position."""
    return features.join(preds, keys, "inner")
