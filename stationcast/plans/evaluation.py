"""Stacking: weights from past predictions, blend, calibration, accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..models.calibration import isotonic_calibrate
from ..operators.blend import blend_apply, blend_weights
from ..operators.metrics import regression_metrics
from ..schemas import FAMILIES


def recent_blocks(preds: DataFrame, series: list[str], time: str, rows: int) -> DataFrame:
    """Adds ``block``: 0 for the newest ``rows`` rows of each series, 1 for those before, ..."""
    w = Window.partitionBy(*series).orderBy(F.desc(time))
    return preds.withColumn("block", F.floor((F.row_number().over(w) - 1) / F.lit(rows)))


def stack(
    preds: DataFrame,
    key: str,
    time: str,
    *,
    holdout: int = 90,
    families=FAMILIES,
    nonneg: bool = False,
    sum_to_one: bool = False,
    calibrate: bool = False,
    in_sample: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(blended holdout, weights) from predictions with one column per family.

    Weights and calibration are fitted on the ``holdout`` rows before the holdout and
    applied to it. ``in_sample`` fits them on the holdout itself, which makes the reported
    accuracy optimistic.
    """
    cols = [f"p_{f}" for f in families]
    ready = preds.dropna(subset=["y_true", *cols])
    blocks = recent_blocks(ready, [key, "horizon"], time, holdout)
    fit = blocks.where(F.col("block") == (0 if in_sample else 1))
    weights = blend_weights(
        fit, ["horizon"], "y_true", cols, list(families), nonneg=nonneg, sum_to_one=sum_to_one
    )
    keep = [key, time, "y_true", *cols]
    blended = blend_apply(blocks.where(F.col("block") == 0), weights, keep)
    if calibrate:
        fitted = blend_apply(fit, weights, keep)
        blended = isotonic_calibrate(fitted, blended, "horizon", "y_true", "blend", "blend")
    return blended, weights


def stack_metrics(blended: DataFrame, key: str, time: str, last: int = 30) -> DataFrame:
    """Accuracy of the blend per horizon on the whole holdout and on its newest rows."""
    blocks = recent_blocks(blended, [key, "horizon"], time, last)
    scope = F.explode(
        F.when(F.col("block") == 0, F.array(F.lit("full"), F.lit("last"))).otherwise(F.array(F.lit("full")))
    )
    return regression_metrics(blocks.withColumn("scope", scope), ["horizon", "scope"], "y_true", "blend")
