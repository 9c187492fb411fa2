"""Isotonic calibration of predictions."""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, finite
from ..schemas import AQI_MAX, AQI_MIN


def isotonic_calibrate(fit: DataFrame, apply: DataFrame, by: str, y: str, p: str, out: str, *, groups=None) -> DataFrame:
    """Monotone map from prediction to truth, fitted per group; outside the fitted range it is flat.

    Groups are those of ``fit`` (a few horizons) unless named. Spark averages the truth of equal
    predictions and passes the counts as weights, so the model sees distinct predictions, not rows.
    Results are limited to the index range. All rows of ``apply`` stay: a row without prediction, or
    of a group that was not fitted, has no calibrated value.
    """
    given = F.col(p).cast("double")
    points = (
        fit.where(finite(given).isNotNull() & F.col(y).isNotNull())
        .groupBy(by, given.alias("features"))
        .agg(F.avg(y).alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
        .persist()
    )
    fitted = sorted(r[0] for r in points.where(F.col(by).isNotNull()).select(by).distinct().collect())
    groups = [g for g in fitted if groups is None or g in groups]
    # one pass over the rows: every group's map is a column, and a row takes its own group's
    rows = apply.withColumn("_features", F.coalesce(finite(given), F.lit(0.0)))
    chosen = F.lit(None).cast("double")
    for i, g in enumerate(groups):
        model = IsotonicRegression(
            featuresCol="_features", labelCol="label", weightCol="weight", predictionCol=f"_calibrated_{i}"
        ).fit(points.where(F.col(by) == g).withColumnRenamed("features", "_features"))
        rows = model.transform(rows)
        chosen = F.when(F.col(by) == g, F.col(f"_calibrated_{i}")).otherwise(chosen)
    points.unpersist()
    value = F.when(finite(given).isNotNull(), clamp(chosen, AQI_MIN, AQI_MAX))
    return rows.withColumn(out, value).select(*dict.fromkeys([*apply.columns, out]))
