"""Forecast of the newest feature rows: predictions, blend, dates, alert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.airquality import alert_level
from ..functions.calendar import horizon_dates
from ..operators.blend import blend_apply, families_of
from ..schemas import HORIZONS, KEY, TIME


def forecast_records(preds: DataFrame, weights: DataFrame, prediction_date, horizons: list[str] = HORIZONS) -> DataFrame:
    """One record per station: every family's and the blend's value per horizon, dates and alert.

    ``preds`` holds the newest row per station and horizon, one column per family. Records
    are built by one aggregation over the horizons of a station; ``horizons`` names, in order,
    those that have a date, further ones stay in the maps.
    """
    families = families_of(preds)
    blended = blend_apply(preds, weights, [KEY, TIME, *[f"p_{f}" for f in families]])

    def by_horizon(col):
        entry = F.when(F.col(col).isNotNull(), F.struct("horizon", col))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    records = blended.groupBy(KEY).agg(
        F.max(TIME).alias("latest_feature_timestamp"),
        *[by_horizon(f"p_{f}").alias(f) for f in families],
        by_horizon("blend").alias("blend"),
        F.max(F.when(F.col("horizon") == horizons[0], F.col("blend"))).alias("_first"),
        F.bool_or(F.coalesce("low_coverage", F.lit(False))).alias("low_coverage"),
    )
    return (
        records.withColumn("prediction_date", prediction_date)
        .withColumn("forecast_dates", horizon_dates(F.col("prediction_date"), len(horizons)))
        .withColumn("alert", alert_level(F.col("_first")))
        .drop("_first")
    )


def choose_series(records: DataFrame, family: str, horizons: list[str] = HORIZONS) -> DataFrame:
    """Forecast of one family, or of the blend, one row per station and date."""
    pairs = F.arrays_zip(F.col("forecast_dates").alias("day"), F.array(*map(F.lit, horizons)).alias("horizon"))
    rows = records.select(KEY, F.col(family).alias("_m"), F.inline(pairs))
    return rows.select(KEY, "day", "horizon", F.col("_m")[F.col("horizon")].alias("value"))
