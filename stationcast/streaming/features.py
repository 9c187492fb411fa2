"""Two chained streams: readings to daily rows, daily rows to features and forecasts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import latest
from ..plans.scoring import forecast_records
from ..schemas import AVERAGED, KEY, MEASURES, SUMMED, TIME
from . import ingest
from .history import feature_rows

DAILY_SCHEMA = "{key} {kind}, {time} timestamp_ntz, " + ", ".join(f"{m} double" for m in MEASURES) + ", run int, batch_id bigint"


def daily_stream(readings: DataFrame, late: str, *, digits: int | None = None, unique: list[str] | None = None) -> DataFrame:
    """Daily rows of all measures, in update mode; ``unique`` names what identifies a reading."""
    days = ingest.daily_updates(readings, KEY, "time", AVERAGED, SUMMED, late, digits=digits, unique=unique)
    return days.withColumn(TIME, F.col("day").cast("timestamp_ntz")).select(KEY, TIME, *MEASURES)


def daily_sink(path: str, run: int = 0) -> Callable[[DataFrame, int], None]:
    return lambda batch, batch_id: ingest.append_changes(batch, batch_id, path, run)


def feature_stream(spark: SparkSession, daily_path: str, bounds: DataFrame, late_days: int, key_type: str = "bigint") -> DataFrame:
    """Feature rows from the daily rows that the first stream writes; each of its files is read once.

    ``late_days`` is at least the first stream's lateness in days, and one more for the day itself. A batch
    that the first stream repeats replaces its files: those that are gone are passed over. Its state needs
    RocksDB: start it with ``state_store=ROCKSDB`` where the session has another provider.
    """
    schema = DAILY_SCHEMA.format(key=KEY, kind=key_type, time=TIME)
    daily = spark.readStream.schema(schema).option("ignoreMissingFiles", "true").parquet(daily_path)
    return feature_rows(daily, bounds, late_days)


def feature_sink(path: str, run: int = 0) -> Callable[[DataFrame, int], None]:
    return lambda batch, batch_id: ingest.append_changes(batch, batch_id, path, run)


def forecast_sink(
    feature_path: str, forecast_path: str, score: Callable[[DataFrame], DataFrame], weights: DataFrame, prediction_date, run: int = 0,
) -> Callable[[DataFrame, int], None]:
    """Sink for feature rows: stores them, and the forecast of the newest row of each station in the batch.

    A batch holds every row behind a changed one, so the newest row of a station it has is the newest there
    is. ``score`` maps feature rows to rows (station, time, horizon, p_<family>...), e.g. ``ModelStore.score``,
    which picks up a newer model between batches; the records carry blend, dates and alert.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # the state is advanced once
        try:
            ingest.append_changes(batch, batch_id, feature_path, run)
            records = forecast_records(score(latest(batch, KEY, [TIME])), weights, prediction_date)
            ingest.append_changes(records, batch_id, forecast_path, run)
        finally:
            batch.unpersist()

    return sink


def is_fresh(df: DataFrame, time: str, today) -> bool:
    """Whether the table already reaches ``today``; the gate before an update."""
    newest = df.agg(F.to_date(F.max(time)).alias("d")).first()["d"]
    return newest is not None and newest >= today


def refresh(features: DataFrame | None, time: str, today, update: Callable[[], None]) -> bool:
    """Runs the update unless the feature table (None: there is none yet) reaches ``today``; whether it ran."""
    if features is not None and is_fresh(features, time, today):
        return False
    update()
    return True
