"""Readings arriving as files: duplicates, daily aggregates, late and re-delivered days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.resample import from_sums, measure_sums
from ..session import STATE_STORE


def read_landing(spark: SparkSession, path: str, schema: T.StructType, *, files_per_batch: int | None = None) -> DataFrame:
    """Stream of the Parquet files that land in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def event_time(df: DataFrame, time: str) -> DataFrame:
    """Watermarks need a timestamp with a zone; times are kept in UTC."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def deduplicate(readings: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """First delivery of each reading; state is dropped once it is older than ``late``."""
    return event_time(readings, time).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def daily_updates(
    readings: DataFrame, key: str, time: str, means: list[str], sums: list[str], late: str, *, day: str = "day",
    digits: int | None = None, unique: list[str] | None = None,
) -> DataFrame:
    """Running daily aggregate per station, to be written in update mode.

    State is one row of sums per station and open day; a day closes when the watermark passes
    it. ``unique`` names the columns that identify a reading: each then counts once, however
    often it is delivered within ``late``.
    """
    if unique:
        readings = deduplicate(readings, unique, time, late)
    if not unique:
        readings = event_time(readings, time).withWatermark(time, late)
    daily = readings.groupBy(key, F.window(time, "1 day").alias("_w")).agg(*measure_sums(means, sums, digits))
    return daily.select(key, F.to_date("_w.start").alias(day), *from_sums(means, sums, digits))


VERSION = ["run", "batch_id"]
COMPACTED = -1  # version below those of all batches


def append_changes(batch: DataFrame, batch_id: int, path: str, run: int = 0) -> None:
    """Write a micro-batch as its own partition of a change log.

    A replayed batch replaces its own partition and nothing else, so a lost driver or
    executor can neither lose nor double rows. Batch ids start again at 0 with a new
    checkpoint: such a stream writes with a higher ``run``.
    """
    (
        batch.withColumns({"run": F.lit(run), "batch_id": F.lit(batch_id)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*VERSION)
        .parquet(path)
    )


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest version of each key in a change log."""
    log = spark.read.parquet(path)
    rest = [c for c in log.columns if c not in keys and c not in VERSION]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*VERSION)).alias("_r"))
    return newest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def compact(spark: SparkSession, path: str, target: str, keys: list[str]) -> None:
    """Write the newest versions as the first partition of a new change log.

    Its version lies below those of all batches, so a batch that is replayed after it, the
    last one too, adds its partition and replaces nothing.
    """
    append_changes(current(spark, path, keys), COMPACTED, target, run=COMPACTED)


def run_available(
    df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], *, mode: str = "update",
    state_partitions: int | None = None, state_store: str | None = None,
) -> None:
    """Process everything that has arrived and stop; the next call continues from there."""
    query = start(df, checkpoint, sink, mode=mode, state_partitions=state_partitions, state_store=state_store, availableNow=True)
    query.awaitTermination()


def start(
    df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], *, mode: str = "update",
    state_partitions: int | None = None, state_store: str | None = None, **trigger,
) -> StreamingQuery:
    """Continuous form, e.g. ``processingTime="30 minutes"``.

    ``state_partitions`` sets the number of state partitions, which the first start fixes
    for the life of the checkpoint; a few per core of the cluster is a good choice. The
    default is the session's number of shuffle partitions. ``state_store`` names the provider
    of the state, likewise fixed by the first start; the default is the session's.
    """
    conf = df.sparkSession.conf
    wanted = {"spark.sql.shuffle.partitions": state_partitions, STATE_STORE: state_store}
    usual = {name: conf.get(name) for name in wanted}
    for name, value in wanted.items():
        conf.set(name, str(value or usual[name]))
    try:  # a started query keeps its own copy of the settings
        return (
            df.writeStream.outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .foreachBatch(sink)
            .start()
        )
    finally:
        for name, value in usual.items():
            conf.set(name, value)


def delivery_sink(
    path: str, key: str, time: str, means: list[str], sums: list[str], delivery: str, *, day: str = "day",
    digits: int | None = None, run: int = 0,
):
    """Sink for deliveries of complete days: stores the sums of each day and delivery in a batch.

    A delivery may come in several batches; ``newest_deliveries`` adds its parts up.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        parts = batch.groupBy(key, F.to_date(time).alias(day), delivery).agg(*measure_sums(means, sums, digits))
        append_changes(parts, batch_id, path, run)

    return sink


def newest_deliveries(
    spark: SparkSession, path: str, key: str, means: list[str], sums: list[str], delivery: str, *, day: str = "day",
    digits: int | None = None,
) -> DataFrame:
    """Daily rows of the newest delivery of each day; it replaces older ones as a whole."""
    log = spark.read.parquet(path)
    parts = [c for c in log.columns if c.startswith(("_s_", "_n_"))]
    whole = log.groupBy(key, day, delivery).agg(*[F.sum(c).alias(c) for c in parts])
    newest = whole.groupBy(key, day).agg(F.max_by(F.struct(*parts), F.col(delivery)).alias("_r"))
    return newest.select(key, day, "_r.*").select(key, day, *from_sums(means, sums, digits))
