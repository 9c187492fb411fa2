"""Structured Streaming over the given tables, delivered in several parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import training
from ..models.store import ModelStore, publish, station_means
from ..operators.blend import project_to_simplex
from ..operators.windows import latest
from ..plans.features import add_features, freshness
from ..plans.scoring import forecast_records
from ..schemas import AQI_MAX, AQI_MIN, AVERAGED, FAMILIES, HORIZONS, KEY, MEASURES, SUMMED, TIME
from ..session import ROCKSDB, stored, work_path, workers_import_package
from ..streaming import features as sf
from ..streaming import ingest
from . import inputs as src
from . import query
from .features import CAPPED_ON, ROUNDED, bounds_before_cut, features_sql
from .joins import CUT
from .ordered import raw_weights

MODEL_HOLDOUT, ROUNDS, TREES = 3, 10, 20
TIME_OF = "latest_feature_timestamp"

LATE, LATE_DAYS = "2 days", 2


def deliveries(spark, sf_dir):
    """Readings in two deliveries, split in time; a third of the last day before the cut comes with the second one."""
    df = src.readings(spark, sf_dir)
    cut = F.lit(CUT).cast("timestamp_ntz")
    late = (F.col("time") >= cut - F.expr("interval 1 day")) & (F.col("event_id") % 3 == 0)
    first = (F.col("time") < cut) & ~late
    return [df.where(first), df.where(~first)]


def too_late(spark, sf_dir):
    """Readings of days that are closed once the deliveries are in, under new names: none of them counts."""
    df = src.readings(spark, sf_dir).where(F.col("time") < F.lit("2024-01-10").cast("timestamp_ntz"))
    return df.withColumn("event_id", -1 - F.col("event_id"))


def run(parts, landing, make_stream, checkpoint, sink, mode="update"):
    """Let each part land, then process what is new."""
    for part in parts:
        part.write.mode("append").parquet(landing)
        stream = make_stream(ingest.read_landing(part.sparkSession, landing, part.schema))
        cores = part.sparkSession.sparkContext.defaultParallelism
        ingest.run_available(stream, checkpoint, sink, mode=mode, state_partitions=cores)


@query("stream_daily", f"WITH {src.DAILY} SELECT station_id, CAST({TIME} AS DATE) AS day, {', '.join(MEASURES)} FROM daily")
def stream_daily(spark, sf_dir):
    path = work_path(spark, "stream-daily")
    run(
        [*deliveries(spark, sf_dir), too_late(spark, sf_dir)], f"{path}/landing",
        lambda s: ingest.daily_updates(s, KEY, "time", AVERAGED, SUMMED, LATE, digits=src.DIGITS, unique=[KEY, "event_id"]),
        f"{path}/checkpoint",
        lambda b, i: ingest.append_changes(b, i, f"{path}/daily"),
    )
    return ingest.current(spark, f"{path}/daily", [KEY, "day"])


@query("stream_dedup", f"WITH {src.READINGS} SELECT station_id, event_id, aqi, co FROM readings")
def stream_dedup(spark, sf_dir):
    path = work_path(spark, "stream-dedup")
    df = src.readings(spark, sf_dir).select(KEY, "time", "event_id", "aqi", "co")
    run(
        [df, df], f"{path}/landing", lambda s: ingest.deduplicate(s, [KEY, "event_id"], "time", LATE),
        f"{path}/checkpoint", lambda b, i: ingest.append_changes(b, i, f"{path}/clean"), mode="append",
    )
    return spark.read.parquet(f"{path}/clean").drop(*ingest.VERSION, "time")


@query(
    "stream_upsert",
    f"WITH {src.READINGS}, told AS (SELECT station_id, time, CASE WHEN time >= TIMESTAMP '{CUT}' THEN aqi + 1 ELSE aqi "
    f"END AS aqi FROM readings) SELECT station_id, CAST(time AS DATE) AS day, {src.mean3('aqi')} AS aqi "
    "FROM told GROUP BY 1, 2",
)
def stream_upsert(spark, sf_dir):
    path = work_path(spark, "stream-upsert")
    df = src.readings(spark, sf_dir).select(KEY, "time", "event_id", "aqi").withColumn("delivery", F.lit(1))
    again = df.where(F.col("time") >= F.lit(CUT).cast("timestamp_ntz")).withColumn("aqi", F.col("aqi") + 1.0)
    again = again.withColumn("delivery", F.lit(2))
    # the second delivery comes in two parts
    even = F.col("event_id") % 2 == 0
    parts = [df, again.where(even), again.where(~even)]
    sink = ingest.delivery_sink(f"{path}/daily", KEY, "time", ["aqi"], [], "delivery", digits=src.DIGITS)
    run(parts, f"{path}/landing", lambda s: s, f"{path}/checkpoint", sink)
    return ingest.newest_deliveries(spark, f"{path}/daily", KEY, ["aqi"], [], "delivery", digits=src.DIGITS)


def run_chained(spark, sf_dir, path, bounds, sink):
    """Each delivery goes through the daily stream and then, day by day, through the feature stream.

    A part of the first delivery arrives once more with the second one: a reading counts once.
    """
    workers_import_package(spark)
    first, second = deliveries(spark, sf_dir)
    again = first.where(F.col("time") >= F.lit(CUT).cast("timestamp_ntz") - F.expr("interval 1 day"))
    cores = spark.sparkContext.defaultParallelism
    for part in (first, second.unionByName(again)):
        part.write.mode("append").parquet(f"{path}/landing")
        readings = ingest.read_landing(spark, f"{path}/landing", part.schema)
        days = sf.daily_stream(readings, LATE, digits=src.DIGITS, unique=[KEY, "event_id"])
        ingest.run_available(days, f"{path}/checkpoint-daily", sf.daily_sink(f"{path}/daily"), state_partitions=cores)
        rows = sf.feature_stream(spark, f"{path}/daily", bounds, LATE_DAYS + 1)
        ingest.run_available(rows, f"{path}/checkpoint-features", sink, mode="append", state_partitions=cores, state_store=ROCKSDB)


@query("stream_features", f"WITH {features_sql(CAPPED_ON)} SELECT * FROM features")
def stream_features(spark, sf_dir):
    """The complete feature table from state per station: late, repeated and new days included."""
    path = work_path(spark, "stream-features")
    bounds = bounds_before_cut(src.daily(spark, sf_dir))
    run_chained(spark, sf_dir, path, bounds, sf.feature_sink(f"{path}/features"))
    out = ingest.current(spark, f"{path}/features", [KEY, TIME])
    return out.withColumns({c: F.round(c, 6) for c in ROUNDED})


@query(
    "stream_forecast",
    f"WITH {src.DAILY} SELECT station_id, max({TIME}) AS latest_feature_timestamp, 4 AS families, true AS in_range, "
    "true AS same_as_batch FROM daily GROUP BY 1",
)
def stream_forecast(spark, sf_dir):
    """Forecasts by four fitted families, scored in the stream, beside those of the whole table in a batch."""
    path = work_path(spark, "stream-forecast")
    daily = stored(src.daily(spark, sf_dir), "daily")
    bounds = bounds_before_cut(daily)
    # stored: every fit, and the means, read it
    known = stored(add_features(daily.where(F.col(TIME) < F.lit(CUT).cast("timestamp_ntz")), bounds=bounds), "known")
    models, frame, names = training.train_families(known, MODEL_HOLDOUT, FAMILIES, rounds=ROUNDS, n_trees=TREES, huber=False)
    frame.unpersist()
    store_path = f"{path}/models"
    publish(models, names, station_means(known, names, MODEL_HOLDOUT), store_path, version=1)
    store = ModelStore(spark, store_path)
    weights = stored(project_to_simplex(raw_weights(spark, sf_dir), ["horizon"]), "weights")
    date = F.to_date("latest_feature_timestamp")
    run_chained(spark, sf_dir, path, bounds, sf.forecast_sink(f"{path}/features", f"{path}/forecast", store.score, weights, date))
    streamed = ingest.current(spark, f"{path}/forecast", [KEY])
    whole = forecast_records(store.score(latest(add_features(daily, bounds=bounds), KEY, [TIME])), weights, date)
    whole = whole.select(KEY, F.col("blend").alias("_blend"), F.col("alert").alias("_alert"), F.col(TIME_OF).alias("_at"))
    close = F.forall(F.array(*map(F.lit, HORIZONS)), lambda h: F.abs(F.col("blend")[h] - F.col("_blend")[h]) < 1e-6)
    values = F.flatten(F.array(F.map_values("blend"), *[F.map_values(f) for f in FAMILIES]))
    return streamed.join(whole, KEY).select(
        KEY, TIME_OF, sum(((F.size(f) == len(HORIZONS)).cast("int") for f in FAMILIES), F.lit(0)).alias("families"),
        F.forall(F.map_values("blend"), lambda v: v.between(AQI_MIN, AQI_MAX)).alias("in_range"),
        (close & (F.size(values) == 15) & F.col("alert").eqNullSafe(F.col("_alert")) & (F.col(TIME_OF) == F.col("_at"))).alias("same_as_batch"),
    )


@query(
    "freshness_gate",
    f"WITH {src.DAILY}, l AS (SELECT station_id, max(event_timestamp) AS m FROM daily GROUP BY 1) "
    "SELECT count(*) AS stations, sum(CASE WHEN m >= TIMESTAMP '2024-01-30' THEN 0 ELSE 1 END)::BIGINT AS stale FROM l",
)
def freshness_gate(spark, sf_dir):
    rows = freshness(src.daily(spark, sf_dir), KEY, TIME, F.lit("2024-01-30").cast("date"))
    return rows.agg(
        F.count(F.lit(1)).alias("stations"), F.sum((~F.col("is_fresh")).cast("bigint")).alias("stale")
    )
