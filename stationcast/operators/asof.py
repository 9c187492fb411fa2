"""Point-in-time lookup of the newest feature row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_latest(
    requests: DataFrame,
    features: DataFrame,
    key: str,
    request_time: str,
    event_time: str,
    created: str,
    ttl_seconds: int,
) -> DataFrame:
    """Newest feature row of the key at or before the request and not older than the TTL.

    Ties in event time go to the row created last. Requests without a match keep nulls.

    Time is cut into buckets one TTL wide. A feature row is valid from its event time until
    the next row of the key or the end of its TTL, so it can only serve requests of its own
    and of the following bucket. Everything is partitioned by (key, bucket): a key with a
    third of all rows spreads over as many tasks as it has buckets, each request matches at
    most one interval, and no window or group ever holds the history of a key. The features are
    computed and shuffled by bucket once; a window sees the rows of a bucket and of the next.
    Either side may be of any size; AQE broadcasts a small one and splits a skewed bucket.
    """
    ttl = F.expr(f"interval {ttl_seconds} seconds")

    def bucket(c):
        epoch = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
        return F.floor(epoch / F.lit(ttl_seconds))

    values = [c for c in features.columns if c not in (key, event_time, created)]
    newest = (
        features.withColumn(event_time, F.col(event_time).cast("timestamp_ntz"))
        .groupBy(key, event_time)
        .agg(F.max(F.struct(created, *values)).alias("_row"))
        .withColumn("_bucket", bucket(F.col(event_time)))
    )
    # a row also ends the one before it, which may lie in the bucket before: there it stands without values
    kind = newest.schema["_row"].dataType
    ends = newest.select(key, event_time, F.inline(F.array(
        F.struct("_bucket", F.lit(False).alias("_ahead"), "_row"),
        F.struct((F.col("_bucket") - 1).alias("_bucket"), F.lit(True).alias("_ahead"), F.lit(None).cast(kind).alias("_row")))))
    w = Window.partitionBy(key, "_bucket").orderBy(event_time)
    replaced = F.coalesce(~F.lead("_ahead").over(w), F.lit(False))
    valid = (
        ends.withColumns({"_until": F.lead(event_time).over(w), "_replaced": replaced})
        .where(~F.col("_ahead"))
        .withColumn("_expires", F.col(event_time) + ttl)
        .withColumn("_own", F.col("_bucket"))
        .withColumn("_bucket", F.explode(F.array(F.col("_bucket"), F.col("_bucket") + 1)))
        # a row replaced inside its own bucket serves nobody in the following one
        .where((F.col("_bucket") == F.col("_own")) | ~F.col("_replaced"))
    ).alias("v")
    asked = requests.withColumn(
        "_bucket", bucket(F.col(request_time).cast("timestamp_ntz"))
    ).alias("r")
    at = F.col(f"r.{request_time}").cast("timestamp_ntz")
    hit = (
        (F.col(f"r.{key}") == F.col(f"v.{key}"))
        & (F.col("r._bucket") == F.col("v._bucket"))
        & (at >= F.col(f"v.{event_time}"))
        & (at <= F.col("v._expires"))
        & (F.col("v._until").isNull() | (at < F.col("v._until")))
    )
    return asked.join(valid, hit, "left").select(
        *[F.col(f"r.{c}") for c in requests.columns],
        F.col(f"v.{event_time}").alias(event_time),
        F.col(f"v._row.{created}").alias(created),
        *[F.col(f"v._row.{c}").alias(c) for c in values],
    )
