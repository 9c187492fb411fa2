"""JSON payloads that hold one array per column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIME_FORMAT = "yyyy-MM-dd'T'HH:mm"


def payload_schema(fields: list[str]) -> str:
    cols = ", ".join(f"{f}: array<double>" for f in fields)
    return f"hourly struct<time: array<string>, {cols}>"


def parse_payloads(df: DataFrame, keep: list[str], text: str, fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected payloads).

    A payload is rejected when it is empty, no JSON, its arrays differ in length, or one of its
    times does not parse.
    """
    parse = lambda t: F.try_to_timestamp(t, F.lit(TIME_FORMAT)).cast("timestamp_ntz")
    parsed = df.withColumn("_p", F.from_json(text, payload_schema(list(fields))).getField("hourly"))
    n = F.size("_p.time")
    ok = F.col("_p").isNotNull() & (n > 0)
    for f in fields:
        ok = ok & (F.size(f"_p.{f}") == n)
    ok = F.coalesce(ok & F.forall("_p.time", lambda t: parse(t).isNotNull()), F.lit(False))
    arrays = F.arrays_zip(F.col("_p.time").alias("time"), *[F.col(f"_p.{f}").alias(f) for f in fields])
    rows = parsed.where(ok).select(*keep, F.inline(arrays)).select(
        *keep,
        parse(F.col("time")).alias("time"),
        *[F.col(f).alias(name) for f, name in fields.items()],
    )
    return rows, parsed.where(~ok).select(*keep, text)


def build_payloads(df: DataFrame, keys: list[str], time: str, fields: dict[str, str], out: str = "payload") -> DataFrame:
    """One payload per key, arrays in time order. A group must be small, e.g. the hours of a day."""
    names = {v: k for k, v in fields.items()}
    row = F.struct(F.date_format(time, TIME_FORMAT).alias("time"), *[F.col(c).alias(names[c]) for c in names])
    grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_r"))
    hourly = F.struct(F.col("_r.time").alias("time"), *[F.col(f"_r.{f}").alias(f) for f in fields])
    return grouped.select(*keys, F.to_json(F.struct(hourly.alias("hourly"))).alias(out))
