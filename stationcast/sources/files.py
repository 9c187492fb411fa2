"""CSV, Parquet and JSON files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import utc_time


# csv keeps microseconds; the default format would cut them to milliseconds
CSV = {"header": "true", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with header and declared types; nothing is inferred, so there is no extra pass."""
    return spark.read.schema(schema).options(**CSV).csv(path)


def read_any(spark: SparkSession, csv_path: str, parquet_path: str, schema: T.StructType) -> DataFrame:
    """The CSV copy if there is one, else the Parquet copy; only existence is tested."""
    try:
        return read_csv(spark, csv_path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.read.schema(schema).parquet(parquet_path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(**CSV).csv(path)


def write_partitioned(df: DataFrame, path: str, partition: str, order: list[str]) -> None:
    """Parquet partitioned by a column; only the partitions in ``df`` are replaced.

    Rows are rebalanced on the partition column: adaptive execution splits a partition that
    is too large for one task and merges small ones, so file sizes follow the data.
    """
    (
        df.hint("rebalance", F.col(partition))
        .sortWithinPartitions(partition, *order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def csv_to_parquet(spark: SparkSession, csv_path: str, parquet_path: str, schema: T.StructType, times: list[str]) -> None:
    """Convert once: text times become timestamps; an existing target is left as it is."""
    df = read_csv(spark, csv_path, schema)
    typed = df.withColumns({c: utc_time(F.col(c)) for c in times})
    typed.write.mode("ignore").parquet(parquet_path)


def write_verified(df: DataFrame, path: str, time: str) -> DataFrame:
    """Write Parquet, read it back and compare row count and time range with what was written.

    The expected values are observed during the write, so the input is computed once.
    """
    seen = Observation("written")
    checks = [F.count(F.lit(1)).alias("rows"), F.min(time).alias("first"), F.max(time).alias("last")]
    df.observe(seen, *checks).write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.parquet(path)
    if back.schema[time].dataType != df.schema[time].dataType:
        raise RuntimeError(f"{time} changed type on write")
    expected = seen.get
    report = back.agg(*checks)
    return report.withColumn(
        "ok",
        (F.col("rows") == F.lit(expected["rows"]))
        & F.col("first").eqNullSafe(F.lit(expected["first"]))
        & F.col("last").eqNullSafe(F.lit(expected["last"])),
    )


def rows_as_json(df: DataFrame, out: str = "json") -> DataFrame:
    """One JSON document per row; nulls are kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(out))


def write_json_lines(df: DataFrame, path: str) -> None:
    rows_as_json(df, "value").write.mode("errorifexists").text(path)
