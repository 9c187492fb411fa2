"""Intermediate tables in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import work_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet and read back: computed once, and a lost executor costs a re-read."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
