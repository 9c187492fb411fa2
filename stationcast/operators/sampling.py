"""Ranking and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_by(df: DataFrame, score: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(score), tie).limit(n)


def sort_abs(df: DataFrame, col: str, tie: str) -> DataFrame:
    return df.orderBy(F.abs(F.col(col)).desc(), tie)


def capped_sample(df: DataFrame, key: list[str], n: int = 5000, seed: int = 42) -> DataFrame:
    """Seeded sample of at most ``n`` rows that does not depend on partitioning.

    The rows with the smallest hash of (seed, key): a top-k, no shuffle of the data.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key])
    return df.withColumn("_h", F.md5(text)).orderBy("_h", *key).limit(n).drop("_h")
