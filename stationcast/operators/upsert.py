"""Set operations and replacement of rows in the feature table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_batches(batches: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, batches)


def union_missing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns one side lacks are null there."""
    return a.unionByName(b, allowMissingColumns=True)


def not_replaced(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(new.select(*keys), keys, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows whose key is not in ``new``, plus ``new``; doing it twice changes nothing."""
    return union_missing(not_replaced(existing, new, keys), new)


def date_difference(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Distinct rows of ``expected`` that are not in ``present``."""
    return expected.subtract(present)


def distinct_dates(df: DataFrame, time: str, out: str = "day") -> DataFrame:
    return df.select(F.to_date(time).alias(out)).distinct().orderBy(out)
