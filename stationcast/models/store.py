"""Versions of trained models in a folder, and the newest of them for scoring.

A version is visible once its registry row is written, after its models and means: a reader never sees
half of one. ``ModelStore`` looks at the registry, a row per version, whenever it is asked to score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.folds import holdout_split
from ..schemas import KEY, TIME
from . import training

REGISTRY = "version bigint, families array<string>, names array<string>, created timestamp_ntz"


def station_means(features: DataFrame, names: list[str], holdout: int) -> DataFrame:
    """Mean of each feature over a station's training rows: what its missing values became in training."""
    rows = holdout_split(features, KEY, TIME, holdout).where(F.col("split") == "train")
    return rows.groupBy(KEY).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in names])


def publish(models: training.Models, names: list[str], means: DataFrame, path: str, version: int) -> None:
    """Saves a version: models, means, then the row that makes it current if its number is the highest."""
    spark = means.sparkSession
    training.save_models(models, f"{path}/models/{version}")
    means.write.mode("overwrite").parquet(f"{path}/means/{version}")
    families = sorted({f for f, _ in models})
    row = spark.createDataFrame([(version, families, names)], "version bigint, families array<string>, names array<string>")
    row.withColumn("created", F.current_timestamp().cast("timestamp_ntz")).write.mode("append").parquet(f"{path}/registry")


class ModelStore:
    """Scores with the newest published version; a newer one is picked up by the next call."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.version = spark, path, None
        self.models: training.Models = {}
        self.names: list[str] = []

    def refresh(self) -> int:
        registry = self.spark.read.schema(REGISTRY).parquet(f"{self.path}/registry")
        newest = registry.orderBy(F.col("version").desc(), F.col("created").desc()).first()
        if newest is None:
            raise LookupError(f"no model version in {self.path}")
        if newest["version"] != self.version:
            self.models = training.load_models(f"{self.path}/models/{newest['version']}", newest["families"])
            self.names, self.version = newest["names"], newest["version"]
        return self.version

    def score(self, rows: DataFrame) -> DataFrame:
        """A row per input row and horizon, a column per family; needs the feature table's columns.

        Missing features take the station's training mean, then 0, as in training.
        """
        self.refresh()
        means = self.spark.read.parquet(f"{self.path}/means/{self.version}").withColumnsRenamed({c: f"_mean_{c}" for c in self.names})
        known = rows.join(means, KEY, "left").withColumns(
            {c: F.coalesce(F.col(c).cast("double"), F.col(f"_mean_{c}"), F.lit(0.0)) for c in self.names})
        return training.score(self.models, known, [KEY, TIME])
