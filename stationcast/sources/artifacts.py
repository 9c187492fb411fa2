"""Registry of trained models and their predictions."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FAMILIES, FAMILY_PREFIX, PREDICTION_SCHEMA
from .files import CSV, read_csv

STAMP = "yyyyMMdd'T'HHmmss'Z'"
ARTIFACT = r"^([a-z]+)_(AQI_t\+\d)_(\d{8}T\d{6}Z)$"


def artifact_name(family, target, created):
    prefix = F.create_map(*[F.lit(x) for f in FAMILIES for x in (f, FAMILY_PREFIX[f])])
    return F.concat_ws("_", prefix[family], target, F.date_format(created, STAMP))


def latest_artifacts(registry: DataFrame, by=("family", "horizon"), created: str = "created") -> DataFrame:
    """Newest entry per family and horizon; an aggregate with map-side combine."""
    rest = [c for c in registry.columns if c not in by and c != created]
    newest = registry.groupBy(*by).agg(F.max(F.struct(created, *rest)).alias("_e"))
    return newest.select(*by, *[F.col(f"_e.{c}").alias(c) for c in (created, *rest)])


def write_predictions(preds: DataFrame, path: str) -> None:
    """CSV files below one folder per artifact (column ``artifact``)."""
    preds.write.mode("errorifexists").partitionBy("artifact").options(**CSV).csv(path)


def newest_folders(files: list[str]) -> list[str]:
    """Newest artifact folder per family and horizon among listed file paths."""
    newest: dict[tuple[str, str], str] = {}
    for name in {unquote(f.rsplit("artifact=", 1)[1].split("/", 1)[0]) for f in files}:
        hit = re.match(ARTIFACT, name)
        if hit:
            newest[hit[1], hit[2]] = max(name, newest.get((hit[1], hit[2]), ""))
    return sorted(newest.values())


def load_predictions(spark: SparkSession, path: str, keys: dict[str, str]) -> DataFrame:
    """Predictions of the newest artifact of each family and horizon.

    Family, horizon and creation time come from the folder name, so choosing the newest
    looks at the listing only and the others are pruned before the scan. ``keys`` are
    further columns of the files.
    """
    schema = T.StructType(list(PREDICTION_SCHEMA.fields))
    for name, kind in keys.items():
        schema = schema.add(name, kind) if name not in schema.names else schema
    df = read_csv(spark, path, schema.add("artifact", "string"))
    part = lambda i: F.regexp_extract("artifact", ARTIFACT, i)
    family = F.create_map(*[F.lit(x) for f in FAMILIES for x in (FAMILY_PREFIX[f], f)])
    return df.where(F.col("artifact").isin(newest_folders(df.inputFiles()))).select(
        family[part(1)].alias("family"),
        F.regexp_replace(part(2), r"AQI_t\+", "hd").alias("horizon"),
        *[c for c in df.columns if c != "artifact"],
    )


def artifact_matrix(registry: DataFrame, families: list[str], horizons: list[str]) -> DataFrame:
    """Whether an artifact exists, per family (row) and horizon (column).

    Every named family has a row, also without any artifact, and so has every other family of
    the registry.
    """
    flags = [
        F.coalesce(F.bool_or(F.col("horizon") == h), F.lit(False)).alias(h) for h in horizons
    ]
    named = registry.sparkSession.createDataFrame([(f,) for f in families], "family string")
    listed = named.withColumn("horizon", F.lit(None).cast("string")).union(registry.select("family", "horizon"))
    return listed.groupBy("family").agg(*flags)
