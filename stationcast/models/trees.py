"""Boosted trees and random forest."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.folds import train_val_cut
from ..schemas import KEY, TIME
from .frame import assembler


def boosted(names: list[str], target: str, *, rounds: int = 100, depth: int = 6, step: float = 0.1,
            min_leaf: int = 20, sampling: float = 0.9, features: str = "0.9", seed: int = 42) -> Pipeline:
    """Boosting with row and feature sampling; stops when the validation rows no longer improve."""
    gbt = GBTRegressor(
        featuresCol="_features", labelCol=target, maxIter=rounds, maxDepth=depth, stepSize=step,
        minInstancesPerNode=min_leaf, subsamplingRate=sampling, featureSubsetStrategy=features,
        validationIndicatorCol="_val", seed=seed,
    )
    return Pipeline(stages=[assembler(names), gbt])


def boosted_histogram(names: list[str], target: str, *, rounds: int = 100, seed: int = 42) -> Pipeline:
    """Boosting on all rows and features with shallower trees and larger steps."""
    return boosted(names, target, rounds=rounds, depth=5, step=0.2, sampling=1.0, features="all", seed=seed)


def forest(names: list[str], target: str, *, trees: int = 600, depth: int = 12, min_leaf: int = 1,
           features: str = "sqrt", seed: int = 42) -> Pipeline:
    rf = RandomForestRegressor(
        featuresCol="_features", labelCol=target, numTrees=trees, maxDepth=depth,
        minInstancesPerNode=min_leaf, featureSubsetStrategy=features, seed=seed,
    )
    return Pipeline(stages=[assembler(names), rf])


def with_validation(train: DataFrame) -> DataFrame:
    """Marks the newest 15 % of each station's training rows for early stopping."""
    cut = train_val_cut(train, KEY, TIME, out="_part")
    return cut.withColumn("_val", F.col("_part") == "val").drop("_part")


def fit_rows(pipeline: Pipeline, train: DataFrame, target: str) -> PipelineModel:
    return pipeline.fit(train.where(F.col(target).isNotNull()))


def importance(model: PipelineModel, names: list[str], spark) -> DataFrame:
    """Normalised importance per feature, highest first."""
    scores = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(names, map(float, scores)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def numbered(df: DataFrame, order: Column, ties: list[str], out: str, parts: int = 1024) -> DataFrame:
    """Adds the row's position from 0 in the order of a 64-bit hash, without sorting the table in one task.

    Rows are counted by the hash's range; a row's position is the number of rows in lower ranges and
    its place in its own.
    """
    width = 2**64 // parts
    df = df.withColumns({"_h": order, "_r": F.floor(order.cast("decimal(20,0)") / F.lit(width)).cast("bigint")})
    ranges = df.groupBy("_r").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("_r", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_r").orderBy("_h", *ties)) - 1
    return df.join(ranges, "_r").withColumn(out, F.col("_before") + within).drop("_h", "_r", "_before")


def shuffled(df: DataFrame, names: list[str], key: list[str], *, seed: int = 42) -> DataFrame:
    """Adds ``s_<feature>``: the feature of another row, by one seeded permutation of all rows.

    The rows in one hash order take the features of the rows in another.
    """
    own = numbered(df, F.xxhash64(F.lit(seed), *key), key, "_at")
    other = numbered(df.select(*key, *names), F.xxhash64(F.lit(seed + 1), *key), key, "_at")
    return own.join(other.select("_at", *[F.col(c).alias(f"s_{c}") for c in names]), "_at").drop("_at")


def permutation_importance(
    model: PipelineModel, holdout: DataFrame, names: list[str], target: str, *, seed: int = 42
) -> DataFrame:
    """Increase of the RMSE when the values of one feature are permuted.

    Every row is scored once as it is and once per feature, in a single transform.
    """
    rows = holdout.where(F.col(target).isNotNull())
    mixed = shuffled(rows, names, [KEY, TIME], seed=seed)
    trial = mixed.withColumn("feature", F.explode(F.array(F.lit(""), *[F.lit(c) for c in names])))
    swapped = trial.withColumns(
        {c: F.when(F.col("feature") == c, F.col(f"s_{c}")).otherwise(F.col(c)) for c in names}
    )
    err = F.col(target) - F.col("prediction")
    scores = model.transform(swapped).groupBy("feature").agg(F.sqrt(F.avg(err * err)).alias("rmse"))
    # one row per feature: a window over all of them scores nothing again
    base = F.max(F.when(F.col("feature") == "", F.col("rmse"))).over(Window.partitionBy())
    return scores.withColumn("rmse_increase", F.col("rmse") - base).where(F.col("feature") != "").select(
        "feature", "rmse_increase").orderBy(F.desc("rmse_increase"), "feature")
