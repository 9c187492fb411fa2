"""Weights of a blend, and the blend itself."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, nz_div
from ..schemas import AQI_MAX, AQI_MIN, FAMILIES

ENOUGH_COVERAGE = 0.95


def gram(df: DataFrame, by: list[str], y: str, models: list[str]) -> DataFrame:
    """Sums X'X and X'y of each group in one aggregate; column names ``g_i_j`` and ``b_i``."""
    k = range(len(models))
    return df.groupBy(*by).agg(
        *[
            F.sum(F.col(models[i]) * F.col(models[j])).alias(f"g_{i}_{j}")
            for i, j in itertools.combinations_with_replacement(k, 2)
        ],
        *[F.sum(F.col(models[i]) * F.col(y)).alias(f"b_{i}") for i in k],
    )


def gram_long(df: DataFrame, by: list[str], y: str, models: list[str]) -> DataFrame:
    k = range(len(models))
    cells = [
        F.struct(F.lit(models[i]).alias("a"), F.lit(models[j]).alias("b"), F.col(f"g_{i}_{j}").alias("total"))
        for i, j in itertools.combinations_with_replacement(k, 2)
    ] + [F.struct(F.lit(models[i]).alias("a"), F.lit(y).alias("b"), F.col(f"b_{i}").alias("total")) for i in k]
    return gram(df, by, y, models).select(*by, F.inline(F.array(*cells)))


def least_squares(df: DataFrame, by: list[str], y: str, models: list[str], names: list[str]) -> DataFrame:
    """Unconstrained least-squares weight of each model per group, as rows (by, model, weight).

    The data is reduced to k(k+3)/2 sums per group by Spark; the k x k systems are solved
    group by group inside tasks.
    """
    k = len(models)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                g = np.array([[row[f"g_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                b = np.array([row[f"b_{i}"] for i in range(k)])
                w = np.linalg.lstsq(g, b, rcond=None)[0]
                out += [{**{c: row[c] for c in by}, "model": n, "weight": float(x)} for n, x in zip(names, w)]
            yield pd.DataFrame(out, columns=[*by, "model", "weight"])

    sums = gram(df, by, y, models)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.schema if f.name in by)
    return sums.mapInPandas(solve, f"{fields}, model string, weight double")


def least_squares_pair(df: DataFrame, by: list[str], y: str, models: list[str], names: list[str]) -> DataFrame:
    """Two models: Cramer's rule in SQL expressions."""
    a, b, d = F.col("g_0_0"), F.col("g_0_1"), F.col("g_1_1")
    det = a * d - b * b
    w0 = nz_div(F.col("b_0") * d - F.col("b_1") * b, det)
    w1 = nz_div(F.col("b_1") * a - F.col("b_0") * b, det)
    pair = F.array(
        F.struct(F.lit(names[0]).alias("model"), w0.alias("weight")),
        F.struct(F.lit(names[1]).alias("model"), w1.alias("weight")),
    )
    return gram(df, by, y, models).select(*by, F.inline(pair))


def project_to_simplex(weights: DataFrame, by: list[str], model: str = "model", weight: str = "weight") -> DataFrame:
    """Nearest non-negative weights that sum to 1; a group holds one row per model."""
    w = Window.partitionBy(*by).orderBy(F.desc(weight), model)
    rank = F.row_number().over(w)
    running = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ranked = weights.withColumns({"_k": rank, "_t": (running - 1.0) / rank})
    # the threshold of the last rank whose weight still exceeds it
    theta = F.max_by(F.when(F.col(weight) > F.col("_t"), F.col("_t")),
                     F.when(F.col(weight) > F.col("_t"), F.col("_k"))).over(Window.partitionBy(*by))
    return (
        ranked.withColumn("_theta", theta)
        .withColumn(weight, F.greatest(F.col(weight) - F.col("_theta"), F.lit(0.0)))
        .drop("_k", "_t", "_theta")
    )


def constrain(
    weights: DataFrame, by: list[str], *, nonneg: bool, sum_to_one: bool, model="model", weight="weight"
) -> DataFrame:
    if nonneg and sum_to_one:
        return project_to_simplex(weights, by, model, weight)
    if nonneg:
        return weights.withColumn(weight, F.greatest(F.col(weight), F.lit(0.0)))
    if sum_to_one:
        group = Window.partitionBy(*by)
        total, n = F.sum(weight).over(group), F.count(F.lit(1)).over(group)
        return weights.withColumn(
            weight, F.when(total == 0, 1.0 / n).otherwise(nz_div(F.col(weight), total))
        )
    return weights


def blend_weights(
    df: DataFrame,
    by: list[str],
    y: str,
    models: list[str],
    names: list[str],
    *,
    nonneg: bool = False,
    sum_to_one: bool = False,
) -> DataFrame:
    solve = least_squares_pair if len(models) == 2 else least_squares
    return constrain(solve(df, by, y, models, names), by, nonneg=nonneg, sum_to_one=sum_to_one)


MAX_HORIZONS = 1000


def weights_by_horizon(weights: DataFrame, horizon: str = "horizon") -> DataFrame:
    """One map model -> weight per horizon, of all models and horizons that have a weight.

    Two different weights of one model and horizon are an error, not a choice, and so are more than
    ``MAX_HORIZONS`` horizons: the rows may be broadcast.
    """
    single = weights.groupBy(horizon, "model").agg(F.min("weight").alias("weight"), F.max("weight").alias("_most"))
    checked = F.when(F.col("weight") == F.col("_most"), F.col("weight")).when(F.col("_most").isNull(), F.col("_most")).otherwise(
        F.raise_error(F.concat(F.lit("several weights of "), F.col("model"))).cast("double"))
    maps = single.groupBy(horizon).agg(F.map_from_entries(F.collect_list(F.struct("model", checked.alias("weight")))).alias("_w"))
    few = F.count(F.lit(1)).over(Window.partitionBy()) <= MAX_HORIZONS
    return maps.withColumn("_w", F.when(few, F.col("_w")).otherwise(
        F.raise_error(F.lit("too many horizons")).cast("map<string,double>")))


def families_of(preds: DataFrame) -> list[str]:
    """Families with a column ``p_<family>``: the known ones in fallback order, then the others by name."""
    found = [c.removeprefix("p_") for c in preds.columns if c.startswith("p_")]
    return [f for f in FAMILIES if f in found] + sorted(f for f in found if f not in FAMILIES)


def blend_apply(
    preds: DataFrame, weights: DataFrame, keys: list[str], horizon: str = "horizon"
) -> DataFrame:
    """Weighted mean of the available predictions, limited to the index range, with coverage.

    ``preds`` has one column ``p_<family>`` per family. ``weights`` has rows (horizon, model,
    weight); they are folded into one map per horizon and joined on the horizon, so the predictions are
    neither shuffled nor exploded. Coverage is the
    share of a horizon's whole weight whose models have a prediction, so a weighted model that
    ``preds`` does not hold lowers it. Where a horizon has no weights, the first available family
    in fallback order is used.
    """
    families = families_of(preds)
    df = preds.join(F.broadcast(weights_by_horizon(weights, horizon)), horizon, "left")
    value = total = F.lit(0.0)
    for f in families:
        p, w = F.col(f"p_{f}"), F.coalesce(F.col("_w")[f], F.lit(0.0))
        have = p.isNotNull()
        value = value + F.when(have, w * p).otherwise(0.0)
        total = total + F.when(have, w).otherwise(0.0)
    expected = F.aggregate(F.map_values("_w"), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    fallback = F.coalesce(*[F.col(f"p_{f}") for f in families])
    blended = clamp(value / F.when(total > 0, total), AQI_MIN, AQI_MAX)
    coverage = F.when(F.col("_w").isNotNull(), F.when(expected > 0, total / expected).otherwise(0.0))
    return df.select(
        *keys,
        horizon,
        F.when(F.col("_w").isNull(), fallback).otherwise(blended).alias("blend"),
        coverage.alias("coverage"),
        (coverage < ENOUGH_COVERAGE).alias("low_coverage"),
    )


def blend_fallback(preds: DataFrame, families=FAMILIES):
    """First available prediction in the fixed order."""
    return F.coalesce(*[F.col(f"p_{f}") for f in families])
