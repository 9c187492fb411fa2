"""Profiling: summary statistics, correlations, histograms, box plots, density."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import FEATURE_GROUPS, in_group
from ..functions.numeric import finite, from_units, to_units
from .quantiles import exact_quantiles, unpivot


def describe(df: DataFrame, cols: list[str], *, digits: int | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max of the finite values, one row per column.

    ``digits`` states that values have at most so many decimals; means and quartiles are then
    computed in integers.
    """
    long = unpivot(df.select(*[finite(F.col(c).cast("double")).alias(c) for c in cols]), [], cols)
    mean = F.avg("value")
    if digits is not None:
        mean = from_units(F.sum(to_units(F.col("value"), digits)), digits) / F.count("value")
    basic = long.groupBy("measure").agg(
        F.count("value").alias("count"),
        mean.alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(
        long, ["measure"], "value", [0.25, 0.5, 0.75], ["p25", "p50", "p75"], digits=digits
    )
    return basic.join(quartiles, "measure", "left").select(
        "measure", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def missing_per_column(df: DataFrame) -> DataFrame:
    """Rows, missing values and type of every column; one scan."""
    types = dict(df.dtypes)
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.col(f"`{c}`")).alias(f"_n{i}") for i, c in enumerate(df.columns)],
    )
    items = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(types[c]).alias("type"),
                F.col("_rows").alias("rows"),
                (F.col("_rows") - F.col(f"_n{i}")).alias("missing"),
            )
            for i, c in enumerate(df.columns)
        ]
    )
    return row.select(F.inline(items))


def date_range(df: DataFrame, time: str) -> DataFrame:
    return df.agg(
        F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("rows")
    )


def column_means(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols])


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of each pair, over the rows where both are present and finite.

    A row meets every pair of the upper triangle as a number, and the map side keeps the centred sums
    of a pair: one pass for any width, few aggregates in generated code, and a row per pair and task is
    shuffled. Rows (a, b) and (b, a) both appear; a constant column, or a pair without common rows, has
    no correlation.
    """
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    first, second = ([p[k] for p in pairs] for k in (0, 1))
    values = F.array(*[finite(F.col(f"`{c}`").cast("double")) for c in cols])
    rows = df.select(values.alias("_v")).select("_v", F.explode(F.sequence(F.lit(0), F.lit(len(pairs) - 1))).alias("_p"))
    rows = rows.select("_p", *[F.get("_v", F.get(F.lit(at), F.col("_p"))).alias(n) for at, n in ((first, "_x"), (second, "_y"))])
    sums = rows.where("_x is not null and _y is not null").groupBy("_p").agg(
        F.try_divide(F.covar_pop("_x", "_y"), F.sqrt(F.var_pop("_x") * F.var_pop("_y"))).alias("corr"))
    names = F.lit(cols)
    a, b = (F.get(names, F.get(F.lit(at), F.col("_p"))) for at in (first, second))
    every = df.sparkSession.range(len(pairs)).select(F.col("id").cast("int").alias("_p")).join(sums, "_p", "left")
    one, other = (F.struct(x.alias("a"), y.alias("b"), F.col("corr")) for x, y in ((a, b), (b, a)))
    return every.select(F.inline(F.when(a == b, F.array(one)).otherwise(F.array(one, other))))


def histogram(long: DataFrame, by: list[str], value: str, bins: int) -> DataFrame:
    """Counts of ``bins`` equal bins between each group's minimum and maximum.

    The bounds come from a first pass and are a row per group; the second pass bins and
    counts where the rows are. The last bin includes the maximum; empty bins are not listed.
    """
    rows = long.select(*by, finite(F.col(value).cast("double")).alias(value)).where(F.col(value).isNotNull())
    bounds = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    at = F.floor((F.col(value) - F.col("_lo")) / F.when(width > 0, width))
    # a constant group has no width and one bin
    bin_ = F.least(F.coalesce(at, F.lit(0).cast("bigint")), F.lit(bins - 1).cast("bigint"))
    counts = rows.join(bounds, by).groupBy(*by, bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi")
    )
    return counts.select(
        *by, "bin", "count",
        (F.col("_lo") + F.col("bin") * width).alias("bin_lo"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
    )


def boxplot_stats(df: DataFrame, by: list[str], value: str, *, digits: int | None = None, k: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (furthest values within k IQR) and number of outliers per group."""
    quartiles = exact_quantiles(
        df, by, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"], digits=digits
    )
    v, reach = F.col(value), (F.col("q3") - F.col("q1")) * F.lit(k)
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    rows = df.select(*by, finite(v.cast("double")).alias(value)).where(v.isNotNull())
    return (
        rows.join(quartiles, by)
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, v)).alias("whisker_lo"),
            F.max(F.when(inside, v)).alias("whisker_hi"),
            F.sum((~inside).cast("bigint")).alias("outliers"),
            F.count(F.lit(1)).alias("count"),
        )
    )


REACH = 39.0  # bandwidths


def kde_grid(long: DataFrame, by: list[str], value: str, grid: int = 200) -> DataFrame:
    """Gaussian kernel density on ``grid`` points from minimum to maximum, Scott bandwidth.

    Equal values are counted first. Each then meets the points of the grid near it, and the map side
    sums kernels by group and point, so a row per group and point is shuffled. Points further than
    ``REACH`` bandwidths get nothing from a value, as the kernel is 0 there in double precision.
    """
    rows = long.select(*by, finite(F.col(value).cast("double")).alias("_v")).where(F.col("_v").isNotNull())
    stats = rows.groupBy(*by).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.stddev_samp("_v").alias("_sd"),
    )
    stats = stats.select(*by, "_n", "_lo", "_hi", (F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2))).alias("_h")).where(F.col("_h") > 0)
    counts = rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c")).join(stats, by)
    span, last = F.col("_hi") - F.col("_lo"), F.lit(grid - 1)
    at = lambda offset: (F.col("_v") + offset - F.col("_lo")) / span * last
    near = F.sequence(F.greatest(F.floor(at(-REACH * F.col("_h"))), F.lit(0)).cast("int"),
                      F.least(F.ceil(at(REACH * F.col("_h"))), last).cast("int"))
    x = F.col("_lo") + span * F.col("i") / last
    z = (x - F.col("_v")) / F.col("_h")
    sums = counts.withColumn("i", F.explode(near)).groupBy(*by, "i").agg(F.sum(F.col("_c") * F.exp(z * z * F.lit(-0.5))).alias("_k"))
    points = stats.withColumn("i", F.explode(F.sequence(F.lit(0), last))).join(sums, [*by, "i"], "left")
    density = F.coalesce("_k", F.lit(0.0)) / (F.col("_n") * F.col("_h") * F.lit(math.sqrt(2.0 * math.pi)))
    return points.select(*by, "i", x.alias("x"), density.alias("density"))


def feature_catalog(spark, columns: list[str]) -> DataFrame:
    """Number of columns per feature group, by name pattern."""
    names = F.explode(F.array(*[F.lit(c.lower()) for c in columns])).alias("name")
    df = spark.range(1).select(names)
    agg = df.agg(*[F.sum(in_group(F.col("name"), g).cast("int")).alias(g) for g in FEATURE_GROUPS])
    items = [F.struct(F.lit(g).alias("feature_group"), F.col(g).alias("columns")) for g in FEATURE_GROUPS]
    return agg.select(F.inline(F.array(*items)))
