"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite, from_units, to_units
from ..session import stored


def unpivot(df: DataFrame, by: list[str], cols: list[str], name: str = "measure", value: str = "value") -> DataFrame:
    return df.select(*by, *cols).unpivot(by, cols, name, value)


BITS, LEVELS = 16, 4  # of the 64-bit image that a level tells apart, and levels


def order_image(value: Column) -> Column:
    """A whole number of 64 bits for each finite double, in the order of the doubles and different for each.

    The magnitude is exponent and fraction as they stand in memory, found by exact steps: powers of two
    and products with them do not round.
    """
    size = F.abs(value)
    power = lambda e: F.pow(F.lit(2.0), e)
    guess = F.floor(F.log2(size)).cast("double")
    # close to a power of two the logarithm may round to the wrong side
    exponent = F.when(size < power(guess), guess - 1).when(size / power(guess) >= 2.0, guess + 1).otherwise(guess)
    fraction = size / power(exponent) - 1.0
    normal = (exponent.cast("bigint") + 1023) * F.lit(1 << 52) + (fraction * float(1 << 52)).cast("bigint")
    tiny = (size * power(F.lit(537.0)) * power(F.lit(537.0))).cast("bigint")
    image = F.when(size < 2.0**-1022, tiny).otherwise(normal)
    return F.when(value < 0, -image).otherwise(image)


def _wanted_parts(counts: DataFrame, within: list[str], count: str) -> DataFrame:
    """Of the counted parts of ``within`` those that hold a wanted rank, with the ranks and the rows in front.

    counts: within, _p, _c, _start (rows in front of the whole), _n, _want. A row per part; at most
    2 ** BITS of them share ``within``.
    """
    w = Window.partitionBy(*within).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_end", F.col("_start") + F.sum(count).over(w))
    placed = placed.withColumn("_start", F.col("_end") - F.col(count))
    inside = F.filter("_want", lambda r: (r["rank"] >= F.col("_start")) & (r["rank"] < F.col("_end")))
    return placed.withColumn("_want", inside).where(F.size("_want") > 0)


def exact_quantiles(
    long: DataFrame,
    by: list[str],
    value: str,
    probs: list[float],
    names: list[str],
    *,
    digits: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles of the finite values, exact to the double.

    ``percentile`` keeps every distinct value of a group in one task. Here the values' order-keeping
    64-bit images are refined ``BITS`` at a time: a first pass counts the values by their first bits, and
    running totals tell which parts hold the wanted ranks; a second pass counts the distinct values of
    those parts only and stores them; the further bits are counted from there. Everything combines on
    the map side, and whatever the values are, a window sees at most 2 ** ``BITS`` totals, so one group
    may hold all rows and any tail. ``digits`` states that values have at most so many decimals: ranks
    are then interpolated between integers.
    """
    number = finite(F.col(value).cast("double"))
    number = number + F.lit(0.0) if digits is None else to_units(number, digits)
    # as a struct, a group with a null in its key joins like any other
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    rows = long.select(group.alias("_g"), number.alias("_v")).where(F.col("_v").isNotNull())
    image = order_image(F.col("_v")) if digits is None else F.col("_v").cast("bigint")
    part = lambda level: F.shiftright("_k", BITS * (LEVELS - 1 - level))
    totals = rows.withColumn("_k", image).groupBy("_g", part(0).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    totals = totals.withColumn("_n", F.sum("_c").over(Window.partitionBy("_g"))).withColumn("_start", F.lit(0).cast("bigint"))
    wanted = []
    for i, p in enumerate(probs):
        at = (F.col("_n") - 1) * F.lit(float(p))
        wanted += [
            F.struct(F.lit(2 * i).alias("id"), F.floor(at).alias("rank")),
            F.struct(F.lit(2 * i + 1).alias("id"), F.ceil(at).alias("rank")),
        ]
    found = stored(_wanted_parts(totals.withColumn("_want", F.array(*wanted)), ["_g"], "_c").select("_g", "_p", "_start", "_n", "_want"), "quantile-parts")
    inside = rows.withColumn("_k", image).withColumn("_p", part(0)).join(found.select("_g", "_p"), ["_g", "_p"], "left_semi")
    values = stored(inside.groupBy("_g", "_k").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_v")), "quantile-values")
    for level in range(1, LEVELS):
        within = found.select("_g", F.col("_p").alias("_w"), "_start", "_n", "_want")
        counts = values.withColumns({"_w": part(level - 1), "_p": part(level)}).groupBy("_g", "_w", "_p").agg(
            F.sum("_c").alias("_c"), F.min("_v").alias("_v"))
        found = _wanted_parts(counts.join(within, ["_g", "_w"]), ["_g", "_w"], "_c").select("_g", "_p", "_start", "_n", "_want", "_v")
    hits = found.select("_g", "_n", "_v", F.explode("_want.id").alias("_id"))
    at_rank = hits.groupBy("_g").agg(
        F.first("_n").alias("_n"),
        *[F.max(F.when(F.col("_id") == i, F.col("_v"))).alias(f"_r{i}") for i in range(2 * len(probs))],
    )
    out = []
    for i, (p, name) in enumerate(zip(probs, names)):
        at = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_r{2 * i}"), F.col(f"_r{2 * i + 1}")
        at_value = lo + (hi - lo) * (at - F.floor(at))
        out.append((at_value if digits is None else from_units(at_value, digits)).alias(name))
    return at_rank.select(*[F.col("_g")[c].alias(c) for c in by], *out)
