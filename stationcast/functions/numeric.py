"""Numeric column functions: cleaning, clamping and exact fixed-point means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities become null, so that one bad value cannot spoil an aggregate."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def to_number(c: Column) -> Column:
    """Parse to double; text that is no number, NaN and infinities become null."""
    return finite(c.try_cast("double"))


def clamp(c: Column, lo, hi) -> Column:
    """Limit to [lo, hi]; null stays null (``greatest`` alone would return the bound)."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def to_units(c: Column, digits: int) -> Column:
    """Fixed-point integer of a value that has at most ``digits`` decimals.

    Integer sums do not depend on the order of the shuffle, so a re-run task or a
    re-delivered day gives bit-equal results. A value with more decimals, or too large for
    a long, is an error: nothing is rounded away.
    """
    scaled = c * F.lit(float(10**digits))
    fits = F.abs(scaled - F.rint(scaled)) <= 1e-6 + F.abs(scaled) * F.lit(1e-15)
    message = F.concat(F.lit(f"more than {digits} decimals: "), c.cast("string"))
    return F.when(fits | c.isNull(), F.rint(scaled)).otherwise(F.raise_error(message).cast("double")).cast("bigint")


def from_units(c: Column, digits: int) -> Column:
    return c / F.lit(float(10**digits))


def exact_mean(total: Column, n: Column, digits: int, places: int) -> Column:
    """``round(total / n, places)`` of fixed-point ``total``, halves away from zero, in integers.

    The total itself is never multiplied, so it may use the whole range of a long.
    """
    size, n = F.abs(total), F.when(n > 0, n)
    div = lambda a, b: F.call_function("div", a, b)
    if places >= digits:
        factor = F.lit(10 ** (places - digits))
        whole = div(size, n) * factor + div((size % n) * factor * 2 + n, n * 2)
    else:
        den = n * F.lit(10 ** (digits - places))
        whole = div(size, den) + div((size % den) * 2 + den, den * 2)
    return F.signum(total) * whole / F.lit(float(10**places))


def nz_div(a: Column, b: Column) -> Column:
    """Quotient that is null when the divisor is 0."""
    return a / F.when(b != 0, b)
