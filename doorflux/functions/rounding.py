"""Rounding of doubles by their exact binary value.

``round`` rescales and then rounds the product, so a value that lies just beside
a tie can fall to the wrong side of it. Here the product with 10 or 100 is split
into parts that are exact, added with the rounding error kept, and the error
decides the ties. The value appears many times in the expression: pass a column
that is already computed, not a long expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum_with_error(larger: Column, smaller: Column) -> tuple[Column, Column]:
    """The sum as a double, and the part the double lost."""
    total = larger + smaller
    return total, smaller - (total - larger)


def _scaled(value: Column, digits: int) -> tuple[Column, Column]:
    """``value * 10**digits`` as a double and its error; products by 2**n are exact."""
    if digits == 1:
        return _sum_with_error(value * 8.0, value * 2.0)
    if digits == 2:
        low, low_error = _sum_with_error(value * 32.0, value * 4.0)
        high, high_error = _sum_with_error(value * 64.0, low)
        return high, low_error + high_error
    raise ValueError("digits must be 1 or 2")


def scaled_whole(value: Column, digits: int, ties: str = "even") -> Column:
    """The whole number nearest to ``value * 10**digits``; ties to even or up."""
    if ties not in ("even", "up"):
        raise ValueError("ties must be 'even' or 'up'")
    scaled, error = _scaled(value, digits)
    below = F.floor(scaled).cast("double")
    part = scaled - below
    above = below + 1.0
    at_tie = above if ties == "up" else F.when(
        below / 2.0 == F.floor(below / 2.0).cast("double"), below
    ).otherwise(above)
    return (
        F.when(part < 0.5, below)
        .when(part > 0.5, above)
        .when(error < 0.0, below)
        .when(error > 0.0, above)
        .otherwise(at_tie)
    )


def round_exact(value: Column, digits: int = 1, ties: str = "even") -> Column:
    """``value`` at ``digits`` decimals; never a negative zero."""
    return scaled_whole(value, digits, ties) / float(10**digits) + 0.0


def two_decimals(value: Column) -> Column:
    """A value of 0 or more as text with exactly two decimals."""
    hundredths = scaled_whole(value, 2, ties="up").cast("bigint")
    whole = F.floor(hundredths / 100).cast("string")
    rest = F.lpad((hundredths % 100).cast("string"), 2, "0")
    return F.concat(whole, F.lit("."), rest)


def nearest_whole(value: Column) -> Column:
    """The nearest whole number as a bigint, ties to even."""
    return F.rint(value).cast("bigint")


def percent_change(current: Column, previous: Column) -> Column:
    """The unrounded change in percent; NULL where there was nothing before."""
    before = F.nullif(previous, F.lit(0)).cast("double")
    return (current - previous).cast("double") / before * 100.0


def growth(current: Column, previous: Column, change: Column) -> Column:
    """``change``, the percent change, to one decimal; 100 from nothing to some.

    No rows now (NULL) means no change, whatever there was before.
    """
    return (
        F.when(current.isNull(), F.lit(0.0))
        .when(previous > 0, round_exact(change))
        .when(current > 0, F.lit(100.0))
        .otherwise(F.lit(0.0))
    )
