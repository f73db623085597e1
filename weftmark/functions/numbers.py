"""Numeric helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICE_TYPE = "decimal(18,4)"


def half_up(value: Column, digits: int = 0) -> Column:
    """Round a double half upwards by plain arithmetic, so that every engine gives the same bits."""
    scale = float(10**digits)
    return (F.floor(value.cast("double") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division, null for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def price(raw: Column) -> Column:
    """Text to exact decimal; anything that is no number becomes null."""
    return raw.try_cast(PRICE_TYPE)


def number(raw: Column) -> Column:
    """Text to double; anything that is no number becomes null."""
    return raw.try_cast("double")


def money(value: Column, digits: int = 2) -> Column:
    """Round an exact decimal and hand it out as double."""
    return F.round(value, digits).cast("double")


# Texts round a value that is within a millionth of one half upwards, so that the last bit of a sum, which
# depends on the order of its terms, does not show.
_TEXT_HALF = 0.500001


def thousands(value: Column) -> Column:
    """Whole number with thousands separators, as text."""
    return F.format_string("%,d", F.floor(value + F.lit(_TEXT_HALF)))


def fixed(value: Column, digits: int) -> Column:
    """Number with a fixed count of decimals, as text."""
    scale = float(10**digits)
    return F.format_string(f"%.{digits}f", F.floor(value * F.lit(scale) + F.lit(_TEXT_HALF)) / F.lit(scale))


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row frames with different columns side by side, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
