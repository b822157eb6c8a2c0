"""Column helpers shared by the feature and outcome operators."""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def growth(value: Column, base: Column) -> Column:
    """``value / base - 1``; null when either side is null or the base is zero."""
    return F.try_divide(value, base) - F.lit(1.0)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def side(value: Column, threshold: Column) -> Column:
    """``low`` up to and including the threshold, ``high`` above it."""
    return F.when(value <= threshold, "low").when(value > threshold, "high")


def sign_name(value: Column) -> Column:
    return (F.when(value > 0, "positive").when(value < 0, "negative")
            .when(value == 0, "zero"))


def within_tolerance(a: Column, b: Column, atol: float, rtol: float) -> Column:
    """Equal nulls, or ``|a-b| <= atol + rtol*|a|``; never null."""
    close = F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(a)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(close)


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column, for reports compared across engines."""
    return df.select(*[
        F.round(F.col(name), digits).alias(name)
        if kind == "double" and name not in skip else F.col(name)
        for name, kind in df.dtypes])


def persisted(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Round doubles to the scale of the column that stores them."""
    return df.withColumns({name: F.round(F.col(name), scale)
                           for name, scale in columns.items()})


def erfc(value: Column) -> Column:
    """Complementary error function of a non-negative column, to about twelve digits.

    A power series below 2 and a continued fraction, evaluated from its end, above.
    """
    square = value * value
    step = F.struct(F.lit(0.0).alias("total"), value.alias("power"))
    series = F.aggregate(
        F.sequence(F.lit(0), F.lit(40)), step,
        lambda acc, k: F.struct((acc["total"] + acc["power"] / (2 * k + 1)).alias("total"),
                                (-acc["power"] * square / (k + 1)).alias("power")), lambda acc: acc["total"])
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1)), F.lit(1.0), lambda f, k: 1 + k / (2 * square) / f)
    root = math.sqrt(math.pi)
    return F.when(value < 2, 1 - series * (2 / root)).otherwise(F.exp(-square) / (value * root) / fraction)
