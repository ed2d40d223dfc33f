"""Numeric helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def nan_to_null(column: Column | str) -> Column:
    """NULL for NaN, since Spark's aggregates let a single NaN win."""
    c = as_column(column)
    return F.when(~F.isnan(c), c)


def quoted(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def floor_divide(x: str, divisor: float) -> str:
    """Floor division of doubles for a positive divisor, exact where ``floor(x / y)`` is not.

    Takes and gives SQL text. The quotient is whole up to rounding once the remainder is taken
    off; a negative remainder costs one more step down.
    """
    y = f"{float(divisor)!r}D"
    quotient = f"(({x} - {x} % {y}) / {y} - IF({x} % {y} < 0, 1, 0))"
    return f"(floor({quotient}) + IF({quotient} - floor({quotient}) > 0.5D, 1D, 0D))"


def ratio(numerator: str, denominator: str, on_zero: str = "ieee") -> str:
    """SQL text of a division that never raises.

    ``ieee``: x/0 is an infinity with the sign of x and 0/0 is NULL; ``null``: both are NULL.
    """
    quotient = f"CAST({numerator} AS DOUBLE) / nullif({denominator}, 0)"
    if on_zero == "null":
        return quotient
    if on_zero != "ieee":
        raise ValueError(f"on_zero must be 'ieee' or 'null', not {on_zero!r}")
    return (
        f"CASE WHEN {denominator} = 0 AND {numerator} > 0 THEN DOUBLE('Infinity') "
        f"WHEN {denominator} = 0 AND {numerator} < 0 THEN DOUBLE('-Infinity') ELSE {quotient} END"
    )


def safe_ratio(numerator: str, denominator: str, on_zero: str = "ieee") -> Column:
    """``ratio`` of two columns given by name."""
    return F.expr(ratio(quoted(numerator), quoted(denominator), on_zero))


def row_max(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def row_min(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)


def row_mean(columns: list[Column]) -> Column:
    """Mean of the non-null values of a row; NULL if there are none or the infinities cancel."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    return nan_to_null(total / F.nullif(count, F.lit(0)))


def sigmoid(column: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_column(column)))
