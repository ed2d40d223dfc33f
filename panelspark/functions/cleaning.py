"""Row-level cleaning as column expressions.

Missing values are SQL NULL throughout; ``numeric.nan_to_null`` removes NaN at ingestion.
Functions take a column or a column name.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.numeric import as_column, floor_divide

ORDINAL_TOLERANCE = 1e-6
GRID_WIDTH = 0.01


def ordinalize(column: Column | str, interval: float = 1.0, offset: float = 0.0) -> Column:
    """Index of the step of width ``interval`` a noisy value lies on; missing becomes -1."""
    c = as_column(column)
    shifted = c + F.lit(offset) if offset else c
    step = F.floor(shifted / F.lit(interval) + F.lit(ORDINAL_TOLERANCE))
    return F.coalesce(step, F.lit(-1)).cast("int")


def clip_range(column: Column | str, high: float, low: float = -999.0) -> Column:
    """Clip to [low, high]. The null guard is needed: ``least`` skips nulls."""
    c = as_column(column)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def threshold_zero(column: Column | str, threshold: float = 0.01) -> Column:
    """Set values up to ``threshold``, negative ones too, to zero."""
    c = as_column(column)
    return F.when(c <= F.lit(threshold), F.lit(0.0)).otherwise(c)


def scale_floor(column: Column | str, factor: float) -> Column:
    return F.coalesce(F.floor(as_column(column) * F.lit(factor)), F.lit(-1)).cast("int")


def scale_round_even(column: Column | str, factor: float) -> Column:
    """Scale and round half to even; missing becomes -1."""
    return F.coalesce(F.rint(as_column(column) * F.lit(factor)), F.lit(-1.0)).cast("int")


def snap_grid(column: Column | str, points: Sequence[float], width: float = GRID_WIDTH) -> Column:
    """Pull values in [p, p + width] back to p, for every point p of an ascending grid.

    A snapped value lies below all later points, so the first match decides.
    """
    if list(points) != sorted(points):
        raise ValueError("grid points must ascend")
    c = as_column(column)
    branches = F
    for p in points:
        branches = branches.when(c.between(F.lit(float(p)), F.lit(p + width)), F.lit(float(p)))
    return branches.otherwise(c)


@dataclass(frozen=True)
class Override:
    """Replace a target in [low, high] by ``value`` where ``condition`` holds.

    ``condition`` is SQL text over other columns, e.g. ``"S_15 <= 6"``.
    """

    low: float
    high: float
    condition: str
    value: float


def conditional_override(column: Column | str, rules: Sequence[Override]) -> Column:
    """Apply override rules in order, each seeing the outcome of those before it.

    A rule that fires leaves a constant, so what later rules make of it is decided here,
    on the driver, and the expression stays linear in the number of rules.
    """
    c = as_column(column)
    branches = F
    for i, rule in enumerate(rules):
        hit = c.between(F.lit(float(rule.low)), F.lit(float(rule.high))) & F.expr(rule.condition)
        branches = branches.when(hit, _settle(rule.value, rules[i + 1 :]))
    return branches.otherwise(c) if rules else c


def _settle(value: float, later: Sequence[Override]) -> Column:
    for i, rule in enumerate(later):
        if rule.low <= value <= rule.high:
            rest = later[i + 1 :]
            return F.when(F.expr(rule.condition), _settle(rule.value, rest)).otherwise(_settle(value, rest))
    return F.lit(float(value))


def dict_encode(column: Column | str, codes: Mapping[str, int], null_code: int | None = None) -> Column:
    """Integer code of a category. An unknown value, or a null without ``null_code``, fails the job."""
    c = as_column(column)
    unknown = F.raise_error(F.concat(F.lit("no code for category "), F.coalesce(c, F.lit("NULL")))).cast("int")
    branches = F.when(c.isNull(), unknown if null_code is None else F.lit(null_code))
    for value, code in codes.items():
        branches = branches.when(c == F.lit(value), F.lit(code))
    return branches.otherwise(unknown)


def floor_to_cent(x: str) -> Column:
    """Round down to hundredths, with the remainder-based floor division of NumPy.

    ``x`` is a column name or SQL text.
    """
    return F.expr(f"{floor_divide(x, 0.01)} / 100D")


def sentinel_null(column: Column | str, sentinel: float = -1) -> Column:
    return F.nullif(as_column(column), F.lit(sentinel))


def null_indicator(column: Column | str) -> Column:
    return as_column(column).isNull().cast("int")


def fill_const(column: Column | str, value: float) -> Column:
    if isinstance(value, float) and math.isnan(value):
        raise ValueError("fill with a number")
    return F.coalesce(as_column(column), F.lit(value))
