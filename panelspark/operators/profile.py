"""Data-driven cleaning: find noisy zeros, ones and binaries in one pass over all columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.cleaning import GRID_WIDTH
from panelspark.functions.numeric import quoted


# Facts about a column, one bit each.
HAS_ZERO, NOISY_ZERO, NEAR_ZERO, HAS_ONE, NOISY_ONE, NEAR_ONE, OTHER = (1 << i for i in range(7))


def _facts(c: str) -> str:
    """What one value says about its column. ``NEAR`` is next to a snap range, on either side."""
    w = GRID_WIDTH
    return f"""CASE WHEN {c} IS NULL THEN 0
        WHEN {c} < {-w}D OR {c} > {1 + 2 * w}D OR ({c} > {2 * w}D AND {c} < {1 - w}D) THEN {OTHER}
        WHEN {c} < 0 THEN {OTHER | NEAR_ZERO}
        WHEN {c} = 0 THEN {HAS_ZERO}
        WHEN {c} <= {w}D THEN {HAS_ZERO | NOISY_ZERO}
        WHEN {c} <= {2 * w}D THEN {OTHER | NEAR_ZERO}
        WHEN {c} < 1 THEN {OTHER | NEAR_ONE}
        WHEN {c} = 1 THEN {HAS_ONE}
        WHEN {c} <= {1 + w}D THEN {HAS_ONE | NOISY_ONE}
        ELSE {OTHER | NEAR_ONE} END"""


def _verdict(c: str) -> str:
    """Decode the facts of a column: where to snap, and whether it is binary afterwards."""

    def has(bits: int) -> str:
        return f"({c} & {bits}) <> 0"

    zero = f"({has(HAS_ZERO)} AND NOT {has(NEAR_ZERO)})"
    one = f"({has(HAS_ONE)} AND NOT {has(NEAR_ONE)})"
    binary = (
        f"{has(HAS_ZERO | HAS_ONE)} AND NOT {has(OTHER)} "
        f"AND ({zero} OR NOT {has(NOISY_ZERO)}) AND ({one} OR NOT {has(NOISY_ONE)})"
    )
    return f"struct({zero} AS zero, {one} AS one, ({binary}) AS binary) AS {c}"


def noise_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with a struct per column: ``zero`` and ``one`` (snap there), ``binary`` (collapse).

    A point is snapped if the range above it is inhabited and its surroundings are empty. A
    column is binary if nothing but 0 and 1 is left afterwards. All columns are profiled in one
    pass, with a single bit-or each.
    """
    facts = df.agg(*[F.expr(f"coalesce(bit_or({_facts(c)}), 0) AS {c}") for c in map(quoted, columns)])
    return facts.selectExpr(*[_verdict(c) for c in map(quoted, columns)])


def _snapped(c: str) -> str:
    verdict, width = f"__profile.{c}", f"{GRID_WIDTH}D"
    return (
        f"CASE WHEN {verdict}.zero AND {c} BETWEEN 0 AND {width} THEN 0D "
        f"WHEN {verdict}.one AND {c} BETWEEN 1 AND {1 + GRID_WIDTH}D THEN 1D ELSE {c} END"
    )


def _collapsed(c: str) -> str:
    return f"CASE WHEN __profile.{c}.binary AND {c} IS NULL THEN -1D ELSE {_snapped(c)} END"


def _rewrite(
    df: DataFrame, columns: Sequence[str], profile: DataFrame | None, rewritten: Callable[[str], str]
) -> DataFrame:
    """Replace columns by expressions over themselves and the profile, a one-row scalar subquery."""
    profile = noise_profile(df, columns) if profile is None else profile
    profiled = df.withColumn("__profile", profile.select(F.struct(*columns)).scalar())
    chosen = set(columns)
    return profiled.selectExpr(
        *[f"{rewritten(quoted(c))} AS {quoted(c)}" if c in chosen else quoted(c) for c in df.columns]
    )


def snap_zero_one(df: DataFrame, columns: Sequence[str], profile: DataFrame | None = None) -> DataFrame:
    """Snap noise just above 0 and 1 where the profile finds the point isolated."""
    return _rewrite(df, columns, profile, _snapped)


def binary_collapse(df: DataFrame, columns: Sequence[str], profile: DataFrame | None = None) -> DataFrame:
    """``snap_zero_one``, then -1 for the missing values of columns holding only 0 and 1.

    Columns stay numeric, so the schema does not depend on the data.
    """
    return _rewrite(df, columns, profile, _collapsed)
