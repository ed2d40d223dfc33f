"""Standardizing, and distances between a customer's own first, last, mean, min and max."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.aggregates import first_valid, last_valid
from panelspark.functions.numeric import nan_to_null, quoted, row_max, row_mean, row_min, safe_ratio
from panelspark.operators.panel import unfold

# Pair name -> minuend and subtrahend. The ratio of the min_max pair is inverted.
PAIRS = {
    "first_last": ("last", "first"),
    "mean_last": ("last", "mean"),
    "min_last": ("last", "min"),
    "max_last": ("last", "max"),
    "min_max": ("min", "max"),
}
KINDS = ("distance", "difference", "ratio")
STATISTICS = ("first", "last", "mean", "min", "max")


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: a struct of mean ``mu`` and population deviation ``sd`` per column.

    A zero deviation counts as 1. Nulls are ignored.
    """
    names = [quoted(c) for c in columns]
    fits = [
        f"struct(avg({c}) AS mu, IF(stddev_pop({c}) = 0, 1D, stddev_pop({c})) AS sd) AS {c}" for c in names
    ]
    return df.agg(*[F.expr(fit) for fit in fits])


def standardize(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale columns with a fitted scaler, read as a one-row scalar subquery."""
    fitted = df.withColumn("__scaler", scaler.select(F.struct(*columns)).scalar())
    chosen = set(columns)
    scaled = "({c} - __scaler.{c}.mu) / __scaler.{c}.sd AS {c}"
    return fitted.selectExpr(*[scaled.format(c=quoted(c)) if c in chosen else quoted(c) for c in df.columns])


def _pair(kind: str, pair: str) -> Column:
    a, b = PAIRS[pair]
    if kind == "ratio":
        return safe_ratio(b, a) if pair == "min_max" else safe_ratio(a, b)
    difference = F.col(a) - F.col(b)
    return F.abs(difference) if kind == "distance" else difference


def self_distances(
    panel: DataFrame,
    scaler: DataFrame,
    id_col: str,
    columns: Sequence[str],
    index: str = "ind",
    kinds: Sequence[str] = KINDS,
    clustered: bool = False,
) -> DataFrame:
    """``{mean,max,min}_{pair}_{kind}`` over all columns, 15 features per kind.

    The panel is shuffled once, by customer, unless it is ``clustered`` by a bucketed table; unfolding the columns and both aggregations keep
    that partitioning. Scaling is increasing and affine, so it is applied to the five
    statistics instead of to every row. The scaler has one row per column and is broadcast.
    """
    by_customer = panel.select(id_col, index, *columns)
    by_customer = by_customer if clustered else by_customer.repartition(id_col)
    cells = unfold(by_customer, [id_col, index], columns)
    raw = cells.groupBy(id_col, "column").agg(
        F.expr(first_valid("value", quoted(index))).alias("first"),
        F.expr(last_valid("value", quoted(index))).alias("last"),
        F.avg("value").alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    positions = ", ".join(f"struct({i} AS column, {quoted(c)}.mu, {quoted(c)}.sd)" for i, c in enumerate(columns))
    scales = scaler.selectExpr(f"inline(array({positions}))").toDF("column", "mu", "sd")
    scaled = raw.join(F.broadcast(scales), "column").select(
        id_col, *[((F.col(s) - F.col("mu")) / F.col("sd")).alias(s) for s in STATISTICS]
    )
    pairs = scaled.select(id_col, *[_pair(k, p).alias(f"{p}_{k}") for k in kinds for p in PAIRS])
    reducers = {"mean": lambda c: nan_to_null(F.avg(c)), "max": F.max, "min": F.min}
    return pairs.groupBy(id_col).agg(
        *[fn(f"{p}_{k}").alias(f"{r}_{p}_{k}") for k in kinds for r, fn in reducers.items() for p in PAIRS]
    )


def row_reduce(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, max and min across columns of a row, skipping nulls; for narrow frames."""
    cells = [F.col(c) for c in columns]
    return df.withColumns({"row_mean": row_mean(cells), "row_max": row_max(cells), "row_min": row_min(cells)})
