"""Categories as numbers that trees can split: smoothed label means, of any number of categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.numeric import quoted
from panelspark.operators.folds import SEED, id_hash
from panelspark.operators.ranking import running_total
from panelspark.operators.skew import attach_group_values

#: How many rows of the mean label each category starts with.
PRIOR_WEIGHT = 1.0


def _unfolded(df: DataFrame, keep: Sequence[Column], categories: Sequence[str]) -> DataFrame:
    """The ``keep`` columns, and one row per category column: at (its number) and value."""
    cells = [F.struct(F.lit(i).alias("at"), F.col(quoted(c)).cast("string").alias("value")) for i, c in enumerate(categories)]
    return df.select(*keep, F.explode(F.array(*cells)).alias("cell")).select("*", "cell.at", "cell.value").drop("cell")


def _folded(rows: DataFrame, id_col: str, categories: Sequence[str], suffix: str) -> DataFrame:
    """One row per id with a column per category column."""
    columns = [F.max(F.when(F.col("at") == i, F.col("mean"))).alias(f"{c}{suffix}") for i, c in enumerate(categories)]
    return rows.groupBy("id").agg(*columns).withColumnRenamed("id", id_col)


def _smoothed(positives: Column, n: Column, prior: Column, weight: float) -> Column:
    return (positives + prior * weight) / (n + weight)


def ordered_target_statistics(
    df: DataFrame,
    id_col: str,
    label: str,
    categories: Sequence[str],
    prior_weight: float = PRIOR_WEIGHT,
    seed: int = SEED,
    suffix: str = "_ts",
) -> DataFrame:
    """(id, one ``{category}_ts`` per category column) of training rows, for categories of any number.

    Rows are put in the order of their hashes. A row's value is the smoothed mean label of the rows of its
    category before it, ``prior_weight`` rows of the mean of all labels added, so no row sees its own label.
    NULL is a category of its own; ids are distinct, labels 0 or 1. All columns are one running sum, partitioned
    by column and category, that splits a hot category over tasks.
    """
    y = F.col(label).cast("long")
    rows = _unfolded(df, [F.col(id_col).alias("id"), y.alias("y"), id_hash(id_col, seed).alias("hash")], categories)
    prior = df.agg(F.avg(y.cast("double"))).scalar()
    sums = running_total(rows, [F.col("hash").asc(), F.col("id").asc()], {"positives": F.col("y"), "n": F.lit(1).cast("long")}, ["at", "value"])
    mean = _smoothed(F.col("positives") - F.col("y"), F.col("n") - 1, prior, prior_weight)
    return _folded(sums.select("id", "at", mean.alias("mean")), id_col, categories, suffix)


def target_statistics(
    df: DataFrame, train: DataFrame, id_col: str, label: str, categories: Sequence[str], prior_weight: float = PRIOR_WEIGHT, suffix: str = "_ts"
) -> DataFrame:
    """(id, one ``{category}_ts`` per category column) of rows to be scored: the smoothed mean of all training rows of their category.

    Categories that the training rows lack get the mean of all labels.
    """
    known = _unfolded(train, [F.col(label).cast("long").alias("y")], categories)
    prior = train.agg(F.avg(F.col(label).cast("double"))).scalar()
    key = F.coalesce(F.concat(F.lit("="), F.col("value")), F.lit("")).alias("key")
    totals = known.groupBy("at", key).agg(F.sum("y").alias("positives"), F.count("*").alias("n"))
    rows = _unfolded(df, [F.col(id_col).alias("id")], categories).select("id", "at", key)
    joined = attach_group_values(rows, totals, ["at", "key"], "n")
    mean = _smoothed(F.coalesce("positives", F.lit(0)), F.coalesce("n", F.lit(0)), prior, prior_weight)
    return _folded(joined.select("id", "at", mean.alias("mean")), id_col, categories, suffix)
