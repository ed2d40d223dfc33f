"""Attaching one row per group back to the rows of the group, safely under skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 1 << 20


def attach_group_values(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    size: str,
    heavy_groups: int | None = None,
) -> DataFrame:
    """Left join ``groups`` (unique on ``keys``) to ``rows`` without a hot task.

    ``size`` names the column of ``groups`` holding the number of rows of each group. The
    ``heavy_groups`` largest groups are broadcast, as many as there are shuffle partitions unless
    given; any other group has less rows than the mean partition, so the shuffle join of the rest
    is balanced. Rows already served by the broadcast get a random-like salt that matches nothing
    and spreads them over the partitions. Rows with a null key get nulls and are spread too.
    """
    heavy_groups = heavy_groups or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = list(keys)
    values = [c for c in groups.columns if c not in keys]
    # Both branches read the size, so they need the same shuffle, which is computed once.
    sized = groups.filter(F.col(size) > 0)
    heavy = (
        sized.orderBy(F.desc(size), *keys)
        .limit(heavy_groups)
        .select(*keys, F.struct(*values).alias("__heavy"))
    )
    # Always 0, but not a literal: the optimizer would take a literal out of the join keys.
    no_salt = (F.col(size) < 0).cast("int").alias("__salt")
    light = sized.select(*keys, F.struct(*values).alias("__light"), no_salt)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(SALTS)).cast("int") + 1
    missing_key = F.lit(False)
    for k in keys:
        missing_key = missing_key | F.col(k).isNull()
    salted = rows.join(F.broadcast(heavy), keys, "left").withColumn(
        "__salt", F.when(F.col("__heavy").isNotNull() | missing_key, spread).otherwise(F.lit(0))
    )
    joined = salted.join(light, [*keys, "__salt"], "left")
    return joined.select(
        *rows.columns,
        *[F.coalesce(F.col("__heavy")[v], F.col("__light")[v]).alias(v) for v in values],
    )


def present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null in the columns, as plain conditions that reach the scan and joins recognize."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
    return df


def group_values(rows: DataFrame, keys: Sequence[str], size: str, **values: Column) -> DataFrame:
    """One row per group with non-null keys and its row count; partial aggregation absorbs hot groups."""
    return present(rows, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias(size), *[value.alias(name) for name, value in values.items()]
    )


def join_totals(rows: DataFrame, totals: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Inner join of per-group totals, unique on ``keys`` and holding every group of ``rows``.

    Groups such as folds or models may each have a large share of the rows, so the join is the one
    that is safe under skew; the plan does not depend on how many there are.
    """
    return attach_group_values(present(rows, keys), totals, keys, size)
