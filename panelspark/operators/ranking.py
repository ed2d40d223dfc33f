"""Global order without a single task: running totals and percent ranks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.skew import attach_group_values, join_totals, present
from panelspark.session import checkpoint_frame

_BUCKET = "__bucket"


def running_total(
    df: DataFrame,
    order_by: Sequence[Column],
    totals: Mapping[str, Column],
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Add running sums in a global order, optionally restarting for each ``partition_by`` value.

    Rows are range-partitioned on (partition_by, order_by), which also splits a hot partition
    or a hot tie as long as ``order_by`` ends with a unique column. The bucket of each row is
    frozen by a checkpoint, because range bounds are sampled and would differ in another
    execution. Buckets are then summed locally and shifted by what lies before them. Only
    groups that continue from an earlier bucket need a shift: at most one per bucket, so the
    broadcast carry table never exceeds the number of shuffle partitions.

    A null in ``partition_by`` is a partition of its own. Select the needed columns first; all
    are checkpointed.
    """
    parts = list(partition_by)
    inputs = {f"__in_{name}": value for name, value in totals.items()}
    ranged = checkpoint_frame(
        df.withColumns(inputs)
        .repartitionByRange(*[F.col(p) for p in parts], *order_by)
        .withColumn(_BUCKET, F.spark_partition_id())
    )

    before = Window.partitionBy(*parts).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    bucket_sums = ranged.groupBy(*parts, _BUCKET).agg(*[F.sum(i).alias(i) for i in inputs])
    carry = (
        bucket_sums.select(
            *parts,
            _BUCKET,
            F.count(F.lit(1)).over(before).alias("__earlier"),
            *[F.sum(f"__in_{name}").over(before).alias(f"__carry_{name}") for name in totals],
        )
        .filter(F.col("__earlier") > 0)
        .drop("__earlier")
        .withColumnsRenamed({c: f"__of_{c}" for c in (*parts, _BUCKET)})
    )

    local = Window.partitionBy(*parts, _BUCKET).orderBy(*order_by)
    local = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumns({name: F.sum(f"__in_{name}").over(local) for name in totals})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in (_BUCKET, *parts)])
    shifted = summed.join(F.broadcast(carry), same, "left")
    return shifted.select(
        *df.columns,
        *[(F.col(n) + F.coalesce(F.col(f"__carry_{n}"), F.lit(0))).alias(n) for n in totals],
    )


def row_position(
    df: DataFrame, order_by: Sequence[Column], name: str = "pos", partition_by: Sequence[str] = ()
) -> DataFrame:
    """1-based position in a global order, counted anew for each ``partition_by`` value."""
    return running_total(df, order_by, {name: F.lit(1).cast("long")}, partition_by)


def tie_groups(
    df: DataFrame, score: str, partition_by: Sequence[str] = (), **sums: Column
) -> DataFrame:
    """Distinct scores with their row count ``ties``, the rows ``before`` them, and extra sums.

    Ties collapse in the partial aggregation, so a score shared by most rows costs nothing.
    """
    counted = (
        present(df, [*partition_by, score])
        .groupBy(*partition_by, score)
        .agg(F.count(F.lit(1)).alias("ties"), *[s.alias(n) for n, s in sums.items()])
    )
    ranked = running_total(counted, [F.col(score).asc()], {"__upto": F.col("ties")}, partition_by)
    return ranked.withColumn("before", F.col("__upto") - F.col("ties")).drop("__upto")


def average_rank() -> Column:
    """Rank shared by tied rows, over the columns of ``tie_groups``."""
    return F.col("before") + (F.col("ties") + F.lit(1)) / F.lit(2.0)


def percent_rank(
    df: DataFrame, score: str, name: str = "rank", partition_by: Sequence[str] = ()
) -> DataFrame:
    """Rank in (0, 1], ties averaged, relative to the rows with a score. NULL scores rank NULL."""
    parts = list(partition_by)
    groups = tie_groups(df, score, parts)
    if parts:
        sizes = groups.groupBy(*parts).agg(F.sum("ties").alias("__n"), F.count(F.lit(1)).alias("__scores"))
        groups = join_totals(groups, sizes, parts, "__scores")
    else:
        groups = groups.withColumn("__n", groups.agg(F.sum("ties").alias("n")).scalar())
    ranks = groups.select(*parts, score, "ties", (average_rank() / F.col("__n")).alias(name))
    return attach_group_values(df, ranks, [*parts, score], "ties").drop("ties")
