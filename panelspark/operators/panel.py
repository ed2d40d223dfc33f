"""Indexing, joining and reshaping a panel.

A *panel* has one row per (id, period): each customer has at most as many rows as the calendar
has periods. Windows and sequences below rely on that bound; raw statements go through
``statement_index`` or an aggregation to one row per period first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import as_column, quoted
from panelspark.operators.skew import attach_group_values, group_values

LAST_INDEX = 13
SPLIT = "split"


def date_parts(df: DataFrame, ts: str) -> DataFrame:
    """Parse a date string (or pass a timestamp on) and add its month and year."""
    source = F.to_timestamp(ts) if dict(df.dtypes)[ts] == "string" else F.col(ts)
    return df.withColumn(ts, source).withColumns({"month": F.month(source), "year": F.year(source)})


def month_number(ts: Column | str) -> Column:
    """Months since year 0. A common offset cancels in the index, so no global minimum is taken."""
    c = as_column(ts)
    return (F.year(c) * 12 + F.month(c)).cast("int")


def statement_index(df: DataFrame, id_col: str, period: Column, index: str = "ind", last: int = LAST_INDEX) -> DataFrame:
    """Index raw statements back from each customer's last period, which gets ``last``.

    A customer may own any share of the rows: the last period comes from a partial aggregation
    and is joined back with hot customers broadcast.
    """
    rows = df.withColumn("__period", period)
    latest = group_values(rows, [id_col], "__rows", __latest=F.max("__period"))
    joined = attach_group_values(rows, latest, [id_col], "__rows")
    return joined.withColumn(index, _index_from(F.col("__latest"), last)).drop("__period", "__latest", "__rows")


def panel_index(panel: DataFrame, id_col: str, period: str, index: str = "ind", last: int = LAST_INDEX) -> DataFrame:
    """``statement_index`` for a frame unique on (id, period): one shuffle by id, reusable downstream."""
    latest = F.max(period).over(Window.partitionBy(id_col))
    return panel.withColumn("__period", F.col(period)).withColumn(index, _index_from(latest, last)).drop("__period")


def _index_from(latest: Column, last: int) -> Column:
    return (F.lit(last) - (latest - F.col("__period"))).cast("int")


def union_split(parts: Mapping[str, DataFrame], split: str = SPLIT) -> DataFrame:
    """Stack frames by column name and mark each row with the part it came from."""
    tagged = [df.withColumn(split, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def take_split(df: DataFrame, name: str, split: str = SPLIT) -> DataFrame:
    return df.filter(F.col(split) == name).drop(split)


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct()


def _slots(panel: DataFrame, index: str, periods: Sequence[int] | None) -> Column:
    """The given periods, or the distinct ones that the panel has, as one array; a period far off costs one slot."""
    if periods is not None:
        return F.array(*[F.lit(int(p)).cast(dict(panel.dtypes)[index]) for p in periods])
    return panel.agg(F.array_sort(F.collect_set(index))).scalar()


def period_grid(panel: DataFrame, id_col: str, index: str = "ind", periods: Sequence[int] | None = None) -> DataFrame:
    """Every customer with every period: the given ones, or all that the panel has."""
    return distinct_keys(panel, id_col).select(id_col, F.explode(_slots(panel, index, periods)).alias(index))


def densify(
    panel: DataFrame,
    id_col: str,
    values: Sequence[str],
    index: str = "ind",
    periods: Sequence[int] | None = None,
    fill: float | int = 0,
    present: str | None = None,
) -> DataFrame:
    """Complete (id, period) grid with the panel's values, gaps and nulls filled.

    One shuffle by id gathers a customer's rows in a map from period to values, which the calendar bounds;
    the slots look their values up there. ``present`` names an optional 0/1 column telling real rows from
    added ones. Rows without a period are in no slot.
    """
    cell = F.struct(F.col(index).alias("k"), F.struct(*values).alias("v"))
    known = F.map_from_entries(F.collect_list(F.when(F.col(index).isNotNull(), cell)))
    rows = panel.groupBy(id_col).agg(known.alias("__rows"))
    dense = rows.select(id_col, F.explode(_slots(panel, index, periods)).alias(index), "__rows")
    found = dense.select(id_col, index, F.col("__rows")[F.col(index)].alias("__cell"))
    columns = [F.coalesce(F.col("__cell")[v], F.lit(fill)).alias(v) for v in values]
    if present:
        columns.append(F.col("__cell").isNotNull().cast("int").alias(present))
    return found.select(id_col, index, *columns)


def attach(df: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of labels or per-customer features, unique on ``keys``."""
    return df.join(values, list(keys), "left")


def restrict_to(df: DataFrame, index_frame: DataFrame, key: str, position: str | None = None) -> DataFrame:
    """Inner join with an id frame; its order is kept as the column ``position``, if it has one."""
    columns = [key] + ([position] if position else [])
    return index_frame.select(*columns).join(df, key, "inner")


def exact_lag_diff(
    panel: DataFrame, id_col: str, values: Sequence[str], index: str = "ind", suffix: str = "_diff"
) -> DataFrame:
    """Change against exactly the previous period; NULL where that period has no row.

    A range frame of one period back looks the row up by value, so gaps are not bridged. One
    window function fetches all values of that row.
    """
    before = Window.partitionBy(id_col).orderBy(index).rangeBetween(-1, -1)
    found = panel.withColumn("__before", F.last(F.struct(*values)).over(before))
    changes = [f"{quoted(v)} - __before.{quoted(v)} AS {quoted(v + suffix)}" for v in values]
    return found.selectExpr(*[quoted(c) for c in panel.columns], *changes)


def unfold(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    extras: Mapping[str, str] | None = None,
    value_type: str = "DOUBLE",
) -> DataFrame:
    """One row (keys, column, value) per column, known by its position.

    ``extras`` adds further fields: name to a suffix of the columns to take them from. A
    generator keeps the partitioning of its input, which ``unpivot`` would lose.
    """
    fields = {"value": "", **(extras or {})}
    cells = ", ".join(
        f"struct({i} AS column, "
        + ", ".join(f"CAST({quoted(c + suffix)} AS {value_type}) AS {name}" for name, suffix in fields.items())
        + ")"
        for i, c in enumerate(columns)
    )
    return df.selectExpr(*[quoted(k) for k in keys], f"inline(array({cells}))")


def assemble_features(frames: Sequence[DataFrame], id_col: str, how: str = "full") -> DataFrame:
    """Put keyed feature frames side by side. ``full`` keeps every customer, ``left`` the first frame's."""
    return reduce(lambda a, b: a.join(b, id_col, how), frames)


def sort_panel(panel: DataFrame, id_col: str, index: str = "ind", total: bool = True) -> DataFrame:
    """Order by (id, period): globally, or within partitions holding whole customers."""
    if total:
        return panel.orderBy(id_col, index)
    return panel.repartition(id_col).sortWithinPartitions(id_col, index)


def sequence_arrays(
    dense: DataFrame, id_col: str, values: Sequence[str], index: str = "ind", name: str = "sequence"
) -> DataFrame:
    """Per customer the period-ordered array of value vectors. The grid bounds its length."""
    step = F.struct(F.col(index), F.array(*[F.col(v).cast("double") for v in values]).alias("v"))
    steps = F.array_sort(F.collect_list(step))
    return dense.groupBy(id_col).agg(F.transform(steps, lambda s: s["v"]).alias(name))


def sequence_pivot(
    panel: DataFrame,
    id_col: str,
    values: Sequence[str],
    index: str = "ind",
    periods: Sequence[int] = range(1, 14),
    fill: float | int | None = None,
) -> DataFrame:
    """One column ``{value}_{period}`` for every value and slot, by conditional aggregation.

    With ``fill`` the panel may be sparse: empty slots get it, and no grid is built.
    """
    cells = []
    for v in values:
        for p in periods:
            cell = F.max(F.when(F.col(index) == p, F.col(v)))
            cells.append((cell if fill is None else F.coalesce(cell, F.lit(fill))).alias(f"{v}_{p}"))
    return panel.groupBy(id_col).agg(*cells)


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns; names that are not there are ignored."""
    return df.drop(*names)


def select_features(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Keys plus the listed features that exist, in list order."""
    existing = set(df.columns)
    return df.select(*keys, *[f for f in features if f in existing])


def portable_names(df: DataFrame) -> DataFrame:
    """Rename columns so that no name holds a minus sign."""
    return df.withColumnsRenamed({c: c.replace("-", "_minus_") for c in df.columns if "-" in c})
