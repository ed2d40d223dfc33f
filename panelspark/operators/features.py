"""Per-customer aggregate features over a panel, named ``{column}_{prefix}{aggregate}``.

All families come out of one aggregation. Contrasts, i.e. differences and ratios against the
last value, are projections over it, named ``{column}_last_{reference}_{type}``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.aggregates import first_valid, from_order, last_valid, last_valid_before
from panelspark.functions.cleaning import floor_to_cent
from panelspark.functions.numeric import quoted, ratio
from panelspark.operators.panel import LAST_INDEX, exact_lag_diff, unfold
from panelspark.operators.skew import present

RECENT_FROM = 10
NUMERIC_TYPES = {"tinyint", "smallint", "int", "bigint", "float", "double"}

# Aggregates of a column that need no order.
PLAIN_AGGREGATES = {
    "mean": "avg({c})",
    "min": "min({c})",
    "max": "max({c})",
    "std": "stddev_samp({c})",
    "sum": "sum({c})",
    "count": "count({c})",
    "nunique": "count(DISTINCT {c})",
}

# What the number of rows and of non-null values tell about the null indicator of a column.
NULL_AGGREGATES = {
    "sum": "count(1) - count({c})",
    "min": "CAST(count({c}) = 0 AS INT)",
    "max": "CAST(count({c}) < count(1) AS INT)",
}


@dataclass(frozen=True)
class Feature:
    """One output column. ``reference`` and ``kind`` are set for contrasts only."""

    column: str
    aggregate: str
    prefix: str = ""
    reference: str | None = None
    kind: str | None = None

    @property
    def suffix(self) -> str:
        if self.reference is None:
            return f"{self.prefix}{self.aggregate}"
        return f"{self.aggregate}_{self.reference}_{self.kind}"

    @property
    def name(self) -> str:
        return f"{self.column}_{self.suffix}"


@dataclass(frozen=True)
class PanelSpec:
    """Names of the key and the order column, and the period numbers that frames refer to.

    ``clustered`` panels come from a table that is bucketed by the key (``sources.tables.read_clustered``) and are
    not shuffled again.
    """

    id_col: str
    index: str = "ind"
    recent_from: int = RECENT_FROM
    last: int = LAST_INDEX
    clustered: bool = False

    def by_customer(self, rows: DataFrame) -> DataFrame:
        return rows if self.clustered else rows.repartition(self.id_col)


def feature_catalog(numeric: Sequence[str], categorical: Sequence[str]) -> list[Feature]:
    """Every feature of the full build: 28 per numeric column and 9 per categorical one."""
    everything = [*numeric, *categorical]
    families: list[tuple[str, Iterable[str], Sequence[str]]] = [
        ("", ("last", "first"), everything),
        ("", ("mean", "min", "max", "std"), numeric),
        ("", ("count", "nunique"), categorical),
        ("recent", ("mean", "min", "max", "std"), numeric),
        ("null", ("last", "sum", "min", "max", "first"), everything),
        ("diff", ("min", "max", "mean"), numeric),
    ]
    features = [Feature(c, agg, prefix) for prefix, aggs, columns in families for agg in aggs for c in columns]
    for kind in ("difference", "ratio"):
        for reference in ("first", "lag", "mean", "max", "min"):
            features += [Feature(c, "last", "", reference, kind) for c in numeric]
    return features


def _aggregate(feature: Feature, spec: PanelSpec) -> str:
    column, order = quoted(feature.column), quoted(spec.index)
    if feature.prefix == "null":
        if feature.aggregate in NULL_AGGREGATES:
            return NULL_AGGREGATES[feature.aggregate].format(c=column)
        column = f"CAST({column} IS NULL AS INT)"
    elif feature.prefix == "recent":
        column = from_order(column, order, spec.recent_from)
    elif feature.prefix == "diff":
        column = quoted(f"{feature.column}_diff")
    if feature.aggregate == "last":
        return last_valid(column, order)
    if feature.aggregate == "first":
        return first_valid(column, order)
    return PLAIN_AGGREGATES[feature.aggregate].format(c=column)


def _reference(feature: Feature, spec: PanelSpec) -> str:
    if feature.reference == "lag":
        return last_valid_before(quoted(feature.column), quoted(spec.index), spec.last)
    return _aggregate(Feature(feature.column, feature.reference), spec)


def contrast(numerator: str, reference: str, kind: str, on_zero: str = "ieee") -> str:
    """SQL text of the difference or ratio of two aggregates; NULL if either is missing."""
    if kind == "ratio":
        return ratio(numerator, reference, on_zero)
    if kind != "difference":
        raise ValueError(f"kind must be 'difference' or 'ratio', not {kind!r}")
    return f"{numerator} - {reference}"


def _grouped(rows: DataFrame, keys: Sequence[str], spec: PanelSpec, features: Sequence[Feature], on_zero: str) -> DataFrame:
    """Keys and features of grouped rows; diff features read ``{column}_diff``."""
    aggregates: dict[str, str] = {}
    outputs: list[str] = []
    for f in features:
        if f.reference is None:
            aggregates[f.name] = _aggregate(f, spec)
            outputs.append(quoted(f.name))
        else:
            last, reference = f"{f.column}_last", f"__{f.column}_{f.reference}"
            aggregates.setdefault(last, _aggregate(Feature(f.column, "last"), spec))
            aggregates[reference] = _reference(f, spec)
            outputs.append(f"{contrast(quoted(last), quoted(reference), f.kind, on_zero)} AS {quoted(f.name)}")
    aggregated = rows.groupBy(*keys).agg(*[F.expr(f"{sql} AS {quoted(name)}") for name, sql in aggregates.items()])
    return aggregated.selectExpr(*[quoted(k) for k in keys], *outputs)


def aggregate_features(
    panel: DataFrame, spec: PanelSpec, features: Sequence[Feature], on_zero: str = "ieee"
) -> DataFrame:
    """A handful of features in one aggregation by customer, for columns of any type.

    With diff features the panel is shuffled once by customer, for the window and the
    aggregation alike; without them partial aggregation runs before the shuffle.
    """
    rows = present(panel, [spec.id_col])
    diffed = list(dict.fromkeys(f.column for f in features if f.prefix == "diff"))
    if diffed:
        rows = exact_lag_diff(rows, spec.id_col, diffed, spec.index)
    return _grouped(rows, [spec.id_col], spec, features, on_zero)


def _read(folded: str, position: int, field: str) -> str:
    """A field of a folded column. ``element_at`` rather than an index, which the optimizer would
    try to push down, comparing every such read with every other."""
    return f"element_at({folded}, {position + 1}).{quoted(field)}"


def _unfolded_features(
    panel: DataFrame, spec: PanelSpec, features: Sequence[Feature], on_zero: str
) -> tuple[DataFrame, dict[str, str]]:
    """Many features of number columns, by way of one row per customer and column.

    Spelling out every column would mean thousands of aggregates, whose generated code takes
    longer to compile than to run. Instead the panel is shuffled once by customer, its columns
    are unfolded into rows, all families are computed by (customer, column), and the rows of a
    customer, one per column, are folded into an array. None of this moves data again.

    Returns (id, array) and, by feature name, the SQL text that reads the feature out of it.
    """
    columns = list(dict.fromkeys(f.column for f in features))
    diffed = list(dict.fromkeys(f.column for f in features if f.prefix == "diff"))
    rows = spec.by_customer(present(panel, [spec.id_col]).select(spec.id_col, spec.index, *columns))
    if diffed:
        rows = exact_lag_diff(rows, spec.id_col, diffed, spec.index)
        rows = rows.withColumns({f"{c}_diff": F.lit(None).cast("double") for c in columns if c not in set(diffed)})
    cells = unfold(rows, [spec.id_col, spec.index], columns, {"value_diff": "_diff"} if diffed else None)

    families = {f.suffix: replace(f, column="value") for f in features}
    by_column = _grouped(cells, [spec.id_col, "column"], spec, list(families.values()), on_zero)
    fields = [F.col(f.name).alias(suffix) for suffix, f in families.items()]
    folded = by_column.groupBy(spec.id_col).agg(
        F.array_sort(F.collect_list(F.struct("column", *fields))).alias("__columns")
    )
    position = {c: i for i, c in enumerate(columns)}
    types = dict(panel.dtypes)
    reads = {}
    for f in features:
        value = _read("__columns", position[f.column], f.suffix)
        if f.suffix in ("last", "first", "min", "max"):
            value = f"CAST({value} AS {types[f.column]})"
        reads[f.name] = value
    return folded, reads


def _distinct_counts(panel: DataFrame, spec: PanelSpec, columns: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """Distinct values per customer and column, folded like the other features.

    Distinct aggregates over several columns would multiply the rows once per column and
    shuffle twice; here the rows are shuffled once, by customer, and unfolded after that.
    """
    rows = spec.by_customer(present(panel, [spec.id_col]).select(spec.id_col, *columns))
    values = unfold(rows, [spec.id_col], columns, value_type="STRING").select(spec.id_col, "column", "value").distinct()
    counts = values.groupBy(spec.id_col, "column").agg(F.count("value").alias("n"))
    folded = counts.groupBy(spec.id_col).agg(F.array_sort(F.collect_list(F.struct("column", "n"))).alias("__distinct"))
    return folded, {Feature(c, "nunique").name: _read("__distinct", i, "n") for i, c in enumerate(columns)}


def build_features(
    panel: DataFrame,
    spec: PanelSpec,
    numeric: Sequence[str],
    categorical: Sequence[str],
    names: Sequence[str] | None = None,
    to_cents: bool = True,
    on_zero: str = "ieee",
) -> DataFrame:
    """The full feature table keyed by customer, or only ``names`` of it, in their order.

    Number columns go through one row per column, columns of other types through plain
    aggregates, and distinct counts through an aggregation of their own. The frames come out
    partitioned by customer alike, so joining them moves no data; the output columns are
    spelled out after the join, which keeps the optimizer's view of it narrow.
    """
    features = feature_catalog(numeric, categorical)
    if names is not None:
        wanted = set(names)
        features = [f for f in features if f.name in wanted]
    if to_cents:
        panel = panel.withColumns({c: floor_to_cent(quoted(c)) for c in numeric})
    types = dict(panel.dtypes)
    distinct = [f.column for f in features if f.aggregate == "nunique"]
    numbers = [f for f in features if f.aggregate != "nunique" and types[f.column] in NUMERIC_TYPES]
    others = [f for f in features if f.aggregate != "nunique" and types[f.column] not in NUMERIC_TYPES]
    frames, reads = [], {}
    if numbers:
        folded, reads = _unfolded_features(panel, spec, numbers, on_zero)
        frames.append(folded)
    if distinct:
        folded, counts = _distinct_counts(panel, spec, distinct)
        frames.append(folded)
        reads.update(counts)
    if others:
        frames.append(aggregate_features(panel, spec, others, on_zero))
        reads.update({f.name: quoted(f.name) for f in others})
    if not frames:
        return present(panel, [spec.id_col]).select(spec.id_col).distinct()
    joined = reduce(lambda a, b: a.join(b, spec.id_col, "inner"), frames)
    ordered = names if names is not None else [f.name for f in features]
    return joined.selectExpr(quoted(spec.id_col), *[f"{reads[n]} AS {quoted(n)}" for n in ordered if n in reads])


def fill_categories(features: DataFrame, categorical: Sequence[str], fill: int = -1) -> DataFrame:
    """``last`` and ``first`` of the categorical columns, missing ones as ``fill``: codes as integers, texts as texts."""
    names = [f"{c}_{agg}" for agg in ("last", "first") for c in categorical]
    present_names = [n for n in names if n in features.columns]
    types = dict(features.dtypes)
    return features.withColumns(
        {
            n: F.coalesce(F.col(n), F.lit(str(fill))) if types[n] == "string" else F.coalesce(F.col(n), F.lit(fill)).cast("int")
            for n in present_names
        }
    )
