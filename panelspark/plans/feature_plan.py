"""The customer feature table: aggregates, stacked features and distances, keyed by customer."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from panelspark.operators.distance import self_distances
from panelspark.operators.features import PanelSpec, build_features, fill_categories


def customer_features(
    panel: DataFrame,
    spec: PanelSpec,
    numeric: Sequence[str],
    categorical: Sequence[str],
    scaler: DataFrame,
    stacked: Sequence[DataFrame] = (),
    customers: DataFrame | None = None,
    names: Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """Features of the panel's customers, or of ``customers`` (an id frame) only.

    ``scaler`` is fitted on train and used for both splits. ``stacked`` frames are keyed by
    customer. ``names`` restricts and orders the outcome, and what it leaves out of the
    aggregates is not computed; it is how a test table follows a selection made on train.
    """
    base = build_features(panel, spec, numeric, categorical, names, **options)
    base = fill_categories(base, categorical)
    distances = self_distances(panel, scaler, spec.id_col, numeric, spec.index)
    extras = [distances, *stacked]
    if names is not None:
        wanted = set(names)
        extras = [e.select(spec.id_col, *[c for c in e.columns if c in wanted]) for e in extras]
        extras = [e for e in extras if len(e.columns) > 1]
    table = reduce(lambda a, b: a.join(b, spec.id_col, "left"), [base, *extras])
    if customers is not None:
        table = customers.select(spec.id_col).join(table, spec.id_col, "inner")
    if names is not None:
        table = table.select(spec.id_col, *[n for n in names if n in set(table.columns)])
    return table
