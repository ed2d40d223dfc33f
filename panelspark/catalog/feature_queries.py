"""Aggregates, contrasts, the full feature build, scaling and distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from panelspark.catalog.cleaning_queries import cent_sql
from panelspark.catalog.fixtures import (
    ORDERS_PANEL,
    SUPPLIER_MEASURES,
    SUPPLIER_PANEL,
    USER_DAY_PANEL,
    orders_panel,
    rounded,
    rounded_sql,
    supplier_panel,
    table,
    user_day_panel,
)
from panelspark.catalog.registry import Registry
from panelspark.functions.aggregates import last_valid_before
from panelspark.operators import distance as D
from panelspark.operators.features import Feature, PanelSpec, aggregate_features, build_features, feature_catalog
from panelspark.plans.feature_plan import customer_features

R = Registry()
SPEC = PanelSpec("id")
NUMERIC = ["amt", "n", "pend"]
CATEGORICAL = ["prio"]
#: Decimals that both engines agree on: means of cents are equal to six unless 32 rows or more make a tie. Deviations
#: and ratios are equal to six significant digits (written as negative).
DIGITS = 6
SIGNIFICANT = -6


def _sql_aggregate(f: Feature) -> str:
    """DuckDB text of a feature that is not a contrast; ``panel`` carries ``{column}_diff``."""
    column = f.column
    if f.prefix == "recent":
        column = f"CASE WHEN ind >= 10 THEN {column} END"
    elif f.prefix == "null":
        column = f"CAST({column} IS NULL AS INT)"
    elif f.prefix == "diff":
        column = f"{column}_diff"
    return {
        "last": f"arg_max({column}, ind)",
        "first": f"arg_min({column}, ind)",
        "mean": f"avg({column})",
        "min": f"min({column})",
        "max": f"max({column})",
        "std": f"stddev_samp({column})",
        "sum": f"CAST(sum({column}) AS BIGINT)",
        "count": f"count({column})",
        "nunique": f"count(DISTINCT {column})",
    }[f.aggregate]


def _sql_reference(column: str, reference: str) -> str:
    if reference == "lag":
        return f"arg_max(CASE WHEN ind < 13 THEN {column} END, ind)"
    return _sql_aggregate(Feature(column, reference))


def _sql_ratio(n: str, d: str) -> str:
    return (
        f"CASE WHEN {d} <> 0 THEN {n} / {d} WHEN {d} = 0 AND {n} > 0 THEN 'inf'::DOUBLE "
        f"WHEN {d} = 0 AND {n} < 0 THEN '-inf'::DOUBLE END"
    )


def _sql_feature(f: Feature) -> str:
    if f.reference is None:
        return _sql_aggregate(f)
    n, d = _sql_aggregate(Feature(f.column, "last")), _sql_reference(f.column, f.reference)
    return _sql_ratio(n, d) if f.kind == "ratio" else f"{n} - {d}"


def _digits(f: Feature) -> int:
    return SIGNIFICANT if f.aggregate == "std" or f.kind == "ratio" else DIGITS


def _is_whole(f: Feature, categorical: Sequence[str]) -> bool:
    return f.prefix == "null" or f.column in categorical


def _sql_build(features: Sequence[Feature], panel: str, categorical: Sequence[str], cents: Sequence[str] = ()) -> str:
    outputs = ", ".join(
        f"{_sql_feature(f) if _is_whole(f, categorical) else rounded_sql(_sql_feature(f), _digits(f))} AS {f.name}"
        for f in features
    )
    clean = f"clean AS (SELECT * REPLACE ({', '.join(f'{cent_sql(c)} AS {c}' for c in cents)}) FROM panel)" if cents else ""
    source = "clean" if cents else "panel"
    diffed = list(dict.fromkeys(f.column for f in features if f.prefix == "diff"))
    if diffed:
        columns = ", ".join(f"a.{c} - b.{c} AS {c}_diff" for c in diffed)
        diffs = (
            f"diffs AS (SELECT a.*, {columns} FROM {source} a "
            f"LEFT JOIN {source} b ON a.id = b.id AND b.ind = a.ind - 1)"
        )
        clean, source = ", ".join(x for x in (clean, diffs) if x), "diffs"
    return f"WITH {', '.join(x for x in (panel, clean) if x)} SELECT id, {outputs} FROM {source} GROUP BY id"


def _rounded_features(df, features: Sequence[Feature], categorical: Sequence[str] = CATEGORICAL):
    return df.select(
        "id", *[F.col(f.name) if _is_whole(f, categorical) else rounded(f.name, _digits(f)).alias(f.name) for f in features]
    )


def _register(name: str, features: Sequence[Feature], panel=orders_panel, panel_sql: str = ORDERS_PANEL) -> None:
    def query(spark, sf_dir):
        return _rounded_features(aggregate_features(panel(spark, sf_dir), SPEC, features), features)

    query.__name__ = name
    R.query(_sql_build(features, panel_sql, CATEGORICAL))(query)


def _family(*aggregates: str, columns: Sequence[str] = NUMERIC, prefix: str = "") -> list[Feature]:
    return [Feature(c, a, prefix) for a in aggregates for c in columns]


_register("agg_last", _family("last", columns=[*NUMERIC, *CATEGORICAL]))
_register("agg_first", _family("first", columns=[*NUMERIC, *CATEGORICAL]))
_register("agg_mean", _family("mean"))
_register("agg_min_max", _family("min", "max"))
_register("agg_std", _family("std"))
_register("agg_count", _family("count", columns=CATEGORICAL))
_register("agg_nunique", _family("nunique", columns=CATEGORICAL))
_register("agg_recent", _family("mean", "min", "max", "std", prefix="recent"))
_register("agg_null_pattern", _family("last", "sum", "min", "max", "first", columns=[*NUMERIC, *CATEGORICAL], prefix="null"))
_register("agg_diff", _family("min", "max", "mean", prefix="diff"))
_register("diff_features", [f for f in feature_catalog(NUMERIC, ()) if f.kind == "difference"])

_WITH_ZEROS = ["val", "zeroed"]
_RATIOS = [f for f in feature_catalog(_WITH_ZEROS, ()) if f.kind == "ratio"]
# A measure that is often 0, so that x/0 and 0/0 happen.
_ZEROED = f"{USER_DAY_PANEL.replace('panel AS', 'whole AS')}, panel AS (SELECT *, coalesce(buy, 0) - val AS zeroed FROM whole)"


@R.query(_sql_build(_RATIOS, _ZEROED, ()))
def ratio_features(spark, sf_dir):
    panel = user_day_panel(spark, sf_dir).withColumn("zeroed", F.coalesce("buy", F.lit(0.0)) - F.col("val"))
    return _rounded_features(aggregate_features(panel, SPEC, _RATIOS), _RATIOS, ())


_LAGS = ", ".join(f"{rounded_sql(_sql_reference(c, 'lag'), DIGITS)} AS {c}_lag" for c in NUMERIC)


@R.query(f"WITH {ORDERS_PANEL} SELECT id, {_LAGS} FROM panel GROUP BY id")
def agg_lag_last(spark, sf_dir):
    lags = [rounded(F.expr(last_valid_before(c, "ind", 13)), DIGITS).alias(f"{c}_lag") for c in NUMERIC]
    return orders_panel(spark, sf_dir).groupBy("id").agg(*lags)


_ALL = feature_catalog(NUMERIC, CATEGORICAL)


@R.query(_sql_build(_ALL, ORDERS_PANEL, CATEGORICAL, NUMERIC))
def feature_build(spark, sf_dir):
    return _rounded_features(build_features(orders_panel(spark, sf_dir), SPEC, NUMERIC, CATEGORICAL), _ALL)


# --- Scaling and distances --------------------------------------------------------------------

_TRAIN = "id % 5 <> 0"
_FITS = ", ".join(
    f"avg({c}) AS mu_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS sd_{c}" for c in SUPPLIER_MEASURES
)
_SCALER = f"scaler AS (SELECT {_FITS} FROM panel WHERE {_TRAIN})"
_SCALED = ", ".join(f"({c} - mu_{c}) / sd_{c} AS {c}" for c in SUPPLIER_MEASURES)


def _scaler(panel):
    return D.fit_scaler(panel.filter(F.col("id") % 5 != 0), SUPPLIER_MEASURES)


@R.query(
    f"WITH {SUPPLIER_PANEL}, {_SCALER}, scaled AS (SELECT id, ind, {_SCALED} FROM panel, scaler) "
    f"SELECT id, ind, {', '.join(f'{rounded_sql(c)} AS {c}' for c in SUPPLIER_MEASURES)} FROM scaled"
)
def standardize(spark, sf_dir):
    panel = supplier_panel(spark, sf_dir)
    scaled = D.standardize(panel, _scaler(panel), SUPPLIER_MEASURES)
    return scaled.select("id", "ind", *[rounded(c).alias(c) for c in SUPPLIER_MEASURES])


_STATS = {"first": "arg_min({c}, ind)", "last": "arg_max({c}, ind)", "mean": "avg({c})", "min": "min({c})", "max": "max({c})"}


def _distance_digits(name: str) -> int:
    """Ratios of scaled values may be of any size."""
    return SIGNIFICANT if name.endswith("ratio") else DIGITS


def _distance_sql(kind: str) -> str:
    """Wide statistics of each column, then one row per column, then reduced by customer."""
    stats = " UNION ALL ".join(
        "SELECT id, "
        + ", ".join(f"({e.format(c=c)} - any_value(mu_{c})) / any_value(sd_{c}) AS {s}_v" for s, e in _STATS.items())
        + " FROM panel, scaler GROUP BY id"
        for c in SUPPLIER_MEASURES
    )

    def pair(name: str) -> str:
        a, b = (f"{x}_v" for x in D.PAIRS[name])
        if kind == "ratio":
            return _sql_ratio(b, a) if name == "min_max" else _sql_ratio(a, b)
        return f"abs({a} - {b})" if kind == "distance" else f"{a} - {b}"

    pairs = ", ".join(f"{pair(p)} AS {p}" for p in D.PAIRS)
    reduced = ", ".join(
        f"{rounded_sql(f'{fn}({p})', _distance_digits(kind))} AS {r}_{p}_{kind}" for r, fn in (("mean", "avg"), ("max", "max"), ("min", "min")) for p in D.PAIRS
    )
    return (
        f"WITH {SUPPLIER_PANEL}, {_SCALER}, stats AS ({stats}), pairs AS (SELECT id, {pairs} FROM stats) "
        f"SELECT id, {reduced} FROM pairs GROUP BY id"
    )


def _distance(kind: str):
    def query(spark, sf_dir):
        panel = supplier_panel(spark, sf_dir)
        out = D.self_distances(panel, _scaler(panel), "id", SUPPLIER_MEASURES, kinds=[kind])
        return out.select("id", *[rounded(c, _distance_digits(kind)).alias(c) for c in out.columns if c != "id"])

    query.__name__ = f"self_{kind}"
    return query


for _kind in D.KINDS:
    R.query(_distance_sql(_kind))(_distance(_kind))


# --- The whole feature table -------------------------------------------------------------------

_MEASURES = feature_catalog(SUPPLIER_MEASURES, ())
_DISTANCES = [f"{r}_{p}_{k}" for k in D.KINDS for r in ("mean", "max", "min") for p in D.PAIRS]
_TABLE = " JOIN ".join([f"({_sql_build(_MEASURES, SUPPLIER_PANEL, (), SUPPLIER_MEASURES)}) f", *[f"({_distance_sql(k)}) {k}s USING (id)" for k in D.KINDS]])
#: A selection, as it comes out of training: some features of each kind, in its own order.
_SELECTED = [_DISTANCES[0], "qty_last", "price_mean", _DISTANCES[-1], "disc_std", "price_recentmean"]


def _whole_table(spark, sf_dir, names=None, customers=None):
    panel = supplier_panel(spark, sf_dir)
    return customer_features(panel, SPEC, list(SUPPLIER_MEASURES), [], _scaler(panel), names=names, customers=customers)


@R.query(f"SELECT id, {', '.join([f.name for f in _MEASURES] + _DISTANCES)} FROM {_TABLE}")
def feature_table(spark, sf_dir):
    """Aggregates and distances of every customer."""
    features = _whole_table(spark, sf_dir)
    whole = [F.col(f.name) if _is_whole(f, ()) else rounded(f.name, _digits(f)).alias(f.name) for f in _MEASURES]
    return features.select("id", *whole, *[rounded(d, _distance_digits(d)).alias(d) for d in _DISTANCES])


@R.query(f"SELECT id, {', '.join(_SELECTED)} FROM {_TABLE} WHERE id % 5 = 0")
def feature_table_selected(spark, sf_dir):
    """The test split's table, following a selection made on train."""
    test = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).filter("id % 5 = 0")
    chosen = _whole_table(spark, sf_dir, _SELECTED, test)
    digits = {f.name: _digits(f) for f in _MEASURES}
    return chosen.select("id", *[rounded(name, digits.get(name, _distance_digits(name))).alias(name) for name in _SELECTED])


@R.query(
    f"""WITH {SUPPLIER_PANEL} SELECT id, ind,
      {rounded_sql("list_avg([qty, price, disc, ret_qty])")} AS row_mean,
      greatest(qty, price, disc, ret_qty) AS row_max, least(qty, price, disc, ret_qty) AS row_min FROM panel"""
)
def row_reduce(spark, sf_dir):
    out = D.row_reduce(supplier_panel(spark, sf_dir), SUPPLIER_MEASURES)
    return out.select("id", "ind", rounded("row_mean").alias("row_mean"), "row_max", "row_min")
