import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators.distance import fit_scaler, self_distances, standardize
from panelspark.operators.features import Feature, PanelSpec, build_features, feature_catalog, fill_categories
from panelspark.plans.feature_plan import customer_features

SPEC = PanelSpec("id")
NUMERIC, CATEGORICAL = ["x", "y"], ["c"]


@pytest.fixture(scope="module")
def pandas_panel():
    """Gaps, single statements, an all-null measure of a customer, nulls in last rows, zeros."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(40):
        periods = [13] if i < 4 else sorted(rng.choice(np.arange(-2, 14), rng.integers(2, 14), replace=False))
        for p in periods:
            x = None if rng.random() < 0.25 or i == 7 else float(rng.integers(-3, 4)) / 2
            y = None if rng.random() < 0.1 else float(np.round(rng.normal(0, 3), 3))
            c = None if rng.random() < 0.2 else int(rng.integers(0, 4))
            rows.append((i, int(p), x, y, c))
    return pd.DataFrame(rows, columns=["id", "ind", "x", "y", "c"]).astype({"x": float, "y": float, "c": float})


@pytest.fixture(scope="module")
def panel(spark, pandas_panel):
    rows = [
        tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r)
        for r in pandas_panel.sample(frac=1, random_state=1).itertuples(index=False)
    ]
    typed = [(int(i), int(p), x, y, None if c is None else int(c)) for i, p, x, y, c in rows]
    return spark.createDataFrame(typed, "id INT, ind INT, x DOUBLE, y DOUBLE, c INT").repartition(3).cache()


def expected(df: pd.DataFrame, name: Feature) -> pd.Series:
    """One feature with pandas, straight from its definition."""
    df = df.sort_values(["id", "ind"])
    c = name.column
    if name.prefix == "null":
        df = df.assign(**{c: df[c].isna().astype(int)})
    if name.prefix == "diff":
        earlier = df[["id", "ind", c]].assign(ind=df["ind"] + 1).rename(columns={c: "before"})
        df = df.merge(earlier, on=["id", "ind"], how="left")
        df[c] = df[c] - df["before"]
    if name.prefix == "recent":
        df = df[df["ind"] >= 10]
    value = df.groupby("id")[c].agg(name.aggregate)
    if name.reference is None:
        return value
    if name.reference == "lag":
        other = df[df["ind"] < 13].groupby("id")[c].last()
    else:
        other = df.groupby("id")[c].agg(name.reference)
    if name.kind == "difference":
        return value - other
    with np.errstate(all="ignore"):
        return value / (other + 0.0)


def test_full_build_equals_pandas(panel, pandas_panel):
    features = feature_catalog(NUMERIC, CATEGORICAL)
    assert len(features) == 28 * 2 + 9
    got = build_features(panel, SPEC, NUMERIC, CATEGORICAL, to_cents=False).toPandas().set_index("id").sort_index()
    assert list(got.columns) == [f.name for f in features]
    for f in features:
        want = expected(pandas_panel, f).reindex(got.index).astype(float)
        np.testing.assert_allclose(got[f.name].astype(float), want, rtol=1e-9, atol=1e-9, err_msg=f.name)


def test_types_names_and_partitions_do_not_matter(spark, panel):
    whole = build_features(panel, SPEC, NUMERIC, CATEGORICAL).toPandas().set_index("id").sort_index()
    text = panel.withColumn("c", F.col("c").cast("string"))
    other = build_features(text, SPEC, NUMERIC, CATEGORICAL).toPandas().set_index("id").sort_index()
    other = other.astype({"c_last": float, "c_first": float})
    pd.testing.assert_frame_equal(whole, other, rtol=1e-12, check_dtype=False)
    names = ["y_diffmean", "c_nunique", "x_last_lag_ratio", "not_a_feature"]
    some = build_features(panel, SPEC, NUMERIC, CATEGORICAL, names).toPandas().set_index("id").sort_index()
    pd.testing.assert_frame_equal(some, whole[names[:3]], rtol=1e-12)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "32"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        again = build_features(panel, SPEC, NUMERIC, CATEGORICAL).toPandas().set_index("id").sort_index()
        pd.testing.assert_frame_equal(whole, again, rtol=1e-12)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_diff_build_shuffles_once(panel):
    plan = build_features(panel, SPEC, NUMERIC, [])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_null_customers_are_left_out(spark):
    df = spark.createDataFrame([(None, 13, 1.0), (1, 13, 2.0)], "id INT, ind INT, x DOUBLE")
    assert [r["id"] for r in build_features(df, SPEC, ["x"], []).collect()] == [1]


def test_fill_categories(panel):
    built = build_features(panel, SPEC, NUMERIC, CATEGORICAL)
    filled = fill_categories(built, CATEGORICAL)
    assert dict(filled.dtypes)["c_last"] == "int"
    assert filled.filter(F.col("c_last").isNull() | F.col("c_first").isNull()).count() == 0


def test_standardize_ignores_nulls_and_zero_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a DOUBLE, b DOUBLE")
    out = standardize(df, fit_scaler(df, ["a", "b"]), ["a", "b"])
    assert [tuple(r) for r in out.collect()] == [(-1.0, 0.0), (1.0, 0.0), (None, 0.0)]


def test_distances_equal_numpy(panel, pandas_panel):
    columns = ["x", "y", "c"]
    got = self_distances(panel, fit_scaler(panel, columns), "id", columns).toPandas().set_index("id").sort_index()
    df = pandas_panel.sort_values(["id", "ind"])
    df[columns] = (df[columns] - df[columns].mean()) / df[columns].std(ddof=0)
    g = df.groupby("id")[columns]
    first, last, mean, low, high = g.first(), g.last(), g.mean(), g.min(), g.max()
    pairs = {"first_last": (last, first), "mean_last": (last, mean), "min_last": (last, low), "max_last": (last, high), "min_max": (low, high)}
    assert got.shape == (40, 45)
    for pair, (a, b) in pairs.items():
        kinds = {"distance": (a - b).abs(), "difference": a - b, "ratio": b / a if pair == "min_max" else a / b}
        for kind, wide in kinds.items():
            for reducer in ("mean", "max", "min"):
                name = f"{reducer}_{pair}_{kind}"
                want = getattr(wide, reducer)(axis=1)
                np.testing.assert_allclose(got[name], want, rtol=1e-7, atol=1e-9, err_msg=name)


def test_distances_shuffle_once(panel):
    scaler = fit_scaler(panel, ["x", "y"])
    plan = self_distances(panel, scaler, "id", ["x", "y"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_customer_features_follow_a_selection(spark, panel):
    scaler = fit_scaler(panel, NUMERIC)
    stacked = spark.createDataFrame([(3, 0.5)], "id INT, missing_value_feature DOUBLE")
    customers = spark.createDataFrame([(3,), (4,), (999,)], "id INT")
    names = ["missing_value_feature", "max_min_max_distance", "x_last", "c_last"]
    out = customer_features(panel, SPEC, NUMERIC, CATEGORICAL, scaler, [stacked], customers, names)
    assert out.columns == ["id", *names]
    assert sorted(r["id"] for r in out.collect()) == [3, 4]
    full = customer_features(panel, SPEC, NUMERIC, CATEGORICAL, scaler, [stacked])
    assert len(full.columns) == 1 + (28 * 2 + 9) + 45 + 1 and full.count() == 40
