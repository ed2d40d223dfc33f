import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelspark.operators import panel as P
from panelspark.operators.skew import attach_group_values, group_values, join_totals


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_date_parts_of_strings(spark):
    df = P.date_parts(frame(spark, [("2018-03-09",), (None,)], "S_2 STRING"), "S_2")
    assert [(r["month"], r["year"]) for r in df.collect()] == [(3, 2018), (None, None)]


def test_statement_index_counts_months_back(spark):
    days = [("a", "2018-03-09"), ("a", "2018-03-30"), ("a", "2018-01-02"), ("a", "2016-12-31"), ("b", "2017-05-01")]
    df = P.date_parts(frame(spark, days, "id STRING, S_2 STRING"), "S_2")
    got = rows_of(P.statement_index(df, "id", P.month_number("S_2")).select("id", "ind"), "id", "ind")
    assert got == [("a", -2), ("a", 11), ("a", 13), ("a", 13), ("b", 13)]


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_hot_group_joins_are_complete(spark, threshold):
    """A third of the rows belongs to one key, and some keys are null."""
    rows = [(None if i % 31 == 0 else 0 if i % 3 == 0 else i % 700, i) for i in range(6000)]
    df = frame(spark, rows, "k INT, v INT")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        groups = group_values(df, ["k"], "n", top=F.max("v"))
        joined = attach_group_values(df, groups, ["k"], "n", heavy_groups=3)
        got = {r["v"]: (r["top"], r["n"]) for r in joined.collect()}
        totals = join_totals(df, groups, ["k"], "n").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    tops, sizes = {}, {}
    for k, v in rows:
        if k is not None:
            tops[k] = max(tops.get(k, -1), v)
            sizes[k] = sizes.get(k, 0) + 1
    assert got == {v: (tops.get(k), sizes.get(k)) for k, v in rows}
    assert totals == sum(k is not None for k, _ in rows)


def test_hot_group_rows_are_spread_over_the_shuffle(spark):
    """In the shuffle join the rows of the hot key, served by the broadcast, take other partitions too."""
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        groups = group_values(df, ["k"], "n")
        joined = attach_group_values(df, groups, ["k"], "n", heavy_groups=1)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(sizes) == 4 and max(sizes) < 1.2 * 20000 / 4


def test_union_and_split(spark):
    a, b = frame(spark, [(1, "x")], "i INT, s STRING"), frame(spark, [("y", 2)], "s STRING, i INT")
    both = P.union_split({"train": a, "test": b})
    assert rows_of(both, "i") == [(1, "x", "train"), (2, "y", "test")]
    assert rows_of(P.take_split(both, "test"), "i") == [(2, "y")]


PANEL = [("a", 13, 5.0), ("a", 11, 3.0), ("a", 10, None), ("b", 13, 1.0), ("b", 12, 0.5)]


def panel(spark):
    return frame(spark, PANEL, "id STRING, ind INT, x DOUBLE")


def test_lag_diff_does_not_bridge_gaps(spark):
    got = rows_of(P.exact_lag_diff(panel(spark), "id", ["x"]).select("id", "ind", "x_diff"), "id", "ind")
    assert got == [("a", 10, None), ("a", 11, None), ("a", 13, None), ("b", 12, None), ("b", 13, 0.5)]


def test_densify_is_a_complete_grid(spark):
    dense = P.densify(panel(spark), "id", ["x"], fill=0.0, present="here")
    assert rows_of(dense, "id", "ind") == [
        ("a", 10, 0.0, 1), ("a", 11, 3.0, 1), ("a", 12, 0.0, 0), ("a", 13, 5.0, 1),
        ("b", 10, 0.0, 0), ("b", 11, 0.0, 0), ("b", 12, 0.5, 1), ("b", 13, 1.0, 1),
    ]
    assert P.densify(panel(spark), "id", ["x"], periods=range(1, 14)).count() == 2 * 13


def test_period_grid_has_the_observed_periods_only(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 40_000), ("b", 7), ("c", None)], "id STRING, ind INT")
    grid = rows_of(P.period_grid(rows, "id"), "id", "ind")
    assert grid == [(i, p) for i in "abc" for p in (1, 7, 40_000)]
    assert P.period_grid(rows.filter("id = 'z'"), "id").count() == 0


def test_a_period_far_off_costs_one_slot(spark):
    far = spark.createDataFrame([("a", -2_000_000, 1.0), ("a", 13, 2.0), ("b", 2_000_000, None)], "id STRING, ind INT, x DOUBLE")
    slots = [-2_000_000, 13, 2_000_000]
    assert rows_of(P.period_grid(far, "id"), "id", "ind") == [(i, s) for i in "ab" for s in slots]
    dense = P.densify(far, "id", ["x"], present="real")
    assert rows_of(dense, "id", "ind") == [("a", slots[0], 1.0, 1), ("a", 13, 2.0, 1), ("a", slots[2], 0.0, 0), ("b", slots[0], 0.0, 0), ("b", 13, 0.0, 0), ("b", slots[2], 0.0, 1)]


def test_a_hot_customer_does_not_change_the_grid(spark):
    hot = spark.range(5000).selectExpr("'a' AS id", "int(id) AS ind", "1.0 AS x").union(spark.createDataFrame([("b", 7, 1.0)], "id STRING, ind INT, x DOUBLE"))
    assert P.densify(hot, "id", ["x"]).groupBy("id").count().filter("count = 5000").count() == 2


def test_sequence_pivot_of_a_sparse_panel_equals_that_of_the_grid(spark):
    dense = P.densify(panel(spark), "id", ["x"], periods=[12, 13], fill=0.0)
    want = rows_of(P.sequence_pivot(dense, "id", ["x"], periods=[12, 13]), "id")
    assert rows_of(P.sequence_pivot(panel(spark), "id", ["x"], periods=[12, 13], fill=0.0), "id") == want


def test_sequences(spark):
    dense = P.densify(panel(spark), "id", ["x"], periods=[12, 13], fill=0.0)
    assert rows_of(P.sequence_arrays(dense, "id", ["x"]), "id") == [("a", [[0.0], [5.0]]), ("b", [[0.5], [1.0]])]
    pivot = P.sequence_pivot(dense, "id", ["x"], periods=[12, 13])
    assert pivot.columns == ["id", "x_12", "x_13"]
    assert rows_of(pivot, "id") == [("a", 0.0, 5.0), ("b", 0.5, 1.0)]


def test_joins_and_columns(spark):
    labels = frame(spark, [("a", 1), ("c", 0)], "id STRING, target INT")
    assert rows_of(P.attach(panel(spark), labels, ["id"]).select("id", "ind", "target"), "id", "ind")[-1] == ("b", 13, None)
    index = frame(spark, [("b", 0), ("z", 1)], "id STRING, pos INT")
    assert {r["id"] for r in P.restrict_to(panel(spark), index, "id", "pos").collect()} == {"b"}
    full = P.assemble_features([labels, index], "id")
    assert full.count() == 4
    assert rows_of(P.sort_panel(panel(spark), "id"), "id", "ind")[0] == ("a", 10, None)
    inside = P.sort_panel(panel(spark), "id", total=False).collect()
    assert [r["ind"] for r in inside if r["id"] == "a"] == [10, 11, 13]
    renamed = P.portable_names(frame(spark, [(1, 2)], "`a-b` INT, c INT"))
    assert renamed.columns == ["a_minus_b", "c"]
    assert P.drop_columns(renamed, ["c", "c", "no"]).columns == ["a_minus_b"]
    assert P.select_features(renamed, ["c"], ["zz", "a_minus_b"]).columns == ["c", "a_minus_b"]


def test_month_number_of_timestamps(spark):
    df = frame(spark, [(dt.datetime(2001, 2, 3),)], "t TIMESTAMP")
    assert df.select(P.month_number("t")).first()[0] == 2001 * 12 + 2
