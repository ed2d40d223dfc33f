import math

import pytest
from pyspark.sql import functions as F

from panelspark.operators.distance import fit_scaler, self_distances
from panelspark.operators.features import PanelSpec, build_features
from panelspark.operators.panel import densify, exact_lag_diff, sequence_arrays, sequence_pivot
from panelspark.session import checkpoint_frame
from panelspark.sources import tables


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("customer_ID,S_2,B_2\nx,2018-01-02,0.5\ny,2018-02-02,\nz,,NaN\n")
    df = tables.read_csv(spark, str(path), "customer_ID STRING, S_2 STRING, B_2 DOUBLE")
    assert [tuple(r) for r in df.orderBy("customer_ID").collect()] == [
        ("x", "2018-01-02", 0.5), ("y", "2018-02-02", None), ("z", None, None),
    ]
    out = str(tmp_path / "out")
    scores = spark.createDataFrame([("x", 0.25, 1)], "customer_ID STRING, prediction DOUBLE, extra INT")
    tables.write_predictions(scores, out, "customer_ID")
    back = tables.read_csv(spark, out, "customer_ID STRING, prediction DOUBLE")
    assert [tuple(r) for r in back.collect()] == [("x", 0.25)]


def test_panel_round_trip_prunes_splits(spark, tmp_path):
    path = str(tmp_path / "panel")
    df = spark.createDataFrame([(1, math.nan, "train"), (2, 5.0, "test")], "id INT, x DOUBLE, split STRING")
    tables.write_panel(df, path)
    assert {(r["id"], r["x"]) for r in tables.read_panel(spark, path).collect()} == {(1, None), (2, 5.0)}
    test = tables.read_panel(spark, path, "test")
    assert [r["id"] for r in test.collect()] == [2]
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "split" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_feature_list_keeps_its_order(spark, tmp_path):
    names = [f"f{i}" for i in (3, 1, 2)]
    tables.save_feature_list(spark, names, str(tmp_path / "list"))
    assert tables.load_feature_list(spark, str(tmp_path / "list")) == names


def test_checkpoint_cuts_lineage(spark):
    df = checkpoint_frame(spark.range(10).selectExpr("id * 2 AS v"))
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["v"] for r in df.collect()) == list(range(0, 20, 2))


PERIODS = list(range(9, 14))


def _build(panel, clustered):
    return build_features(panel, PanelSpec("id", clustered=clustered), ["x", "z"], ["c"])


def _distances(panel, clustered):
    scaler = panel.sparkSession.createDataFrame([((1.5, 2.0), (0.5, 3.0))], "x struct<mu: double, sd: double>, z struct<mu: double, sd: double>")
    assert fit_scaler(panel, ["x", "z"]).schema["x"].dataType.names == ["mu", "sd"]
    return self_distances(panel, scaler, "id", ["x", "z"], clustered=clustered)


CLUSTERED = {
    "build": _build,
    "lags": lambda panel, _: exact_lag_diff(panel, "id", ["x", "z"]),
    "distances": _distances,
    "densify": lambda panel, _: densify(panel, "id", ["x", "z"], periods=PERIODS),
    "sequences": lambda panel, _: sequence_arrays(densify(panel, "id", ["x", "z"], periods=PERIODS), "id", ["x", "z"]),
    "pivot": lambda panel, _: sequence_pivot(panel, "id", ["x", "z"], periods=PERIODS),
}


@pytest.fixture(scope="module")
def panels(spark, tmp_path_factory):
    """The same panel from plain files and from a clustered table."""
    folder = tmp_path_factory.mktemp("panels")
    ids = spark.range(60).select(F.col("id"), F.explode(F.sequence(F.lit(9), F.lit(13))).alias("ind")).filter("(id * 7 + ind) % 4 <> 0")
    rows = ids.select("id", "ind", F.when(F.col("id") % 5 != 0, F.col("id") * 0.25 + F.col("ind")).alias("x"), (F.col("ind") * 1.5 - F.col("id")).alias("z"), (F.col("id") % 3).cast("int").alias("c"))
    tables.write_panel(rows.withColumn("split", F.lit("train")), str(folder / "plain"))
    tables.write_clustered(rows, "clustered_panel", str(folder / "clustered"), "id", 6)
    yield tables.read_panel(spark, str(folder / "plain")).drop("split"), tables.read_clustered(spark, "clustered_panel")
    spark.sql("DROP TABLE clustered_panel")


def test_a_clustered_table_has_one_sorted_file_per_bucket(spark, panels):
    files = panels[1].inputFiles()
    assert len(files) == 6
    for f in files:
        got = [(r["id"], r["ind"]) for r in spark.read.parquet(f).collect()]
        assert got == sorted(got)


@pytest.mark.parametrize("name", sorted(CLUSTERED))
def test_clustered_panels_are_not_shuffled(panels, name):
    plain, clustered = (CLUSTERED[name](panel, i == 1) for i, panel in enumerate(panels))
    plan = clustered._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange RoundRobin" not in plan and "Bucketed: true" in plan
    assert "Exchange hashpartitioning" in plain._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, clustered.collect())) == sorted(map(tuple, plain.collect()))
