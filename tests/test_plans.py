"""The whole way from raw statements to a blended submission, on a made-up credit panel."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.sql import functions as F

from panelspark.operators.blend import rank_blend
from panelspark.operators.distance import fit_scaler
from panelspark.operators.features import PanelSpec
from panelspark.operators.folds import stratified_folds
from panelspark.operators.models import feature_vectors, null_sequence_stack, null_sequences
from panelspark.operators.panel import take_split
from panelspark.plans.denoise import credit_panel_preset
from panelspark.plans.feature_plan import customer_features
from panelspark.plans.prepare import nulls_for_sentinels, prepare_panel
from panelspark.plans.scoring import score_model
from panelspark.sources import tables


@pytest.fixture(scope="module")
def raw():
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        bad = rng.random() < 0.3
        for month in sorted(rng.choice(np.arange(1, 14), rng.integers(3, 14), replace=False)):
            day = pd.Timestamp(2017, 1, 1) + pd.DateOffset(months=int(month), days=int(rng.integers(0, 27)))
            b_2 = rng.integers(0, 80) / 100 + bad * 0.2 + rng.random() * 0.009
            noisy = float(rng.integers(0, 2)) + rng.random() * 0.01
            x = None if rng.random() < 0.2 else float(rng.normal(bad, 1))
            rows.append((f"c{i:03}", str(day.date()), b_2, noisy, x, "CO" if bad else "CR", None if rng.random() < 0.5 else "U", 1.0, int(bad)))
    return pd.DataFrame(rows, columns=["customer_ID", "S_2", "B_2", "D_62", "B_5", "D_63", "D_64", "B_29", "target"])


def test_from_statements_to_submission(spark, raw, tmp_path):
    df = spark.createDataFrame(raw).withColumn("B_5", F.when(~F.isnan("B_5"), F.col("B_5")))
    is_test = F.substring("customer_ID", 4, 1).isin("0", "5")
    statements = df.drop("target")
    panel = prepare_panel(statements.filter(~is_test), statements.filter(is_test), "customer_ID", "S_2", credit_panel_preset())
    tables.write_panel(panel, str(tmp_path / "panel"))
    panel = tables.read_panel(spark, str(tmp_path / "panel"))

    pdf = panel.toPandas()
    assert len(pdf) == len(raw) and "B_29" not in pdf and set(pdf["D_62"]) == {0.0, 1.0}
    assert (pdf.groupby("customer_ID")["ind"].max() == 13).all()
    months = pd.to_datetime(pdf["S_2"]).dt.year * 12 + pd.to_datetime(pdf["S_2"]).dt.month
    assert (pdf["ind"] == 13 - (months.groupby(pdf["customer_ID"]).transform("max") - months)).all()
    assert set(pdf["D_64"]) == {-1, 3} and set(pdf["D_63"]) == {0, 3}
    assert (pdf["B_2"] == np.floor(pdf["B_2"])).all()

    panel = nulls_for_sentinels(panel, ["customer_ID", "ind"])
    train, test = take_split(panel, "train"), take_split(panel, "test")
    labels = df.select("customer_ID", "target").distinct().filter(~is_test)
    folds = stratified_folds(labels, "customer_ID", "target", 3)
    learner = LogisticRegression(labelCol="target", featuresCol="features", maxIter=5, regParam=0.1)
    sequences = [null_sequences(p, "customer_ID", ["B_5", "D_64"]) for p in (train, test)]
    stacked = null_sequence_stack(*sequences, folds, learner, "customer_ID", "target", 3, "missing_value_feature")

    spec, numeric, categorical = PanelSpec("customer_ID"), ["B_2", "D_62", "B_5"], ["D_63", "D_64"]
    scaler = fit_scaler(train, numeric)
    train_features = customer_features(train, spec, numeric, categorical, scaler, [stacked[0]])
    names = [c for c in train_features.columns if c != "customer_ID"]
    test_features = customer_features(test, spec, numeric, categorical, scaler, [stacked[1]], names=names)
    assert test_features.columns == train_features.columns

    inputs = [n for n in names if n.startswith("B_") or n == "missing_value_feature"]
    vectors = feature_vectors(train_features.join(folds, "customer_ID"), ["customer_ID", "target", "fold"], inputs)
    test_vectors = feature_vectors(test_features, ["customer_ID"], inputs)
    learners = {
        "trees": GBTClassifier(labelCol="target", featuresCol="features", maxIter=3, maxDepth=2, seed=1),
        "linear": learner,
    }
    scored = {n: score_model(vectors, e, "customer_ID", "target", 3, test_vectors) for n, e in learners.items()}
    report = scored["trees"].report.toPandas()
    assert list(report["scope"].value_counts().sort_index()) == [1, 3, 1] and report["metric"].between(0.2, 1).all()

    blended = rank_blend({n: s.test for n, s in scored.items()}, {"trees": 0.7, "linear": 0.3}, "customer_ID")
    tables.write_predictions(blended, str(tmp_path / "submission"), "customer_ID")
    back = tables.read_csv(spark, str(tmp_path / "submission"), "customer_ID STRING, prediction DOUBLE").toPandas()
    assert len(back) == test.select("customer_ID").distinct().count() and back["prediction"].between(0, 1).all()
