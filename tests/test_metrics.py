import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions.losses import FocalLoss, log_loss
from panelspark.operators import metrics as M


def definition(y, s, ids):
    """Top capture, normalized weighted Gini and their mean, row by row."""

    def area(order):
        label = y[order]
        weight = np.where(label == 0, 20.0, 1.0)
        found = np.cumsum(label) / label.sum()
        expected = np.cumsum(weight) / weight.sum()
        return np.dot(found - expected, weight)

    by_score = np.lexsort((-ids, -s))
    label = y[by_score]
    weight = np.where(label == 0, 20, 1)
    capture = label[np.cumsum(weight) <= int(0.04 * weight.sum())].sum() / label.sum()
    gini = area(by_score) / area(np.lexsort((-ids, -y)))
    return capture, gini, 0.5 * (capture + gini)


@pytest.fixture(scope="module")
def scored():
    rng = np.random.default_rng(9)
    n = 4000
    y = (rng.random(n) < 0.2).astype(int)
    s = np.round(np.clip(0.3 * y + rng.random(n) * 0.7, 0, 1), 2)
    s[rng.random(n) < 0.33] = 0.6
    return pd.DataFrame({"id": rng.permutation(n), "y": y, "s": s, "fold": rng.integers(0, 4, n)})


@pytest.fixture(scope="module")
def frame(spark, scored):
    return spark.createDataFrame(scored).repartition(6).cache()


@pytest.mark.parametrize("shuffle", ["1", "4", "32"])
def test_rank_metrics_equal_definition(spark, frame, scored, shuffle):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = M.rank_metrics(frame, "y", "s", "id").first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = definition(*(scored[c].to_numpy() for c in ("y", "s", "id")))
    np.testing.assert_allclose([got["capture"], got["gini"], got["metric"]], want, rtol=1e-9)


def test_metric_by_fold(frame, scored):
    report = M.metric_by_fold(frame, "y", "s", "id").toPandas()
    per_fold = {k: definition(*(g[c].to_numpy() for c in ("y", "s", "id")))[2] for k, g in scored.groupby("fold")}
    got = report[report["scope"] == "fold"].set_index("fold")["metric"]
    for k, v in per_fold.items():
        assert got[k] == pytest.approx(v, rel=1e-9)
    assert report[report["scope"] == "mean"]["metric"].item() == pytest.approx(np.mean(list(per_fold.values())))
    overall = definition(*(scored[c].to_numpy() for c in ("y", "s", "id")))[2]
    assert report[report["scope"] == "all"]["metric"].item() == pytest.approx(overall)


def test_perfect_order_and_monotone_rescaling(frame):
    perfect = frame.withColumn("s", F.col("y").cast("double"))
    assert M.rank_metrics(perfect, "y", "s", "id").first()["gini"] == pytest.approx(1.0)
    plain = M.rank_metrics(frame, "y", "s", "id").first()
    bent = M.rank_metrics(frame.withColumn("s", F.exp(F.col("s") * 5)), "y", "s", "id").first()
    assert plain == bent


def test_one_class_gives_null(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.6)], "id INT, y INT, s DOUBLE")
    assert M.rank_metrics(df, "y", "s", "id").first()["metric"] is None
    assert M.auc(df, "y", "s").first()["auc"] is None


def test_evaluator(frame):
    evaluator = M.RankMetricEvaluator("y", "s", "id")
    assert evaluator.isLargerBetter()
    assert evaluator.evaluate(frame) == M.rank_metrics(frame, "y", "s", "id").first()["metric"]


def test_auc_and_log_loss(frame, scored):
    pos, neg = (scored[scored["y"] == k]["s"].to_numpy() for k in (1, 0))
    wins = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    eps = np.finfo(float).eps
    p = np.clip(scored["s"], eps, 1 - eps)
    loss = -np.mean(np.where(scored["y"] == 1, np.log(p), np.log(1 - p)))
    got = M.auc_log_loss(frame, "y", "s").first()
    assert got["auc"] == pytest.approx(wins) and got["log_loss"] == pytest.approx(loss)
    by_fold = M.auc(frame, "y", "s", ["fold"]).toPandas()
    assert len(by_fold) == 4 and by_fold["auc"].between(0.5, 1).all()


@pytest.mark.parametrize("loss", [FocalLoss(2.0, 0.3), FocalLoss(1.5)])
def test_focal_derivatives_match_finite_differences(spark, loss):
    step = 1e-4
    rows = [(y, z) for y in (0, 1) for z in (-3.0, -0.7, 0.0, 0.4, 2.5)]
    df = spark.createDataFrame(rows, "y INT, z DOUBLE")

    def at(shift):
        return loss.loss("y", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("z") + F.lit(shift)))))

    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("z")))
    out = df.select(
        loss.gradient("y", p).alias("g"), loss.hessian("y", p).alias("h"), at(0.0).alias("l"), at(step).alias("up"), at(-step).alias("down")
    ).toPandas()
    np.testing.assert_allclose(out["g"], (out["up"] - out["down"]) / (2 * step), rtol=1e-5, atol=1e-7)
    np.testing.assert_allclose(out["h"], (out["up"] - 2 * out["l"] + out["down"]) / step**2, rtol=1e-3, atol=1e-6)


def test_losses_are_finite_at_the_ends(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 1.0), (1, 1.0)], "y INT, p DOUBLE")
    values = df.select(FocalLoss().loss("y", "p"), log_loss("y", "p")).collect()
    assert all(math.isfinite(v) for r in values for v in r)


def test_focal_init_score_is_the_minimum(frame, scored):
    loss = FocalLoss(2.0, 0.3)
    got = M.focal_init_score(frame, "y", loss).first()
    n1 = int(scored["y"].sum())
    n0 = len(scored) - n1
    grid = np.arange(1, 10**6) / 10**6
    total = -n1 * 0.3 * (1 - grid) ** 2 * np.log(grid) - n0 * 0.7 * grid**2 * np.log(1 - grid)
    assert got["best_p"] == pytest.approx(grid[total.argmin()], abs=2e-6)
    assert got["init_score"] == pytest.approx(math.log(got["best_p"] / (1 - got["best_p"])))


def test_top_importances(spark):
    rows = [(k, f"f{i:03}", float(i % 50 + k)) for k in range(2) for i in range(100)]
    top = M.top_importances(spark.createDataFrame(rows, "fold INT, feature STRING, importance DOUBLE")).collect()
    assert len(top) == 40 and top[0]["feature"] == "f049" and top[0]["importance"] == 49.5
    assert [r["importance"] for r in top] == sorted((r["importance"] for r in top), reverse=True)
