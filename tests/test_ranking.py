import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators.blend import fold_rank, fold_rank_average, rank_blend, rank_blend_chain
from panelspark.operators.folds import in_holdout, stratified_folds
from panelspark.operators.ranking import percent_rank, row_position, running_total


@pytest.fixture(scope="module")
def scores():
    """Half of the rows share one score; some scores are missing."""
    rng = np.random.default_rng(5)
    score = np.where(rng.random(3000) < 0.5, 0.25, np.round(rng.random(3000), 2))
    score[rng.random(3000) < 0.05] = np.nan
    return pd.DataFrame({"id": np.arange(3000), "fold": rng.integers(0, 3, 3000), "s": score, "w": rng.integers(1, 21, 3000)})


@pytest.fixture(scope="module")
def frame(spark, scores):
    df = spark.createDataFrame(scores).withColumn("s", F.when(~F.isnan("s"), F.col("s")))
    return df.repartition(5).cache()


@pytest.fixture(params=["1", "7", "32"])
def partitions(spark, request):
    """Shuffle partitions, not merged again by the adaptive planner."""
    settings = {"spark.sql.shuffle.partitions": request.param, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield int(request.param)
    for k, v in before.items():
        spark.conf.set(k, v)


def test_running_total_over_hot_ties(frame, scores, partitions):
    rows = frame.filter(F.col("s").isNotNull())
    out = running_total(rows, [F.col("s").desc(), F.col("id").desc()], {"cum": F.col("w"), "n": F.lit(1)})
    got = out.toPandas().set_index("id").sort_index()
    want = scores.dropna().sort_values(["s", "id"], ascending=False)
    want = want.assign(cum=want["w"].cumsum(), n=np.arange(1, len(want) + 1)).set_index("id").sort_index()
    assert (got["cum"] == want["cum"]).all() and (got["n"] == want["n"]).all()


def test_running_total_restarts_per_partition(frame, scores, partitions):
    out = row_position(frame, [F.col("id").asc()], "pos", ["fold"]).toPandas().set_index("id").sort_index()
    want = scores.groupby("fold").cumcount() + 1
    assert (out["pos"].to_numpy() == want.to_numpy()).all()


def test_percent_rank_equals_pandas(frame, scores, partitions):
    got = percent_rank(frame, "s", "r").toPandas().set_index("id").sort_index()["r"]
    np.testing.assert_allclose(got.astype(float), scores["s"].rank(pct=True), rtol=1e-12)
    by_fold = percent_rank(frame, "s", "r", ["fold"]).toPandas().set_index("id").sort_index()["r"]
    np.testing.assert_allclose(by_fold.astype(float), scores.groupby("fold")["s"].rank(pct=True), rtol=1e-12)


def test_fold_ranks(frame, scores):
    clean = frame.filter(F.col("s").isNotNull()).select("id", "fold", F.col("s").alias("prediction"))
    want = scores.dropna().groupby("fold")["s"].rank(pct=True).rename("r")
    got = fold_rank(clean, "id").toPandas().set_index("id")["prediction"].sort_index()
    np.testing.assert_allclose(got, want.sort_index(), rtol=1e-12)
    # The same ids scored by three models.
    three = clean.select(F.pmod("id", F.lit(500)).alias("id"), "fold", "prediction").dropDuplicates(["id", "fold"])
    pdf = three.toPandas()
    pdf["r"] = pdf.groupby("fold")["prediction"].rank(pct=True)
    averaged = fold_rank_average(three, "id").toPandas().set_index("id")["prediction"].sort_index()
    np.testing.assert_allclose(averaged, pdf.groupby("id")["r"].mean().sort_index(), rtol=1e-12)


def test_blends(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": np.arange(200), "a": rng.random(200), "b": rng.integers(0, 9, 200) / 9, "c": rng.random(200)})
    df = spark.createDataFrame(pdf)
    models = {m: df.select("id", F.col(m).alias("prediction")) for m in "abc"}
    weights = {"a": 0.6, "b": 0.15, "c": 0.25}
    got = rank_blend(models, weights, "id").toPandas().set_index("id")["prediction"].sort_index()
    np.testing.assert_allclose(got, sum(w * pdf[m].rank(pct=True) for m, w in weights.items()), rtol=1e-12)
    chain = rank_blend_chain(models["a"], [(models["b"], 0.5), (models["c"], 0.05)], "id")
    first = 0.5 * pdf["a"].rank(pct=True) + 0.5 * pdf["b"].rank(pct=True)
    want = 0.95 * first.rank(pct=True) + 0.05 * pdf["c"].rank(pct=True)
    np.testing.assert_allclose(chain.toPandas().set_index("id")["prediction"].sort_index(), want, rtol=1e-12)
    partial = {"a": models["a"], "b": models["b"].filter("id < 50")}
    assert rank_blend(partial, {"a": 0.5, "b": 0.5}, "id").count() == 50
    with pytest.raises(ValueError):
        rank_blend(models, {"a": 1.0}, "id")


def test_folds_partition_and_balance(spark, partitions):
    df = spark.range(1003).select("id", (F.col("id") % 7 == 0).cast("int").alias("y"))
    folds = stratified_folds(df, "id", "y").toPandas()
    assert sorted(folds["id"]) == list(range(1003))
    counts = folds.groupby(["y", "fold"]).size().unstack()
    assert (counts.max(axis=1) - counts.min(axis=1)).max() <= 1
    again = stratified_folds(df.repartition(9), "id", "y").toPandas()
    assert folds.set_index("id")["fold"].sort_index().equals(again.set_index("id")["fold"].sort_index())
    other = stratified_folds(df, "id", "y", seed=7).toPandas()
    assert not folds.set_index("id")["fold"].sort_index().equals(other.set_index("id")["fold"].sort_index())


def test_holdout_share(spark):
    df = spark.range(20000)
    share = df.filter(in_holdout("id", 0.2)).count() / 20000
    assert 0.18 < share < 0.22
    inside = {r["id"] for r in df.filter(in_holdout("id", 0.1)).collect()}
    assert inside < {r["id"] for r in df.filter(in_holdout("id", 0.3)).collect()}
    with pytest.raises(ValueError):
        in_holdout("id", 1.0)


def test_empty_and_unscored_frames(frame):
    nothing = frame.filter("id < 0")
    assert running_total(nothing, [F.col("id").asc()], {"cum": F.col("w")}).count() == 0
    assert percent_rank(nothing, "s", "r").count() == 0
    unscored = frame.filter(F.col("s").isNull())
    ranks = percent_rank(unscored, "s", "r", ["fold"]).select("r").distinct().collect()
    assert [r[0] for r in ranks] == [None]


def test_null_partitions_count_on_across_buckets(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("p"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = row_position(rows, [F.col("id").asc()], "pos", ["p"]).groupBy("p").agg(
            F.count_distinct("pos").alias("n"), F.max("pos").alias("top"), F.count("*").alias("rows")
        )
        assert all(r["n"] == r["top"] == r["rows"] for r in placed.collect()) and placed.count() == 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
