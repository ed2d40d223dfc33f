import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.sql import functions as F

from panelspark.functions.losses import FocalLoss, LogLoss
from panelspark.operators import models as M
from panelspark.operators.binning import feature_array
from panelspark.operators.boosted_models import HistogramBooster, HistogramBoosterModel
from panelspark.operators.boosting import BoostParams, boost
from panelspark.operators.folds import in_holdout, stratified_folds
from panelspark.operators.forest import shapley_sums, shapley_sums_of
from panelspark.operators.metrics import auc, focal_init_score
from panelspark.operators.selection import recursive_selection
from panelspark.sources import tables


@pytest.fixture(scope="module")
def customers(spark):
    """Two informative measures, one of them often missing, a category, and noise."""
    u = [F.rand(seed=s) for s in range(5)]
    df = spark.range(1200).select("id", u[0].alias("a"), u[1].alias("b"), u[2].alias("noise"), (u[3] * 4).cast("int").alias("cat"))
    signal = 2 * F.col("a") + F.col("b") + (F.col("cat") == 2).cast("double")
    df = df.withColumn("y", (signal + 0.3 * F.rand(seed=9) > 2.0).cast("int"))
    df = df.withColumn("b", F.when(F.col("id") % 4 != 0, F.col("b"))).cache()
    folds = stratified_folds(df, "id", "y", 3)
    return df.join(folds.select("id", "fold"), "id").cache()


def gbt(**params):
    return GBTClassifier(labelCol="y", featuresCol="features", maxDepth=3, seed=1, **{"maxIter": 5, **params})


@pytest.fixture(scope="module")
def vectors(customers):
    return M.feature_vectors(customers, ["id", "y", "fold"], ["a", "b", "noise"], ["cat"]).cache()


def test_feature_vectors_are_finite_and_declare_categories(spark):
    rows = [(1, float("inf"), 2), (2, None, None), (3, float("nan"), -1), (4, float("-inf"), 0)]
    df = M.feature_vectors(spark.createDataFrame(rows, "id INT, x DOUBLE, c INT"), ["id"], ["x"], ["c"])
    got = [r["features"].toArray().tolist() for r in df.orderBy("id").collect()]
    assert got == [[1e12, 0.0, 3.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.0], [-1e12, 0.0, 1.0]]
    attributes = df.schema["features"].metadata["ml_attr"]["attrs"]
    assert attributes["nominal"][0]["num_vals"] == 4


def test_cross_fit_covers_every_row_once(spark, customers, vectors, tmp_path):
    test = M.feature_vectors(customers.limit(50), ["id"], ["a", "b", "noise"], ["cat"])
    fitted = M.cross_fit(vectors, gbt(), "id", "y", 3, test=test)
    oof = fitted.oof.toPandas()
    assert sorted(oof["id"]) == list(range(1200))
    assert auc(fitted.oof, "y", "prediction").first()["auc"] > 0.85
    assert fitted.test.groupBy("id").count().filter("count <> 3").count() == 0
    # Each row's score comes from the model that did not see its fold.
    again = M.positive_probability(fitted.models[1], vectors.filter("fold = 1"), ["id"]).toPandas().set_index("id")
    mine = oof[oof["fold"] == 1].set_index("id")["prediction"]
    np.testing.assert_allclose(mine.sort_index(), again["prediction"].sort_index())
    tables.save_model(fitted.models[0], str(tmp_path / "model"))
    loaded = tables.load_model(GBTClassificationModel, str(tmp_path / "model"))
    assert loaded.getNumTrees == fitted.models[0].getNumTrees


def test_more_codes_than_bins_train(customers):
    many = customers.withColumn("cat", (F.col("id") % 40).cast("int"))
    vectors = M.feature_vectors(many, ["id", "y", "fold"], ["a"], ["cat"])
    assert M.cross_fit(vectors, gbt(maxIter=1), "id", "y", 3).oof.count() == 1200
    assert M.with_bins(gbt(), vectors).getMaxBins() == 41 and M.with_bins(gbt(maxBins=64), vectors).getMaxBins() == 64


def test_focal_boosting_lowers_the_loss(vectors):
    loss = FocalLoss(2.0, 0.3)
    curve = []
    for rounds in (1, 4, 12):
        params = BoostParams(rounds=rounds, max_depth=3, learning_rate=0.3, checkpoint_every=5)
        booster = M.fit_focal_booster(vectors, "y", loss, params=params)
        assert len(booster.trees) == rounds
        scored = booster.scores(vectors, ["id", "y"])
        curve.append(scored.agg(F.avg(loss.loss("y", "prediction"))).first()[0])
    assert curve[0] > curve[1] > curve[2]
    assert booster.forest.init_score == pytest.approx(focal_init_score(vectors, "y", loss).first()["init_score"])


def test_focal_first_step_is_a_newton_step(vectors):
    """A tree of depth 0 moves all margins by learning rate times -sum(g) / sum(h)."""
    loss = FocalLoss(2.0, 0.3)
    booster = M.fit_focal_booster(vectors, "y", loss, params=BoostParams(rounds=1, max_depth=0, learning_rate=0.5, l2=0.0), init_score=0.0)
    half = F.lit(0.5)
    g, h = vectors.agg(F.sum(loss.gradient("y", half)), F.sum(loss.hessian("y", half))).first()
    margin = booster.scores(vectors, ["id"]).select("margin").distinct().collect()
    assert len(margin) == 1 and margin[0][0] == pytest.approx(-0.5 * g / h)


def test_a_saved_booster_gives_the_same_margins(spark, vectors, tmp_path):
    loss = FocalLoss(2.0, 0.3)
    booster = M.fit_focal_booster(vectors, "y", loss, params=BoostParams(rounds=3, max_depth=3, drop_rate=0.5, skip_drop=0.0))
    for _ in range(2):  # the second time over the first
        tables.save_model(booster, str(tmp_path / "model"))
    loaded = tables.load_model(HistogramBoosterModel, str(tmp_path / "model"))
    assert (loaded.forest, loaded.loss, loaded.featuresCol) == (booster.forest, loss, "features")
    one, two = (m.scores(vectors, ["id"]).orderBy("id").toPandas() for m in (booster, loaded))
    np.testing.assert_array_equal(one["margin"], two["margin"])


def test_boosters_cross_fit_one_by_one_or_side_by_side(vectors):
    params = BoostParams(rounds=4, max_depth=3, bins=32)
    booster = HistogramBooster(params, labelCol="y")
    alone = M.cross_fit(vectors, booster, "id", "y", 3).oof.orderBy("id").toPandas()
    together = M.cross_fit_boosted(vectors, LogLoss(), "id", "y", 3, params=params, test=vectors.select("id", "features"))
    assert auc(together.oof, "y", "prediction").first()["auc"] > 0.85
    # Bins are of all rows in the one, of the rows trained on in the other.
    assert np.corrcoef(alone["prediction"], together.oof.orderBy("id").toPandas()["prediction"])[0, 1] > 0.98
    assert together.test.groupBy("id").count().filter("count <> 3").count() == 0 and len(together.models) == 3


def test_null_sequences(spark):
    rows = [(1, 13, None), (1, 11, 2.0), (2, 12, None), (2, 0, None)]
    panel = spark.createDataFrame(rows, "id INT, ind INT, x DOUBLE")
    value = M.null_sequences(panel, "id", ["x"], "value", periods=[11, 12, 13]).orderBy("id")
    assert [tuple(r) for r in value.collect()] == [(1, 0, 0, 1), (2, 0, 1, 0)]
    absent = M.null_sequences(panel, "id", ["x"], "statement", periods=[11, 12, 13]).orderBy("id")
    assert [tuple(r) for r in absent.collect()] == [(1, 0, 1, 0), (2, 1, 0, 1)]
    with pytest.raises(ValueError):
        M.null_sequences(panel, "id", ["x"], "other")


def test_null_sequence_stack(spark, customers):
    base = customers.select("id", "y")
    periods = F.explode(F.sequence(F.lit(11), F.lit(13))).alias("ind")
    panel = base.select("id", "y", periods).withColumn("x", F.when((F.col("y") == 0) | (F.col("ind") < 12), 1.0))
    sequences = M.null_sequences(panel, "id", ["x"], periods=[11, 12, 13])
    learner = LogisticRegression(labelCol="y", featuresCol="features", maxIter=5)
    folds = customers.select("id", "y", "fold").filter("id < 900")
    train, test = M.null_sequence_stack(
        sequences.filter("id < 900"), sequences.filter("id >= 900"), folds, learner, "id", "y", 3, "f"
    )
    assert train.count() == 900 and test.count() == 300
    assert auc(train.join(base, "id"), "y", "f").first()["auc"] == pytest.approx(1.0)
    assert auc(test.join(base, "id"), "y", "f").first()["auc"] == pytest.approx(1.0)


def test_cv_check_stops_early(vectors):
    params = BoostParams(rounds=40, learning_rate=0.5, max_depth=3, patience=4, checkpoint_every=4, bins=32)
    report = M.cv_check(vectors, params, "id", "y", 3).toPandas()
    assert sorted(report["fold"]) == [0, 1, 2]
    assert (report["trees"] < 40).all() and (report["log_loss"] < 0.69).all()


@pytest.mark.parametrize("by", ["importance", "loss", "shap"])
def test_selection_drops_noise(customers, by):
    names = ["noise", "a", "b", "flat"]
    df = customers.withColumn("flat", F.lit(1.0))
    rows = df.select("id", "y", feature_array(df, names).alias("features"))
    held = in_holdout("id", 0.3)
    params = BoostParams(rounds=3, max_depth=3, bins=32)
    kept = recursive_selection(rows.filter(~held), "y", "id", names, params, None, (3, 2, 1), 2, by, rows.filter(held))
    assert [len(kept[n]) for n in (3, 2, 1)] == [3, 2, 1]
    assert set(kept[2]) == {"a", "b"} and kept[1] == ["a"]


def test_criteria_share_the_jobs_of_a_step(customers, monkeypatch):
    from panelspark.operators import selection

    names = ["noise", "a", "b", "flat"]
    df = customers.withColumn("flat", F.lit(1.0))
    rows = df.select("id", "y", feature_array(df, names).alias("features"))
    held = in_holdout("id", 0.3)
    given = (rows.filter(~held), "y", "id", names, BoostParams(rounds=2, max_depth=2, bins=32), None, (3, 1), 2)
    alone = {by: recursive_selection(*given, by, rows.filter(held)) for by in ("shap", "loss", "importance")}
    grown, boost_rows = [], selection.boost_rows

    def counted(*args, **named):
        grown.append(named["allowed"])
        return boost_rows(*args, **named)

    monkeypatch.setattr(selection, "boost_rows", counted)
    together = recursive_selection(*given, ("shap", "loss", "importance"), rows.filter(held))
    assert together == alone
    assert len(grown) == 3 and len(grown[0]) == 1 and len({tuple(s) for s in grown[1]}) == len(grown[1])
    with pytest.raises(ValueError):
        recursive_selection(*given, ("shap", "other"), rows.filter(held))


def test_scores_of_several_forests_are_those_of_each(customers):
    names = ["a", "b", "noise"]
    rows = customers.select("id", "y", feature_array(customers, names).alias("features"))
    forests = [boost(rows, "y", "id", params=BoostParams(rounds=r, max_depth=2, bins=32)).forests[0] for r in (1, 4)]
    both = shapley_sums_of(rows, forests, "y", LogLoss().values).toPandas()
    assert sorted(zip(both["model"], both["feature"], strict=True)) == [(m, f) for m in range(2) for f in range(3)]
    for m, forest in enumerate(forests):
        got = both[both["model"] == m].sort_values("feature")
        one = shapley_sums(rows, forest, "y", LogLoss().values).orderBy("feature").toPandas()
        for column in ("importance", "loss_change", "rows"):
            assert got[column].tolist() == pytest.approx(one[column].tolist(), abs=1e-12)


def test_loss_changes_match_one_by_one_where_trees_share_no_path(customers):
    """For stumps a feature's Shapley value is its step less the mean step, so taking it away puts the mean in its place."""
    names = ["a", "b", "noise"]
    rows = customers.select("id", "y", feature_array(customers, names).alias("features"))
    forest = boost(rows, "y", "id", params=BoostParams(rounds=5, max_depth=1, column_share=0.34, bins=32)).forests[0]
    got = shapley_sums(rows, forest, "y", LogLoss().values).orderBy("feature").toPandas()["loss_change"]
    data = customers.toPandas().sort_values("id")
    x, y = data[names].to_numpy(float), data["y"].to_numpy(float)
    base = LogLoss().values(y, forest.margins(x)).mean()
    for f in range(3):
        margin = np.full(len(y), forest.init_score)
        for tree, weight in zip(forest.trees, forest.weights, strict=True):
            steps = tree.steps(x)
            margin += weight * (steps.mean() if tree.feature[0] == f else steps)
        assert got[f] == pytest.approx(LogLoss().values(y, margin).mean() - base, abs=1e-12)


def test_selection_arguments(vectors):
    with pytest.raises(ValueError):
        recursive_selection(vectors, "y", "id", ["a"], by="other")
    with pytest.raises(ValueError):
        recursive_selection(vectors, "y", "id", ["a"], by="loss")


def test_customers_without_a_sequence_stay(spark, customers):
    base = customers.select("id", "y", "fold").filter("id < 300")
    panel = base.filter("id % 10 <> 0").select("id", F.lit(12).alias("ind"), F.lit(1.0).alias("x"))
    sequences = M.null_sequences(panel, "id", ["x"], "statement", periods=[11, 12])
    complete = M.complete_sequences(base, sequences, "id", 1)
    assert complete.count() == base.count()
    absent = complete.filter("id % 10 = 0").select("statement_11", "statement_12").distinct().collect()
    assert [tuple(r) for r in absent] == [(1, 1)]


def test_model_queries_take_every_feature_of_the_build(spark):
    from panelspark.catalog import QUERIES
    from panelspark.catalog import model_queries as Q

    built = QUERIES["feature_build"](spark, "/root/testdata/sf0.001").columns
    assert sorted([*Q.NUMERIC, *Q.CATEGORICAL]) == sorted(Q.FEATURES) == sorted(built[1:]) and len(Q.FEATURES) == 93
    assert Q.SELECTED == (48, 29, 10) and Q.STEPS == 10
    vectors = Q._train_vectors(spark, "/root/testdata/sf0.001")
    assert len(vectors.first()["features"]) == 2 * len(Q.NUMERIC) + len(Q.CATEGORICAL)
