"""Model operators on customer features.

Training as such has no SQL equal. A tree of depth 1 on one feature of two values has: its leaves are
means, or Newton steps, of the rows it was fitted on. The ``*_stump`` queries state that in SQL over all
labelled customers and folds.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.sql import functions as F

from panelspark.catalog.feature_queries import CATEGORICAL as CATEGORY_COLUMNS, NUMERIC as NUMBER_COLUMNS
from panelspark.catalog.fixtures import (
    ORDERS_PANEL,
    USER_DAY_PANEL,
    customer_target,
    orders_panel,
    rounded,
    rounded_sql,
    user_day_panel,
)
from panelspark.catalog.registry import Registry
from panelspark.functions.losses import FocalLoss, LogLoss
from panelspark.operators.binning import feature_array
from panelspark.operators.boosting import BoostParams
from panelspark.operators.features import PanelSpec, build_features, feature_catalog
from panelspark.operators.folds import in_holdout, stratified_folds
from panelspark.operators.models import (
    complete_sequences,
    cross_fit,
    cross_fit_boosted,
    cross_fit_focal,
    cv_check as check_features,
    feature_vectors,
    null_sequence_stack as stack_null_sequences,
    null_sequences,
)
from panelspark.operators.selection import STEPS, TARGETS, recursive_selection as select_recursively
from panelspark.session import checkpoint_frame

R = Registry()
FOLDS = 5
#: All features of the build. Of a category column, the last and first value are categories; counts and null patterns are numbers.
FEATURES = [f.name for f in feature_catalog(NUMBER_COLUMNS, CATEGORY_COLUMNS)]
CATEGORICAL = [f"{c}_{agg}" for agg in ("last", "first") for c in CATEGORY_COLUMNS]
NUMERIC = [name for name in FEATURES if name not in CATEGORICAL]
#: Trees of a model and rounds of focal boosting: the number that GBTClassifier has by itself.
TREES = 20
#: Rounds of each of the up to sixty models of the elimination.
SELECTION_ROUNDS = 10
#: Sizes in the proportion of 2500, 1500 and 500 to the 4,859 features of a 181-column panel.
SELECTED = tuple(round(len(FEATURES) * size / 4859) for size in TARGETS)


def _gbt(trees: int = TREES, **params) -> GBTClassifier:
    return GBTClassifier(labelCol="target", featuresCol="features", maxIter=trees, maxDepth=3, seed=42, **params)


def _features(spark, sf_dir):
    """(id, target, features...) of customers with orders."""
    table = build_features(orders_panel(spark, sf_dir), PanelSpec("id"), NUMBER_COLUMNS, CATEGORY_COLUMNS)
    return table.join(customer_target(spark, sf_dir), "id")


def _train_vectors(spark, sf_dir, numeric=NUMERIC, categorical=CATEGORICAL, indicators=True, everyone=True):
    """Vectors with folds of all customers, or of those that are not kept for the test split."""
    features = _features(spark, sf_dir)
    features = features if everyone else features.filter(F.col("id") % 5 != 0)
    folds = stratified_folds(features.select("id", "target"), "id", "target", FOLDS)
    joined = features.join(folds.select("id", "fold"), "id")
    return feature_vectors(joined, ["id", "target", "fold"], numeric, categorical, indicators)


def _train_arrays(spark, sf_dir, names=FEATURES):
    """(id, target, fold, features) of all customers, missing values as they are."""
    features = _features(spark, sf_dir)
    folds = stratified_folds(features.select("id", "target"), "id", "target", FOLDS)
    joined = features.join(folds.select("id", "fold"), "id")
    return joined.select("id", "target", "fold", feature_array(joined, names).alias("features"))


def _test_vectors(spark, sf_dir):
    features = _features(spark, sf_dir).filter(F.col("id") % 5 == 0)
    return feature_vectors(features, ["id"], NUMERIC, CATEGORICAL)


@R.query()
def cross_fit_gbt(spark, sf_dir):
    fitted = cross_fit(_train_vectors(spark, sf_dir, everyone=False), _gbt(), "id", "target", FOLDS, test=_test_vectors(spark, sf_dir))
    oof = fitted.oof.select("id", F.lit("train").alias("split"), "fold", "prediction")
    return oof.unionByName(fitted.test.select("id", F.lit("test").alias("split"), "fold", "prediction"))


@R.query()
def focal_boost(spark, sf_dir):
    """Out-of-fold margins of focal boosting from the best constant on."""
    loss = FocalLoss(gamma=2.0, alpha=0.3)
    params = BoostParams(rounds=TREES, max_depth=3, max_leaves=8, learning_rate=0.3)
    return cross_fit_focal(_train_arrays(spark, sf_dir), loss, "id", "target", FOLDS, params=params)


#: Of the dropped-tree model, in the proportions of the original: a fifth of the columns a tree, half of the rows anew every ten rounds.
DART = BoostParams(rounds=TREES, learning_rate=0.3, max_depth=5, max_leaves=20, l2=2.0, min_rows=40, column_share=0.2, row_share=0.5, row_every=10, drop_rate=0.1)


@R.query()
def cross_fit_dart(spark, sf_dir):
    """Out-of-fold and test predictions of trees with missing directions, samples and dropped trees."""
    rows = _train_arrays(spark, sf_dir)
    is_test = F.col("id") % 5 == 0
    fitted = cross_fit_boosted(rows.filter(~is_test), LogLoss(), "id", "target", FOLDS, params=DART, test=rows.filter(is_test).select("id", "features"))
    oof = fitted.oof.select("id", F.lit("train").alias("split"), "fold", "prediction")
    return oof.unionByName(fitted.test.select("id", F.lit("test").alias("split"), "fold", "prediction"))


def _buyers(spark, sf_dir):
    """The user-day panel, and every user with the target: a purchase on the last day."""
    panel = user_day_panel(spark, sf_dir)
    bought = (F.col("ind") == 13) & F.col("buy").isNotNull()
    return panel, panel.groupBy("id").agg(F.max(bought.cast("int")).alias("target"))


@R.query()
def null_sequence_stack(spark, sf_dir):
    """Both stacked features of every user."""
    panel, target = _buyers(spark, sf_dir)
    is_test = F.col("id") % 5 == 0
    folds = stratified_folds(target.filter(~is_test), "id", "target", FOLDS)
    learner = LogisticRegression(labelCol="target", featuresCol="features", maxIter=10, regParam=0.01)
    stacked = []
    for variant, absent in (("value", 0), ("statement", 1)):
        sequences = null_sequences(panel.filter(F.col("ind") < 13), "id", ["val", "buy"], variant)
        test = complete_sequences(target.filter(is_test).select("id"), sequences, "id", absent)
        train, test = stack_null_sequences(
            sequences, test, folds, learner, "id", "target", FOLDS, f"missing_{variant}_feature", absent
        )
        stacked.append(train.unionByName(test))
    return stacked[0].join(stacked[1], "id")


FOLDS_SQL = """folds AS (SELECT *, CAST((row_number() OVER (PARTITION BY target ORDER BY md5(CAST(id AS VARCHAR) || '42'), id) - 1) % 5 AS INT) AS fold
  FROM labelled)"""


def _stump() -> GBTClassifier:
    return GBTClassifier(labelCol="target", featuresCol="features", maxIter=1, maxDepth=1, seed=42)


def _stump_sql(mean: str) -> str:
    """The first boosted tree holds the mean of labels -1 and 1; its logit is twice that."""
    return rounded_sql(f"1.0e0 / (1.0e0 + exp(-2.0e0 * (2.0e0 * ({mean}) - 1.0e0)))")


def _several_orders(spark, sf_dir):
    """(id, target, several, fold) of every customer with orders: whether the last month has more than one."""
    several = (F.max_by("n", "ind") > 1).cast("int").alias("several")
    labelled = orders_panel(spark, sf_dir).groupBy("id").agg(several).join(customer_target(spark, sf_dir), "id")
    return labelled.join(stratified_folds(labelled.select("id", "target"), "id", "target", FOLDS).select("id", "fold"), "id")


SEVERAL_ORDERS = f"""{ORDERS_PANEL}, labelled AS (
  SELECT p.id, CAST(arg_max(n, ind) > 1 AS INT) AS several, CAST(any_value(c_acctbal) < 0 AS INT) AS target
  FROM panel p JOIN customer ON c_custkey = p.id GROUP BY p.id), {FOLDS_SQL}"""


@R.query(
    f"""WITH {SEVERAL_ORDERS}, sums AS (
      SELECT several, fold, sum(target) AS t, count(*) AS n, sum(sum(target)) OVER (PARTITION BY several) AS all_t,
        sum(count(*)) OVER (PARTITION BY several) AS all_n FROM folds GROUP BY 1, 2)
    SELECT id, fold, {_stump_sql("(all_t - t) / CAST(all_n - n AS DOUBLE)")} AS prediction
    FROM folds JOIN sums USING (several, fold)"""
)
def cross_fit_stump(spark, sf_dir):
    """Out-of-fold probability of every customer, the feature declared a category."""
    vectors = feature_vectors(_several_orders(spark, sf_dir), ["id", "target", "fold"], [], ["several"])
    fitted = cross_fit(vectors, _stump(), "id", "target", FOLDS)
    return fitted.oof.select("id", "fold", rounded("prediction").alias("prediction"))


STUMP_LOSS = FocalLoss(gamma=2.0, alpha=0.3)
_SLOPE = "(2.0e0 * 0.5e0 * ln(0.5e0) - 0.5e0)"
_STEP = f"CASE WHEN target = 1 THEN -0.3e0 ELSE 0.7e0 END * 0.25e0 * {_SLOPE}"
_CURVE = f"CASE WHEN target = 1 THEN 0.3e0 ELSE 0.7e0 END * (-{_SLOPE} + 0.25e0 * (2.0e0 * ln(0.5e0) + 3.0e0)) * 0.25e0"


@R.query(
    f"""WITH {SEVERAL_ORDERS}, sums AS (
      SELECT several, fold, sum({_STEP}) AS g, sum({_CURVE}) AS h, sum(sum({_STEP})) OVER (PARTITION BY several) AS all_g,
        sum(sum({_CURVE})) OVER (PARTITION BY several) AS all_h FROM folds GROUP BY 1, 2)
    SELECT id, fold, {rounded_sql("0.5e0 * (all_g - g) / (all_h - h)")} AS margin
    FROM folds JOIN sums USING (several, fold)"""
)
def focal_stump(spark, sf_dir):
    """Out-of-fold margin of one Newton round, half a step long."""
    rows = _several_orders(spark, sf_dir)
    arrays = rows.select("id", "target", "fold", feature_array(rows, ["several"]).alias("features"))
    params = BoostParams(rounds=1, max_depth=1, learning_rate=0.5, l2=0.0, min_rows=1, min_gain=-math.inf)
    fitted = cross_fit_focal(arrays, STUMP_LOSS, "id", "target", FOLDS, params=params, init_score=0.0)
    return fitted.select("id", "fold", rounded("margin").alias("margin"))


@R.query(
    f"""WITH {USER_DAY_PANEL}, labelled AS (
      SELECT id, CAST(max(CAST(ind = 13 AND buy IS NOT NULL AS INT)) AS INT) AS target,
        1 - CAST(max(CAST(ind = 12 AS INT)) AS INT) AS gone FROM panel GROUP BY id), {FOLDS_SQL},
    sums AS (
      SELECT gone, fold, sum(target) AS t, count(*) AS n, sum(sum(target)) OVER (PARTITION BY gone) AS all_t,
        sum(count(*)) OVER (PARTITION BY gone) AS all_n, sum(sum(target)) OVER () - sum(sum(target)) OVER (PARTITION BY fold) AS other_t,
        sum(count(*)) OVER () - sum(count(*)) OVER (PARTITION BY fold) AS other_n FROM folds GROUP BY 1, 2),
    fitted AS (SELECT *, CASE WHEN all_n > n THEN (all_t - t) / CAST(all_n - n AS DOUBLE) ELSE other_t / CAST(other_n AS DOUBLE) END AS mean FROM sums)
    SELECT id, {_stump_sql("mean")} AS missing_statement_feature FROM folds JOIN fitted USING (gone, fold)"""
)
def null_sequence_stump(spark, sf_dir):
    """The stacked feature of every user from one slot: no row on the day before the last."""
    panel, target = _buyers(spark, sf_dir)
    folds = stratified_folds(target, "id", "target", FOLDS)
    sequences = null_sequences(panel.filter(F.col("ind") < 13), "id", ["buy"], "statement", periods=[12])
    name = "missing_statement_feature"
    stacked, _ = stack_null_sequences(sequences, None, folds, _stump(), "id", "target", FOLDS, name, absent=1)
    return stacked.select("id", rounded(name).alias(name))


@R.query()
def recursive_selection(spark, sf_dir):
    """All features, the ordered priority codes as numbers, by Shapley values and by the change of the hold-out loss."""
    rows = checkpoint_frame(_train_arrays(spark, sf_dir))
    held = in_holdout("id")
    params = BoostParams(rounds=SELECTION_ROUNDS, max_depth=3, max_leaves=8, learning_rate=0.3)
    kept = select_recursively(rows.filter(~held), "target", "id", FEATURES, params, None, SELECTED, STEPS, ("shap", "loss"), rows.filter(held))
    chosen = [(by, size, i, name) for by, sizes in kept.items() for size, names in sizes.items() for i, name in enumerate(names)]
    return spark.createDataFrame(chosen, "criterion STRING, target INT, pos INT, feature STRING")


@R.query()
def cv_check(spark, sf_dir):
    """Per fold the rank metric and loss of the best round."""
    params = BoostParams(rounds=5 * TREES, max_depth=6, max_leaves=63, l2=70.0, min_hessian=8.0, min_rows=1, column_share=0.6, row_share=0.9, patience=TREES)
    report = check_features(_train_arrays(spark, sf_dir), params, "id", "target", FOLDS)
    return report.select("fold", rounded("metric").alias("metric"), rounded("log_loss").alias("log_loss"), "trees")
