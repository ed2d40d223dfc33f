"""Rank metrics, classification losses and importance reports.

Labels are 0/1. Negatives weigh 20, which undoes their subsampling. Rows with equal scores are
ordered by id, descending.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.losses import FocalLoss, log_loss
from panelspark.functions.numeric import sigmoid
from panelspark.operators.ranking import average_rank, running_total, tie_groups
from panelspark.operators.skew import join_totals

# Fixed values of the metric.
NEGATIVE_WEIGHT = 20
CAPTURE_SHARE = 0.04
TOP_IMPORTANCES = 40


def row_weight(label: str) -> Column:
    return F.when(F.col(label) == 0, F.lit(NEGATIVE_WEIGHT)).otherwise(F.lit(1)).cast("long")


def weight_curve(df: DataFrame, label: str, score: str, id_col: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Rows with the running weight and running positives, best score first."""
    rows = df.select(*partition_by, id_col, score, F.col(label).cast("int").alias(label))
    return running_total(
        rows.withColumn("weight", row_weight(label)),
        [F.col(score).desc(), F.col(id_col).desc()],
        {"cum_weight": F.col("weight"), "cum_pos": F.col(label).cast("long")},
        partition_by,
    )


def rank_metrics(df: DataFrame, label: str, score: str, id_col: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Top capture, normalized weighted Gini and their mean ``metric``, one row per partition.

    The Gini sum splits into two sums that need no totals, and its value under the perfect
    ordering is closed-form, so one ordering serves everything.
    """
    parts = list(partition_by)
    curve = weight_curve(df, label, score, id_col, parts)
    totals = curve.groupBy(*parts).agg(
        F.sum("weight").alias("__w"), F.count(F.lit(1)).alias("__rows")
    )
    limit = F.floor(F.lit(CAPTURE_SHARE) * F.col("__w"))
    if parts:
        limited = join_totals(curve, totals.select(*parts, "__rows", limit.alias("__limit")), parts, "__rows")
    else:
        limited = curve.withColumn("__limit", totals.select(limit).scalar())
    weight = F.col("weight").cast("double")
    sums = limited.groupBy(*parts).agg(
        F.sum("weight").cast("double").alias("w"),
        F.sum(F.col(label)).cast("double").alias("p"),
        F.sum(F.when(F.col("cum_weight") <= F.col("__limit"), F.col(label)).otherwise(0)).alias("captured"),
        F.sum(F.col("cum_pos") * weight).alias("pos_area"),
        F.sum(F.col("cum_weight") * weight).alias("weight_area"),
    )
    w, p = F.col("w"), F.col("p")
    n = (w - p) / NEGATIVE_WEIGHT
    area = F.col("pos_area") / F.nullif(p, F.lit(0.0)) - F.col("weight_area") / F.nullif(w, F.lit(0.0))
    scored = sums.select(
        *parts,
        (F.col("captured") / F.nullif(p, F.lit(0.0))).alias("capture"),
        (area / F.nullif(perfect_area(p, n), F.lit(0.0))).alias("gini"),
    )
    return scored.withColumn("metric", F.lit(0.5) * (F.col("gini") + F.col("capture")))


def perfect_area(positives: Column, negatives: Column) -> Column:
    """Gini area when all positives come first."""
    k = F.lit(float(NEGATIVE_WEIGHT))
    total = positives + k * negatives
    over_positives = (positives + 1) / 2 * (F.lit(1.0) - positives / total)
    over_negatives = k * k / 2 * negatives * (negatives - 1) / total
    return over_positives + over_negatives


def metric_by_fold(df: DataFrame, label: str, score: str, id_col: str, fold: str = "fold") -> DataFrame:
    """The metric of each fold, the mean over folds, and over all rows: (scope, fold, metric)."""
    per_fold = rank_metrics(df, label, score, id_col, [fold]).select(
        F.lit("fold").alias("scope"), F.col(fold).cast("int").alias("fold"), "metric"
    )
    mean = per_fold.agg(F.avg("metric").alias("metric")).select(
        F.lit("mean").alias("scope"), F.lit(None).cast("int").alias("fold"), "metric"
    )
    overall = rank_metrics(df, label, score, id_col).select(
        F.lit("all").alias("scope"), F.lit(None).cast("int").alias("fold"), "metric"
    )
    return per_fold.unionByName(mean).unionByName(overall)


def auc(df: DataFrame, label: str, score: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from tie-averaged ranks, over distinct scores only."""
    positive = F.col(label).cast("long")
    groups = tie_groups(df, score, partition_by, positives=F.sum(positive))
    sums = groups.groupBy(*partition_by).agg(
        F.sum("ties").cast("double").alias("n"),
        F.sum("positives").cast("double").alias("p"),
        F.sum(F.col("positives") * average_rank()).alias("rank_sum"),
    )
    p, negatives = F.col("p"), F.col("n") - F.col("p")
    value = (F.col("rank_sum") - p * (p + 1) / 2) / F.nullif(p * negatives, F.lit(0.0))
    return sums.select(*partition_by, value.alias("auc"))


def mean_log_loss(df: DataFrame, label: str, probability: str) -> DataFrame:
    return df.agg(F.avg(log_loss(label, probability)).alias("log_loss"))


def auc_log_loss(df: DataFrame, label: str, probability: str) -> DataFrame:
    """AUC and mean log loss as one row."""
    return mean_log_loss(df, label, probability).withColumn("auc", auc(df, label, probability).scalar())


def mean_focal_loss(df: DataFrame, label: str, raw_score: str, loss: FocalLoss) -> DataFrame:
    """Mean focal loss of raw scores, which the sigmoid turns into probabilities."""
    return df.agg(F.avg(loss.loss(F.col(label), sigmoid(raw_score))).alias("focal_loss"))


def focal_init_score(df: DataFrame, label: str, loss: FocalLoss) -> DataFrame:
    """Log-odds of the constant probability with the least total focal loss.

    Counts by label are all that the data contributes. Ten thousand probabilities are tried,
    then a hundred times finer around the best.
    """
    counts = df.groupBy().agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("n1"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n0"),
    )
    coarse = _best_probability(
        counts.select("n1", "n0", F.explode(F.sequence(F.lit(1), F.lit(9999))).alias("i")),
        F.col("i") / F.lit(10000.0),
        loss,
    )
    fine = _best_probability(
        coarse.select("n1", "n0", "p", F.explode(F.sequence(F.lit(-99), F.lit(99))).alias("i")),
        F.col("p") + F.col("i") / F.lit(1000000.0),
        loss,
    )
    return fine.select(F.col("p").alias("best_p"), F.log(F.col("p") / (F.lit(1.0) - F.col("p"))).alias("init_score"))


def _best_probability(candidates: DataFrame, probability: Column, loss: FocalLoss) -> DataFrame:
    p = F.col("__p")
    total = F.col("n1") * loss.loss(F.lit(1), p) + F.col("n0") * loss.loss(F.lit(0), p)
    return (
        candidates.withColumn("__p", probability)
        .withColumn("__total", total)
        .groupBy("n1", "n0")
        .agg(F.min_by("__p", F.struct("__total", "__p")).alias("p"))
    )


def top_importances(
    importances: DataFrame, feature: str = "feature", importance: str = "importance", top: int = TOP_IMPORTANCES
) -> DataFrame:
    """Mean importance per feature over folds, the ``top`` greatest first."""
    means = importances.groupBy(feature).agg(F.avg(importance).alias(importance))
    return means.orderBy(F.desc(importance), feature).limit(top)


class RankMetricEvaluator(Evaluator):
    """The combined metric for ``pyspark.ml`` tuning; larger is better.

    ``scoreCol`` may be a probability vector, whose second element counts, or a number.
    """

    name = "rank_metric"

    def __init__(self, labelCol: str = "label", scoreCol: str = "probability", idCol: str = "id") -> None:
        super().__init__()
        self.labelCol, self.scoreCol, self.idCol = labelCol, scoreCol, idCol

    def _evaluate(self, dataset: DataFrame) -> float:
        is_number = dict(dataset.dtypes)[self.scoreCol] in ("double", "float")
        score = F.col(self.scoreCol) if is_number else vector_to_array(self.scoreCol)[1]
        rows = dataset.select(self.idCol, F.col(self.labelCol).alias("y"), score.alias("s"))
        return rank_metrics(rows, "y", "s", self.idCol).first()["metric"]

    def isLargerBetter(self) -> bool:
        return True
