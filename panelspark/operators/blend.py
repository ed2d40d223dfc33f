"""Combining predictions by percent rank."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.ranking import percent_rank


def fold_rank_average(
    predictions: DataFrame, id_col: str, score: str = "prediction", fold: str = "fold"
) -> DataFrame:
    """Mean over fold models of an id's percent rank within that model's predictions."""
    rows = predictions.select(id_col, fold, score)
    ranked = percent_rank(rows, score, "__rank", [fold])
    return ranked.groupBy(id_col).agg(F.avg("__rank").alias(score))


def fold_rank(predictions: DataFrame, id_col: str, score: str = "prediction", fold: str = "fold") -> DataFrame:
    """Out-of-fold predictions replaced by their percent rank within the fold."""
    ranked = percent_rank(predictions.select(id_col, fold, score), score, "__rank", [fold])
    return ranked.select(id_col, fold, F.col("__rank").alias(score))


def rank_blend(
    models: Mapping[str, DataFrame],
    weights: Mapping[str, float],
    id_col: str,
    score: str = "prediction",
) -> DataFrame:
    """Weighted sum of percent ranks over the ids that every model scored.

    The models are stacked and ranked in one pass, partitioned by model.
    """
    if set(models) != set(weights):
        raise ValueError("models and weights must have the same names")
    stacked = reduce(
        lambda a, b: a.unionByName(b),
        [df.select(id_col, score, F.lit(name).alias("__model")) for name, df in models.items()],
    )
    ranked = percent_rank(stacked, score, "__rank", ["__model"])
    # One column per model, then a sum in model order: adding up rows in the order they arrive
    # would let equal blends differ in the last bit, and a later ranking would part them.
    columns = {name: f"__rank{i}" for i, name in enumerate(weights)}
    by_id = ranked.groupBy(id_col).agg(
        *[F.max(F.when(F.col("__model") == name, F.col("__rank"))).alias(c) for name, c in columns.items()]
    )
    terms = [F.lit(float(weights[name])) * F.col(c) for name, c in columns.items()]
    blended = by_id.select(id_col, reduce(lambda a, b: a + b, terms).alias(score))
    return blended.filter(F.col(score).isNotNull())


def rank_blend_chain(
    base: DataFrame,
    steps: Sequence[tuple[DataFrame, float]],
    id_col: str,
    score: str = "prediction",
) -> DataFrame:
    """Blend further predictions in one after the other, ranking the result so far each time.

    Every step is (predictions, weight); the result so far keeps the remaining weight.
    """
    blended = base
    for other, weight in steps:
        models = {"base": blended, "other": other}
        blended = rank_blend(models, {"base": 1.0 - weight, "other": weight}, id_col, score)
    return blended
