"""Cross-fitting a model, ranking its predictions and scoring them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame

from panelspark.operators.blend import fold_rank, fold_rank_average
from panelspark.operators.metrics import metric_by_fold
from panelspark.operators.models import cross_fit
from panelspark.session import checkpoint_frame


@dataclass
class ScoredModel:
    """``oof``: (id, label, fold, prediction) with ranks within the fold. ``test``: (id, prediction)
    with the mean rank over fold models, or None. ``report``: the metric by fold, their mean, and overall.
    """

    oof: DataFrame
    test: DataFrame | None
    report: DataFrame
    models: list[Model]


def score_model(
    vectors: DataFrame, estimator: Estimator, id_col: str, label: str, folds: int, test: DataFrame | None = None
) -> ScoredModel:
    """Cross-fit, replace predictions by percent ranks, and evaluate the out-of-fold ranks.

    ``vectors`` has the id, label, ``fold`` and features; ``test`` the id and features.
    Predictions are checkpointed, since ranking and scoring read them several times.
    """
    fitted = cross_fit(vectors, estimator, id_col, label, folds, test=test)
    predictions = checkpoint_frame(fitted.oof)
    ranks = fold_rank(predictions, id_col).drop("fold")
    oof = predictions.drop("prediction").join(ranks, id_col)
    averaged = fold_rank_average(checkpoint_frame(fitted.test), id_col) if fitted.test is not None else None
    return ScoredModel(oof, averaged, metric_by_fold(oof, label, "prediction", id_col), fitted.models)
