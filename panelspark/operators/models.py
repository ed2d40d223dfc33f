"""Cross-fitted models: out-of-fold predictions, focal boosting, stacking, checks.

Any Spark ML classifier can be cross-fitted; boosted trees of all folds are grown side by side.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.losses import FocalLoss, LogLoss, log_loss
from panelspark.functions.numeric import nan_to_null, quoted
from panelspark.operators.boosted_models import HistogramBooster, HistogramBoosterModel
from panelspark.operators.boosting import BoostParams, boost, fold_margins
from panelspark.operators.metrics import rank_metrics
from panelspark.operators.panel import LAST_INDEX
from panelspark.session import checkpoint_frame

FINITE_BOUND = 1e12
WORD_BITS = 62


def feature_vectors(
    df: DataFrame,
    keep: Sequence[str],
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    indicators: bool = True,
    fill: float = 0.0,
    output: str = "features",
) -> DataFrame:
    """Assemble a vector without nulls, NaN or infinities, next to the ``keep`` columns.

    Missing numbers become ``fill`` plus an indicator, infinities are capped. Categoricals are
    codes from -1 on; they are shifted to start at 0 and declared nominal, so that trees split
    them as categories. The number of codes is read with one aggregation.
    """
    cells: list[Column] = []
    for c in numeric:
        value = nan_to_null(F.col(c).cast("double"))
        capped = F.least(F.greatest(value, F.lit(-FINITE_BOUND)), F.lit(FINITE_BOUND))
        cells.append(F.when(value.isNotNull(), capped).otherwise(F.lit(fill)).alias(f"__x{len(cells)}"))
        if indicators:
            cells.append(value.isNull().cast("double").alias(f"__x{len(cells)}"))
    if categorical:
        top = df.agg(*[F.max(c).alias(c) for c in categorical]).first()
        for c in categorical:
            codes = 2 if top[c] is None else max(int(top[c]) + 2, 2)
            nominal = {"ml_attr": {"type": "nominal", "num_vals": codes, "name": c}}
            code = (F.coalesce(F.col(c), F.lit(-1)) + 1).cast("double")
            cells.append(code.alias(f"__x{len(cells)}", metadata=nominal))
    assembler = VectorAssembler(inputCols=[f"__x{i}" for i in range(len(cells))], outputCol=output)
    return assembler.transform(df.select(*keep, *cells)).select(*keep, output)


@dataclass
class CrossFit:
    """``oof`` has (id, label, fold, prediction), each row scored by the model that never saw it.

    ``test`` has (id, fold, prediction), one row per id and fold model, or is None.
    """

    oof: DataFrame
    test: DataFrame | None
    models: list[Model]


def positive_probability(model: Model, df: DataFrame, keep: Sequence[str], name: str = "prediction") -> DataFrame:
    scored = model.transform(df)
    return scored.select(*keep, vector_to_array("probability")[1].alias(name))


def cross_fit(
    vectors: DataFrame,
    estimator: Estimator,
    id_col: str,
    label: str,
    folds: int,
    fold: str = "fold",
    test: DataFrame | None = None,
) -> CrossFit:
    """Fit on all folds but one, predict the one left out and the test frame, for each fold.

    ``vectors`` has the id, label, fold and the estimator's feature column. An estimator with bins gets as many
    as the largest category needs; for thousands of codes use ``ordered_target_statistics`` instead.
    """
    estimator = with_bins(estimator, vectors)
    rows = checkpoint_frame(vectors)
    scored_test = checkpoint_frame(test) if test is not None else None
    models, oof, predictions = [], [], []
    for k in range(folds):
        model = estimator.fit(rows.filter(F.col(fold) != k))
        models.append(model)
        oof.append(positive_probability(model, rows.filter(F.col(fold) == k), [id_col, label, fold]))
        if scored_test is not None:
            scored = positive_probability(model, scored_test, [id_col])
            predictions.append(scored.select(id_col, F.lit(k).alias(fold), "prediction"))
    return CrossFit(_stack(oof), _stack(predictions) if predictions else None, models)


def with_bins(estimator: Estimator, vectors: DataFrame) -> Estimator:
    """The estimator with as many bins as its largest category has codes, if it takes bins and has fewer."""
    if not estimator.hasParam("maxBins"):
        return estimator
    attributes = vectors.schema[estimator.getOrDefault("featuresCol")].metadata.get("ml_attr", {}).get("attrs", {})
    codes = max((a.get("num_vals", 0) for a in attributes.get("nominal", [])), default=0)
    bins = estimator.getParam("maxBins")
    return estimator.copy({bins: codes}) if codes > estimator.getOrDefault(bins) else estimator


def _stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def fit_focal_booster(
    df: DataFrame,
    label: str,
    loss: FocalLoss,
    id_col: str = "id",
    params: BoostParams | None = None,
    init_score: float | None = None,
    features: str = "features",
) -> HistogramBoosterModel:
    """Newton boosting on the logit of a focal loss: a leaf's step is sum(-g) / (sum(h) + L2).

    The focal hessian can be negative, so it is clamped. The start is the best constant unless given.
    """
    return HistogramBooster(params, loss, label, features, id_col, init_score).fit(df)


def cross_fit_boosted(
    df: DataFrame,
    loss: LogLoss | FocalLoss,
    id_col: str,
    label: str,
    folds: int,
    fold: str = "fold",
    params: BoostParams | None = None,
    init_score: float | None = None,
    test: DataFrame | None = None,
    features: str = "features",
) -> CrossFit:
    """``cross_fit`` of boosted trees with the folds side by side: bins are made once, and a level of all folds' trees is one job.

    ``oof`` has (id, label, fold, margin, prediction).
    """
    df = checkpoint_frame(df.select(id_col, label, fold, features))
    fitted = boost(df, label, id_col, loss, params, folds, fold, features, init_score)
    models = [HistogramBoosterModel(f, loss, features) for f in fitted.forests]
    oof = fold_margins(df, fitted.forests, [id_col, label, fold], fold, features)
    if test is None:
        return CrossFit(oof, None, models)
    every = test.withColumn("__model", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumnRenamed("__model", fold)
    scored = fold_margins(every, fitted.forests, [id_col, fold], fold, features)
    return CrossFit(oof, scored.select(id_col, fold, "prediction"), models)


def cross_fit_focal(
    df: DataFrame, loss: FocalLoss, id_col: str, label: str, folds: int, fold: str = "fold", **options
) -> DataFrame:
    """Out-of-fold raw scores and probabilities of focal boosting: (id, label, fold, margin, prediction)."""
    return cross_fit_boosted(df, loss, id_col, label, folds, fold, **options).oof


def null_sequences(
    panel: DataFrame,
    id_col: str,
    columns: Sequence[str],
    variant: str = "value",
    index: str = "ind",
    periods: Sequence[int] = range(1, LAST_INDEX + 1),
) -> DataFrame:
    """Per customer one 0/1 column ``{column}_{period}`` for every slot.

    ``value`` marks nulls of existing statements, so absent statements count 0; ``statement``
    marks the absent statements themselves. The slots of a column are the bits of one bit-or,
    so the dense grid is implied and never built.
    """
    if variant not in ("value", "statement"):
        raise ValueError(f"variant must be 'value' or 'statement', not {variant!r}")
    marked = {c: f"{quoted(c)} IS NULL" for c in columns} if variant == "value" else {"statement": "true"}
    words = [list(periods)[i : i + WORD_BITS] for i in range(0, len(periods), WORD_BITS)]
    masks, slots = [], []
    for c, mark in marked.items():
        for i, word in enumerate(words):
            mask = quoted(f"__{c}_{i}")
            bits = " ".join(f"WHEN {p} THEN {1 << position}L" for position, p in enumerate(word))
            masks.append(F.expr(f"coalesce(bit_or(IF({mark}, CASE {quoted(index)} {bits} END, NULL)), 0L) AS {mask}"))
            for position, p in enumerate(word):
                test = "<> 0" if variant == "value" else "= 0"
                slots.append(f"CAST({mask} & {1 << position}L {test} AS INT) AS {quoted(f'{c}_{p}')}")
    return panel.groupBy(id_col).agg(*masks).selectExpr(quoted(id_col), *slots)


def complete_sequences(ids: DataFrame, sequences: DataFrame, id_col: str, absent: int) -> DataFrame:
    """The rows of ``ids`` with their sequences; ``absent`` fills the slots of those that have none."""
    slots = [c for c in sequences.columns if c != id_col]
    joined = ids.join(sequences, id_col, "left")
    return joined.select(*ids.columns, *[F.coalesce(F.col(quoted(c)), F.lit(absent)).alias(c) for c in slots])


def null_sequence_stack(
    train: DataFrame,
    test: DataFrame | None,
    folds_frame: DataFrame,
    estimator: Estimator,
    id_col: str,
    label: str,
    folds: int,
    name: str,
    absent: int = 0,
) -> tuple[DataFrame, DataFrame | None]:
    """Stack a model of null sequences into one feature ``name`` per customer.

    ``train`` and ``test`` come from ``null_sequences``; ``folds_frame`` has (id, label, fold).
    Train customers get their out-of-fold prediction, test customers the mean over fold models.
    Every labelled customer gets one; those without a sequence have ``absent`` in all slots (0 for
    the ``value`` variant, 1 for ``statement``).
    """
    slots = [c for c in train.columns if c != id_col]
    labelled = complete_sequences(folds_frame, train, id_col, absent)
    vectors = feature_vectors(labelled, [id_col, label, "fold"], slots, indicators=False)
    test_vectors = feature_vectors(test, [id_col], slots, indicators=False) if test is not None else None
    fitted = cross_fit(vectors, estimator, id_col, label, folds, test=test_vectors)
    oof = fitted.oof.select(id_col, F.col("prediction").alias(name))
    if fitted.test is None:
        return oof, None
    return oof, fitted.test.groupBy(id_col).agg(F.avg("prediction").alias(name))


def cv_check(
    df: DataFrame,
    params: BoostParams,
    id_col: str,
    label: str,
    folds: int,
    fold: str = "fold",
    loss: LogLoss | FocalLoss | None = None,
    features: str = "features",
    init_score: float | None = None,
) -> DataFrame:
    """Cross-validated score of a feature set, stopped early by the rank metric on the fold left out.

    One row per fold: the rank metric and the log loss of the best round, and its number of trees. With
    ``params.patience`` 0 all rounds count.
    """
    df = checkpoint_frame(df.select(id_col, label, fold, features))
    fitted = boost(df, label, id_col, loss, params, folds, fold, features, init_score)
    scored = checkpoint_frame(fold_margins(df, fitted.forests, [id_col, label, fold], fold, features))
    metrics = rank_metrics(scored, label, "margin", id_col, [fold]).select(fold, "metric")
    losses = scored.groupBy(fold).agg(F.avg(log_loss(label, "prediction")).alias("log_loss"))
    trees = F.element_at(F.array(*[F.lit(len(f.trees)) for f in fitted.forests]), F.col(fold) + 1)
    return metrics.join(losses, fold).select(F.col(fold).cast("int").alias("fold"), "metric", "log_loss", trees.alias("trees"))
