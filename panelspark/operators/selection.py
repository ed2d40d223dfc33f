"""Recursive feature elimination by Shapley values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame

from panelspark.functions.losses import FocalLoss, LogLoss
from panelspark.operators.binning import quantile_cuts
from panelspark.operators.boosting import BoostParams, binned_rows, boost_rows, in_blocks, in_large_parts, narrowed
from panelspark.operators.forest import shapley_sums_of
from panelspark.session import checkpoint_frame

# Fixed values of the selection.
TARGETS = (2500, 1500, 500)
STEPS = 10
CRITERIA = ("shap", "loss", "importance")
#: Share of the features of the binned rows from which the others are no longer carried along.
NARROWER = 0.75


def recursive_selection(
    train: DataFrame,
    label: str,
    id_col: str,
    names: Sequence[str],
    params: BoostParams | None = None,
    loss: LogLoss | FocalLoss | None = None,
    targets: Sequence[int] = TARGETS,
    steps: int = STEPS,
    by: str | Sequence[str] = "shap",
    holdout: DataFrame | None = None,
    features: str = "features",
    init_score: float | None = None,
) -> dict[int, list[str]] | dict[str, dict[int, list[str]]]:
    """Feature names kept for each target size, best first; each target starts from the last one.

    The feature column holds ``names`` in order and is binned once; every step grows trees on the features that are
    left and drops the lowest-ranked share. ``by`` is ``shap`` (mean size of the Shapley values on the hold-out rows,
    or the training rows without any), ``loss`` (how much the mean hold-out loss rises when a feature's Shapley value
    is taken from the margin) or ``importance`` (gain of the splits). A step scores each row once for all
    features, so no row is copied per feature. Given several criteria, each one's result is returned by its name: their
    models of a step are grown and scored by the same jobs, those on equal features once.
    """
    criteria = [by] if isinstance(by, str) else list(dict.fromkeys(by))
    for criterion in criteria:
        if criterion not in CRITERIA:
            raise ValueError(f"by must be one of {CRITERIA}, not {criterion!r}")
    if "loss" in criteria and holdout is None:
        raise ValueError("selection by loss needs a hold-out frame")
    params, loss = params or BoostParams(), loss or LogLoss()
    train = checkpoint_frame(train.select(id_col, label, features))
    cuts = quantile_cuts(train, features, bins=params.bins)
    rows = in_blocks(binned_rows(train, label, id_col, cuts, features=features), len(cuts)).persist()
    scoring = None if criteria == ["importance"] else in_large_parts(train if holdout is None else checkpoint_frame(holdout.select(label, features)))
    kept = {criterion: list(range(len(names))) for criterion in criteria}
    selected: dict[str, dict[int, list[str]]] = {criterion: {} for criterion in criteria}
    left = stored = len(names)  # features of every criterion, and of the rows
    for target in targets:
        surplus = max(left - target, 0)
        for step in range(steps):
            excess = left - target
            if excess <= 0 and step:
                break
            drop = max(min(math.ceil(surplus / steps), excess), 0)
            sets = list(dict.fromkeys(tuple(sorted(kept[criterion])) for criterion in criteria))
            used = set().union(*sets)
            if len(used) <= NARROWER * stored:
                wider, rows, stored = rows, narrowed(rows, used).persist(), len(used)
                wider.unpersist()
            forests = boost_rows(rows, cuts, loss, params, init_score=init_score, allowed=sets).forests
            init_score = forests[0].init_score  # the same rows in every step
            found = {} if scoring is None else {(r["model"], r["feature"]): r for r in shapley_sums_of(scoring, forests, label, loss.values, features).collect()}
            for criterion in criteria:
                model = sets.index(tuple(sorted(kept[criterion])))
                if criterion == "importance":
                    scores = dict(enumerate(forests[model].importances(len(names)).tolist()))
                else:
                    column = "importance" if criterion == "shap" else "loss_change"
                    scores = {f: r[column] for (m, f), r in found.items() if m == model}
                ranked = sorted(kept[criterion], key=lambda f, scores=scores: (-scores.get(f, 0.0), f))
                kept[criterion] = ranked[: len(ranked) - drop]
            left -= drop
        for criterion in criteria:
            selected[criterion][target] = [names[f] for f in kept[criterion]]
    rows.unpersist()
    return selected[by] if isinstance(by, str) else selected
