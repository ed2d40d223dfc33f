"""Boosted trees as plain arrays: scoring, staged margins, Shapley values."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from panelspark.operators.binning import as_array, matrix

LEAF = -1
#: Splits of a tree up to which its Shapley values are computed once for all rows that go the same way.
PATTERN = 12


@dataclass
class Tree:
    """Node i splits ``feature[i]`` (-1: a leaf): values up to ``threshold[i]`` go left, missing ones where ``missing_left`` says.

    ``value`` is a leaf's step before the learning rate, ``cover`` the rows that reached a node, ``gain`` a split's.
    Children come after their parents.
    """

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        """A new leaf's number."""
        for name, x in zip(("feature", "threshold", "bin", "missing_left", "left", "right", "value", "cover", "gain"), (LEAF, 0.0, 0, False, -1, -1, value, cover, 0.0), strict=True):
            getattr(self, name).append(x)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, threshold: float, at: int, missing_left: bool, gain: float, left: int, right: int) -> None:
        self.feature[node], self.threshold[node], self.bin[node] = feature, threshold, at
        self.missing_left[node], self.gain[node], self.left[node], self.right[node] = missing_left, gain, left, right

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row of values (missing: NaN) reaches."""
        return self._descend(len(x), lambda node, rows: np.where(np.isnan(x[rows, self.feature[node]]), self.missing_left[node], x[rows, self.feature[node]] <= self.threshold[node]))

    def binned_leaves(self, codes: np.ndarray, missing: int) -> np.ndarray:
        """The leaf that each row of bin codes reaches."""
        return self._descend(len(codes), lambda node, rows: np.where(codes[rows, self.feature[node]] == missing, self.missing_left[node], codes[rows, self.feature[node]] <= self.bin[node]))

    def coded_leaves(self, codes: Mapping[int, np.ndarray], n: int, missing: int) -> np.ndarray:
        """``binned_leaves`` of ``n`` rows' codes by feature, as the smallest unsigned numbers that hold them.

        All rows go through every split, from the last to the first: a step is one pass over bytes that lie together.
        """
        kind = np.min_scalar_type(len(self.feature))
        at: dict[int, np.ndarray] = {}
        for node in range(len(self.feature) - 1, -1, -1):
            if self.feature[node] == LEAF:
                at[node] = np.array([node], dtype=kind)
                continue
            column = codes[self.feature[node]]
            left = column <= self.bin[node]
            if self.missing_left[node]:
                left |= column == missing
            low, high = at.pop(self.left[node]), at.pop(self.right[node])
            at[node] = high + left.astype(kind) * (low - high)  # wraps around to low
        return np.broadcast_to(at[0], n)

    def _descend(self, n: int, goes_left: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
        at = np.zeros(n, dtype=np.int64)
        for node, feature in enumerate(self.feature):
            if feature != LEAF:
                rows = np.flatnonzero(at == node)
                at[rows] = np.where(goes_left(node, rows), self.left[node], self.right[node])
        return at

    def steps(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(x)]

    def paths(self) -> Iterator[tuple[float, list[tuple[int, bool]]]]:
        """Each leaf's value and the (node, went left) steps to it."""
        stack: list[tuple[int, list[tuple[int, bool]]]] = [(0, [])]
        while stack:
            node, path = stack.pop()
            if self.feature[node] == LEAF:
                yield self.value[node], path
            else:
                stack += [(self.left[node], [*path, (node, True)]), (self.right[node], [*path, (node, False)])]

    def shapley(self, x: np.ndarray, out: np.ndarray, weight: float) -> float:
        """Add ``weight`` times the Shapley values of the tree to ``out`` and return weight times its expected value.

        A feature that is not in a coalition sends a row down both sides in proportion to their covers. A
        leaf's share of the game is then a product over the features on its path: one if the row satisfies
        all of a feature's splits, or the product of their cover shares. Coalition sizes are summed by one
        polynomial per leaf, whose factor of a feature is (share + satisfied * t).
        """
        splits = [node for node, feature in enumerate(self.feature) if feature != LEAF]
        x_goes_left = {}
        for node in splits:
            values = x[:, self.feature[node]]
            x_goes_left[node] = np.where(np.isnan(values), self.missing_left[node], values <= self.threshold[node])
        n, pattern = len(x), None
        if len(splits) <= PATTERN and 1 << len(splits) < n:  # rows that go the same way at every split have the same values
            code = np.zeros(n, dtype=np.intp)
            for i, node in enumerate(splits):
                code |= x_goes_left[node].astype(np.intp) << i
            seen = np.flatnonzero(np.bincount(code, minlength=1 << len(splits)))
            place = np.zeros(1 << len(splits), dtype=np.intp)
            place[seen] = np.arange(len(seen))
            n, pattern = len(seen), place[code]
            x_goes_left = {node: (seen >> i) & 1 == 1 for i, node in enumerate(splits)}
        shares: dict[int, np.ndarray] = {}
        expected = 0.0
        for value, path in self.paths():
            satisfied: dict[int, np.ndarray] = {}
            share: dict[int, float] = {}
            for node, left in path:
                feature = self.feature[node]
                ok = x_goes_left[node] if left else ~x_goes_left[node]
                satisfied[feature] = satisfied[feature] & ok if feature in satisfied else ok
                child = self.left[node] if left else self.right[node]
                share[feature] = share.get(feature, 1.0) * (self.cover[child] / self.cover[node] if self.cover[node] else 0.5)
            expected += value * float(np.prod(list(share.values())))
            players = list(share)
            m = len(players)
            if not m or value == 0.0:
                continue
            coalitions = [1.0 / m]  # (size)! (m - 1 - size)! / m! by the size of a coalition without the player
            for size in range(1, m):
                coalitions.append(coalitions[-1] * size / (m - size))
            before = [np.ones((1, n))]
            for player in players[:-1]:
                before.append(_times(before[-1], share[player], satisfied[player]))
            after = [np.ones((1, n))]
            for player in players[:0:-1]:
                after.append(_times(after[-1], share[player], satisfied[player]))
            for i, player in enumerate(players):
                others = np.zeros((m, n))
                for j, left_part in enumerate(before[i]):
                    others[j : j + len(after[m - 1 - i])] += left_part * after[m - 1 - i]
                own = weight * value * (satisfied[player] - share[player]) * (np.array(coalitions) @ others)
                shares[player] = shares[player] + own if player in shares else own
        for player, own in shares.items():
            out[:, player] += own if pattern is None else own[pattern]
        return weight * expected


def _times(polynomial: np.ndarray, share: float, satisfied: np.ndarray) -> np.ndarray:
    """Times (share + satisfied * t), per row."""
    out = np.zeros((len(polynomial) + 1, polynomial.shape[1]))
    out[:-1] += share * polynomial
    out[1:] += satisfied * polynomial
    return out


@dataclass
class Forest:
    """A start score plus weighted trees; margins are on the scale of log odds."""

    init_score: float
    trees: list[Tree]
    weights: list[float]

    def first(self, rounds: int) -> Forest:
        """The model as it was after so many rounds, if later ones did not change its weights."""
        return Forest(self.init_score, self.trees[:rounds], self.weights[:rounds])

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.init_score)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            out += weight * tree.steps(x)
        return out

    def staged(self, x: np.ndarray) -> np.ndarray:
        """Margins after each round, one column a round."""
        out = np.full((len(x), len(self.trees) + 1), self.init_score)
        for i, (tree, weight) in enumerate(zip(self.trees, self.weights, strict=True)):
            out[:, i + 1] = out[:, i] + weight * tree.steps(x)
        return out[:, 1:]

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """One column per feature and the expected margin last; a row sums to its margin."""
        out = np.zeros((len(x), x.shape[1] + 1))
        out[:, -1] = self.init_score
        for tree, weight in zip(self.trees, self.weights, strict=True):
            out[:, -1] += tree.shapley(x, out, weight)
        return out

    def importances(self, features: int) -> np.ndarray:
        """Each feature's share of all gain."""
        gains = np.zeros(features)
        for tree in self.trees:
            split = np.array(tree.feature) != LEAF
            np.add.at(gains, np.array(tree.feature)[split], np.array(tree.gain)[split])
        return gains / gains.sum() if gains.sum() else gains


def _rows_of(column: pd.Series) -> np.ndarray:
    return np.array([[np.nan if v is None else v for v in row] for row in column], dtype=np.float64)


def margin_column(df: DataFrame, forest: Forest, features: str = "features") -> Column:
    """A row's margin."""

    @pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        return pd.Series(forest.margins(_rows_of(column)) if len(column) else [], dtype=float)

    return score(as_array(df, features))


def staged_column(df: DataFrame, forest: Forest, features: str = "features") -> Column:
    """A row's margins after each round, as one array."""

    @pandas_udf("array<double>")
    def score(column: pd.Series) -> pd.Series:
        return pd.Series(list(forest.staged(_rows_of(column))) if len(column) else [], dtype=object)

    return score(as_array(df, features))


def shapley_column(df: DataFrame, forest: Forest, features: str = "features") -> Column:
    """A row's Shapley values, one per feature and the expected margin last."""

    @pandas_udf("array<double>")
    def score(column: pd.Series) -> pd.Series:
        return pd.Series(list(forest.shapley(_rows_of(column))) if len(column) else [], dtype=object)

    return score(as_array(df, features))


def shapley_sums(df: DataFrame, forest: Forest, label: str, loss: Callable[[np.ndarray, np.ndarray], np.ndarray], features: str = "features") -> DataFrame:
    """(feature, importance, loss_change, rows) over all rows: the mean size of a feature's Shapley value, and how much the
    mean loss rises when it is taken from the margin."""
    return shapley_sums_of(df, [forest], label, loss, features).drop("model")


def shapley_sums_of(df: DataFrame, forests: Sequence[Forest], label: str, loss: Callable[[np.ndarray, np.ndarray], np.ndarray], features: str = "features") -> DataFrame:
    """``shapley_sums`` of several forests, with their place in the list as ``model``.

    One scoring pass; a task adds up its rows, so one row per task, forest and feature is shuffled.
    """
    rows = df.select(F.col(label).cast("double").alias("y"), as_array(df, features).alias("x"))

    used = [sorted({f for tree in forest.trees for f in tree.feature if f != LEAF}) for forest in forests]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            y, x = batch["y"].to_numpy(zero_copy_only=False), matrix(batch["x"])
            new = np.zeros((2, len(forests), x.shape[1]))
            for m, forest in enumerate(forests):
                values = forest.shapley(x)
                margin, parts = values.sum(axis=1), values[:, :-1]
                base = loss(y, margin)
                new[0, m] = np.abs(parts).sum(axis=0)
                for f in used[m]:  # the values of the others are zero
                    new[1, m, f] = (loss(y, margin - parts[:, f]) - base).sum()
            sums, n = new if sums is None else sums + new, n + len(y)
        if sums is not None:
            model, feature = (at.ravel() for at in np.indices(sums.shape[1:], dtype=np.int32))
            columns = [pa.array(model), pa.array(feature), pa.array(sums[0].ravel()), pa.array(sums[1].ravel()), pa.array([n] * len(model), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["model", "feature", "size", "change", "n"])

    parts = rows.mapInArrow(summed, "model int, feature int, size double, change double, n long").groupBy("model", "feature")
    total = parts.agg(F.sum("size").alias("size"), F.sum("change").alias("change"), F.sum("n").alias("rows"))
    return total.select("model", "feature", (F.col("size") / F.col("rows")).alias("importance"), (F.col("change") / F.col("rows")).alias("loss_change"), "rows")


def rounds_of(staged: DataFrame, keep: Sequence[str], column: str = "staged") -> DataFrame:
    """One row per row and round (from 1): (round, keep..., margin)."""
    return staged.select(*keep, F.posexplode(column).alias("round", "margin")).withColumn("round", F.col("round") + 1)

