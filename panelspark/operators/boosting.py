"""Gradient-boosted trees grown from histograms, for all folds or sets of features at once.

The binned matrix is made once and kept as blocks of rows, the codes of a feature next to each other. A level of
the trees of all models is one job: tasks add up gradients, hessians and rows by (model, node, feature, bin), and
blocks of features are reduced and searched for splits by one task each. Only split candidates reach the driver, one
per model, node and block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.losses import FocalLoss, LogLoss
from panelspark.functions.numeric import sigmoid
from panelspark.operators.binning import MAX_BINS, MISSING, as_array, binned, matrix, quantile_cuts, to_bins
from panelspark.operators.forest import LEAF, Forest, Tree
from panelspark.operators.metrics import rank_metrics
from panelspark.session import checkpoint_frame

MIN_HESSIAN = 1e-6
#: Features whose histograms are reduced by one task, and partial histograms that one task adds up.
BLOCK = 32
FAN_IN = 32
#: Histogram cells of all models that a task holds; a level with more is built in several passes.
CELLS = 1 << 24
#: Rows of a task at least, if there are as many: with fewer, the histograms it sends are larger than the codes it reads.
ROWS = 1 << 13
#: Tasks per core and rows of a task, up to which there are no more than these: more tasks only send more histograms.
TASKS = 3
MOST_ROWS = 1 << 18
#: Bytes of codes in a block of rows at most.
BLOCK_BYTES = 1 << 24
#: Gains that differ by less of their size are equal; the first feature, bin and direction count then.
TIE = 1e-9
SLOTS = MISSING + 1


@dataclass(frozen=True)
class BoostParams:
    """Of boosting: rounds, learning rate, drops. Of trees: depth, leaves, L2 on leaves, smallest leaf. Of samples: shares by hash.

    ``row_share`` of the rows are drawn anew every ``row_every`` rounds, ``column_share`` of the features for each tree.
    ``drop_rate`` makes it DART: before a round each earlier tree is left out with this chance (no tree at all with
    chance ``skip_drop``); with k left out, the new one counts 1 / (k + 1) and they count k / (k + 1) as much from
    then on. ``drop_sets`` states them by round instead. ``patience`` rounds without a better rank metric on
    the fold left out end training, and the best round is kept.
    """

    rounds: int = 100
    learning_rate: float = 0.1
    max_depth: int = 6
    max_leaves: int = 31
    l2: float = 1.0
    min_rows: int = 20
    min_hessian: float = 1e-3
    min_gain: float = 0.0
    column_share: float = 1.0
    row_share: float = 1.0
    row_every: int = 1
    drop_rate: float = 0.0
    skip_drop: float = 0.5
    drop_sets: tuple[tuple[int, ...], ...] | None = None
    patience: int = 0
    bins: int = MAX_BINS
    checkpoint_every: int = 10
    seed: int = 42

    @property
    def drops(self) -> bool:
        return self.drop_rate > 0 or self.drop_sets is not None


def uniform(*key: int | np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1 that depend on the key alone."""
    state = np.zeros(1, dtype=np.uint64)
    for part in key:
        state = (state ^ np.asarray(part, dtype=np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        state ^= state >> np.uint64(29)
        state *= np.uint64(0xBF58476D1CE4E5B9)
        state ^= state >> np.uint64(32)
    return (state >> np.uint64(11)).astype(np.float64) / 2.0**53


def drop_set(params: BoostParams, round_: int) -> tuple[int, ...]:
    """Earlier trees that are left out of a round."""
    if params.drop_sets is not None:
        return params.drop_sets[round_] if round_ < len(params.drop_sets) else ()
    if not params.drops or not round_ or uniform(params.seed, 1, round_)[0] < params.skip_drop:
        return ()
    return tuple(np.flatnonzero(uniform(params.seed, 2, round_, np.arange(round_)) < params.drop_rate).tolist())


def sampled_columns(params: BoostParams, round_: int, features: Sequence[int]) -> np.ndarray:
    """Features of a tree out of those that may be used, in order."""
    allowed = np.asarray(features)
    n = max(round(params.column_share * len(allowed)), 1)
    return np.sort(allowed[np.argsort(uniform(params.seed, 3, round_, allowed), kind="stable")[:n]])


@dataclass
class Split:
    feature: int
    bin: int
    missing_left: bool
    gain: float
    left: tuple[float, float, float]  # gradient, hessian, rows


def packed(cells: np.ndarray) -> bytes:
    """Histogram cells [gradient, hessian, rows]: all of them, or if that is shorter only those with rows, and their places."""
    cells = cells.reshape(-1, 3)
    used = np.flatnonzero(cells[:, 2])
    if len(used) * 28 >= cells.nbytes:
        return np.int64(-1).tobytes() + cells.tobytes()
    return np.int64(len(used)).tobytes() + cells[used].tobytes() + used.astype(np.int32).tobytes()


def unpacked(payloads: Sequence[bytes], features: int) -> np.ndarray:
    """The sum of packed histograms as (feature, bin, [gradient, hessian, rows])."""
    out = np.zeros((features * SLOTS, 3))
    for payload in payloads:
        n = int(np.frombuffer(payload, dtype=np.int64, count=1)[0])
        if n < 0:
            out += np.frombuffer(payload, offset=8).reshape(-1, 3)
        else:
            out[np.frombuffer(payload, dtype=np.int32, offset=8 + 24 * n)] += np.frombuffer(payload, count=3 * n, offset=8).reshape(-1, 3)
    return out.reshape(features, SLOTS, 3)


def best_splits(histogram: np.ndarray, bounds: Sequence[int], params: BoostParams) -> list[tuple[int, int, bool, float, np.ndarray] | None]:
    """For each node of a histogram (node, feature, bin, [gradient, hessian, rows]) the best (feature, bin, missing left, gain, left sums).

    Bins up to the split's go left, and missing values to the side that gains more. ``bounds`` are the features' numbers of cuts.
    """
    nodes, features = histogram.shape[:2]
    width = min(max(bounds, default=0) + 1, MISSING)  # no split lies above
    total = histogram.sum(axis=2)
    allowed = (np.arange(width)[None, :] <= np.asarray(bounds)[:, None])[None, :, :, None]
    sides = np.empty((3, nodes, features, width, 2))  # sums, node, feature, bin, direction
    for i in range(3):
        sides[i, ..., 0] = np.cumsum(histogram[:, :, :width, i], axis=2)
        np.add(sides[i, ..., 0], histogram[:, :, MISSING, i, None], out=sides[i, ..., 1])
    rest = total.transpose(2, 0, 1)[:, :, :, None, None] - sides
    least_rows, least_hessian = max(params.min_rows, 1), params.min_hessian
    for side in (sides, rest):
        allowed = allowed & (side[2] >= least_rows - 0.5) & (side[1] >= least_hessian)
    own = total[..., 0] ** 2 / (total[..., 1] + params.l2)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = sides[0] ** 2 / (sides[1] + params.l2) + rest[0] ** 2 / (rest[1] + params.l2) - own[:, :, None, None]
    gain = np.where(allowed & np.isfinite(gain), gain, -np.inf).reshape(nodes, -1)
    out: list[tuple[int, int, bool, float, np.ndarray] | None] = []
    for node, row in enumerate(gain):
        top = row.max(initial=-np.inf)
        if not top > params.min_gain:
            out.append(None)
            continue
        at = int(np.argmax(row >= top - TIE * abs(top)))
        feature, place, direction = np.unravel_index(at, (features, width, 2))
        out.append((int(feature), int(place), bool(direction), float(row[at]), sides[:, node, feature, place, direction]))
    return out


@dataclass
class Growth:
    """A tree that is being grown: all nodes so far, their sums and best splits."""

    tree: Tree
    sums: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    splits: dict[int, Split] = field(default_factory=dict)
    key: dict[int, float] = field(default_factory=dict)  # smallest gain on the way to a split, its own included

    def ranked(self) -> list[int]:
        """Splits in the order in which leaf-wise growth makes them: the largest gain among the leaves first.

        It never makes a split before another one whose smallest gain on the way is larger.
        """
        return sorted(self.key, key=lambda node: (-self.key[node], node))


class Added:
    """What some rows add to the histograms of a model: their nodes, gradients and hessians."""

    def __init__(self, node: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, nodes: int):
        self.at, self.gradient, self.hessian, self.nodes = node * SLOTS, gradient, hessian, nodes
        self.total = np.stack([np.bincount(node, w, nodes) for w in (gradient, hessian, None)])

    def into(self, histogram: np.ndarray, codes: np.ndarray, top: int) -> None:
        """Add the rows by node and code to ([gradient, hessian, rows], cell).

        With a frequent code ``top`` only the other rows are added up; a node's rest has this code.
        """
        size = histogram.shape[1]
        if top < 0:
            cell = self.at + codes
            histogram[0] += np.bincount(cell, self.gradient, size)
            histogram[1] += np.bincount(cell, self.hessian, size)
            histogram[2] += np.bincount(cell, minlength=size)
            return
        rest = histogram.reshape(3, self.nodes, SLOTS)[:, :, top]
        rest += self.total
        others = np.flatnonzero(codes != top)
        if len(others):
            cell = self.at[others] + codes[others]
            found = np.stack([np.bincount(cell, self.gradient[others], size), np.bincount(cell, self.hessian[others], size), np.bincount(cell, minlength=size)])
            histogram += found
            rest -= found.reshape(3, self.nodes, SLOTS).sum(axis=2)


#: Of a block of rows: lists with an entry per row, labels (missing: NaN) as bytes, and the features it holds, for each the code of
#: ``FREQUENT`` of the rows (or -1), and their codes, one feature after the other.
LISTS = ["id", "key", "y", "fold"]
CODED = ["features", "frequent", "codes"]
COLUMNS = [*LISTS, "labels", *CODED]
#: Share of a block's rows from which a feature's most frequent code is not added up, but taken as the rest of the node.
FREQUENT = 0.4


@dataclass
class Block:
    """A row of ``in_blocks``, as a task reads it."""

    batch: pa.RecordBatch
    at: int

    def column(self, name: str) -> pa.Array:
        return self.batch[name][self.at].values

    def values(self, name: str) -> np.ndarray:
        return self.column(name).to_numpy(zero_copy_only=False)

    def numbers(self, name: str, kind: type) -> np.ndarray:
        return np.frombuffer(self.batch[name][self.at].as_buffer(), dtype=kind)

    @property
    def labels(self) -> np.ndarray:
        return self.numbers("labels", np.float64)

    @property
    def rows(self) -> int:
        return len(self.labels)

    @property
    def frequent(self) -> dict[int, int]:
        return dict(zip(self.numbers("features", np.int32).tolist(), self.numbers("frequent", np.int16).tolist(), strict=True))

    @property
    def codes(self) -> dict[int, np.ndarray]:
        features = self.numbers("features", np.int32).tolist()
        return dict(zip(features, self.numbers("codes", np.uint8).reshape(len(features), self.rows), strict=True))

    def steps(self, models: int) -> np.ndarray:
        """(model, tree or one, row); no trees before the first checkpoint."""
        steps = self.batch["steps"][self.at]
        return np.frombuffer(steps.as_buffer()).reshape(models, -1, self.rows) if steps.is_valid else np.zeros((models, 0, self.rows))


def blocks_of(batch: pa.RecordBatch) -> Iterator[Block]:
    return (Block(batch, at) for at in range(batch.num_rows))


def coded(features: np.ndarray, frequent: np.ndarray, codes: np.ndarray) -> list[pa.Array]:
    """The columns ``CODED`` of one block."""
    return [pa.array([a.tobytes()], pa.binary()) for a in (features.astype(np.int32), frequent.astype(np.int16), codes)]


def in_blocks(rows: DataFrame, width: int) -> DataFrame:
    """Binned rows as blocks (``COLUMNS``), written: a task that reads them moves a few large values instead of many small rows.

    Of more partitions than cores, the blocks are dealt out evenly to a multiple of the cores, so that the tasks of a level end together.
    """
    kind = dict(rows.dtypes)["id"]
    step = max(BLOCK_BYTES // max(width, 1), 1)

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                codes = np.frombuffer(b"".join(part["bins"].to_pylist()), dtype=np.uint8).reshape(part.num_rows, width)
                counts = [np.bincount(column) for column in codes.T]
                frequent = np.array([c.argmax() if c.max() >= FREQUENT * len(codes) else -1 for c in counts])
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part[c]) for c in LISTS]
                labels = pa.array([part["y"].to_numpy(zero_copy_only=False).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([*lists, labels, *coded(np.arange(width), frequent, codes.T)], COLUMNS)

    schema = f"id array<{kind}>, key array<long>, y array<double>, fold array<int>, labels binary, features binary, frequent binary, codes binary"
    blocks = rows.select("id", F.xxhash64("id").alias("key"), "y", "fold", "bins").mapInArrow(blocked, schema)
    parts, cores = rows.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism
    return checkpoint_frame(blocks.repartition(parts // cores * cores) if parts > cores and parts % cores else blocks)


def narrowed(blocks: DataFrame, features: Sequence[int]) -> DataFrame:
    """Blocks with the codes of these features only, written: what later trees don't use need not be read for them."""
    wanted = sorted(features)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks_of(batch):
                codes, frequent, one = block.codes, block.frequent, batch.slice(block.at, 1)
                own = coded(np.array(wanted), np.array([frequent[f] for f in wanted]), np.stack([codes[f] for f in wanted]))
                yield pa.RecordBatch.from_arrays([*(one[c] for c in COLUMNS[: -len(CODED)]), *own], COLUMNS)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema.fields)
    return checkpoint_frame(blocks.mapInArrow(cut, schema))


class Booster:
    """The state of training: binned rows, margins so far, and one forest per model.

    ``rows`` has id, y, fold and bins, or blocks of them with the features of any model. Model m learns from the rows of all other folds, or from all rows if
    there are no folds, on the features ``allowed[m]``. ``steps`` of a block holds per model either the margins so far or, for DART, the steps of
    all trees; trees since the last checkpoint are applied when a task reads the block.
    """

    def __init__(
        self,
        rows: DataFrame,
        cuts: Sequence[np.ndarray],
        loss: LogLoss | FocalLoss,
        params: BoostParams,
        folds: int | None = None,
        init_score: float | None = None,
        allowed: Sequence[Sequence[int]] | None = None,
    ):
        self.cuts, self.loss, self.params, self.folds = [np.asarray(c) for c in cuts], loss, params, folds
        self.models = folds or (1 if allowed is None else len(allowed))
        self.allowed = [range(len(self.cuts))] * self.models if allowed is None else allowed
        if len(self.allowed) != self.models:
            raise ValueError("allowed needs a list of features for each fold")
        rows = rows if "codes" in rows.columns else in_blocks(rows, len(self.cuts))
        counts = {}
        if init_score is None:
            each = rows.select(F.inline(F.arrays_zip("fold", "y")))
            counts = {(r["fold"], r["y"]): r["n"] for r in each.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
        self.forests = []
        for m in range(self.models):
            n1, n0 = (sum(n for (fold, y), n in counts.items() if y == label and (folds is None or fold != m)) for label in (1, 0))
            self.forests.append(Forest(loss.start(n1, n0) if init_score is None else init_score, [], []))
        self.stored = 0  # trees in the steps
        self.rows = rows.select(*COLUMNS, F.lit(None).cast("binary").alias("steps"))
        self.parts = rows.rdd.getNumPartitions()
        # A sibling as its parent's rest halves what tasks build and send, but the parents are kept and dealt out
        # once more. Where one task adds up all partial histograms of a node, building both siblings is quicker.
        self.derives = self.parts > FAN_IN

    def read(self, forests: Sequence[Forest], left_out: Sequence[int] = ()):
        """A function from a block to (codes by feature, margins by model), for tasks."""
        stored, drops, models = self.stored, self.params.drops, self.models
        weights = [np.array([0.0 if t in left_out else w for t, w in enumerate(f.weights)]) for f in forests]

        def margins(block: Block) -> tuple[dict[int, np.ndarray], np.ndarray]:
            codes, steps = block.codes, block.steps(models)
            out = np.empty((models, block.rows))
            for m, forest in enumerate(forests):
                out[m] = forest.init_score + (weights[m][:stored] @ steps[m] if drops else steps[m, 0] if stored else 0.0)
                for tree, weight in zip(forest.trees[stored:], weights[m][stored:], strict=True):
                    if weight:
                        out[m] += (weight * np.array(tree.value))[tree.coded_leaves(codes, block.rows, MISSING)]
            return codes, out

        return margins

    def store(self) -> None:
        """Write the steps of the trees since the last checkpoint into the blocks."""
        stored, drops, models, forests = self.stored, self.params.drops, self.models, self.forests

        def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in blocks_of(batch):
                    codes = block.codes
                    new = [np.stack([np.array(t.value)[t.coded_leaves(codes, block.rows, MISSING)] for t in f.trees[stored:]]) for f in forests]
                    if drops:
                        steps = np.concatenate([block.steps(models), np.stack(new)], axis=1)
                    else:
                        steps = np.stack([np.array(f.weights[stored:]) @ n for n, f in zip(new, forests, strict=True)])[:, None, :]
                        steps = block.steps(models) + steps if stored else steps
                    one = block.batch.slice(block.at, 1)
                    yield pa.RecordBatch.from_arrays([*(one[c] for c in COLUMNS), pa.array([steps.tobytes()], pa.binary())], [*COLUMNS, "steps"])

        if all(f.trees[stored:] for f in forests):
            schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.rows.schema.fields)
            self.rows = checkpoint_frame(self.rows.mapInArrow(stepped, schema))
            self.stored = len(forests[0].trees)

    def grow(self, round_: int) -> list[Tree]:
        """One tree per model, on the margins without the trees that the round leaves out."""
        params, columns = self.params, [sampled_columns(self.params, round_, features) for features in self.allowed]
        margins = self.read(self.forests, drop_set(params, round_))
        growths = [Growth(Tree()) for _ in range(self.models)]
        for growth in growths:
            growth.tree.add(0.0, 0.0)
        # Nodes to search: (node, its parent and sibling); of many parts the smaller of two siblings is built, the other is the rest.
        frontier: list[list[tuple[int, int, int]]] = [[(0, -1, -1)] for _ in growths]
        parents: DataFrame | None = None
        kept: list[DataFrame] = []
        for depth in range(max(params.max_depth, 1)):
            last = depth + 1 >= params.max_depth
            level = self._level(growths, frontier, parents, margins, columns, round_, last or not self.derives)
            if level is None:
                break
            if self.derives and not last:
                kept.append(level.persist())
            self._take(growths, level)
            parents = level if self.derives else None
            if params.max_depth:
                frontier = [self._expand(growth, nodes) for growth, nodes in zip(growths, frontier, strict=True)]
        for level in kept:
            level.unpersist()
        return [self._finished(growth) for growth in growths]

    def _level(self, growths, frontier, parents, margins, columns, round_, last) -> DataFrame | None:
        """(model, block, node, histogram, best split) of all nodes of the frontier; no histograms if no level comes after that needs them (``last``)."""
        build, derived = [], []
        for growth, nodes in zip(growths, frontier, strict=True):
            own, rest = [], []
            for node, parent, sibling in nodes:
                smaller = not self.derives or sibling < 0 or (growth.sums[node][2], node) < (growth.sums[sibling][2], sibling)
                (own if smaller else rest).append((node, parent, sibling))
            build.append([n[0] for n in own])
            derived.append(rest)
        if not any(build):
            return None
        blocks = [[own[i : i + BLOCK] for i in range(0, len(own), BLOCK)] for own in columns]
        per_pass = max(CELLS // (sum(map(len, columns)) * SLOTS * 3), 1)
        passes = [[b[i : i + per_pass] for b in build] for i in range(0, max(map(len, build)), per_pass)]
        partial = None
        for p in passes:
            found = self._partial(p, growths, margins, columns, blocks, round_)
            partial = found if partial is None else partial.unionByName(found)
        return self._searched(partial, parents, derived, blocks, last)

    def _partial(self, build, growths, margins, columns, blocks, round_) -> DataFrame:
        """(model, block, node, part, histogram) per task, summed in rounds until few parts are left."""
        loss, params, folds, trees = self.loss, self.params, self.folds, [g.tree for g in growths]
        needed = ["labels", *CODED, "steps", *(["fold"] if folds is not None else []), *(["key"] if params.row_share < 1 else [])]
        draw = (params.seed, 4, round_ // params.row_every)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros((3, len(own), len(nodes) * SLOTS)) for own, nodes in zip(columns, build, strict=True)]
            places = [{int(column): i for i, column in enumerate(own)} for own in columns]
            slots = []
            for tree, nodes in zip(trees, build, strict=True):
                slot = np.full(len(tree.feature), -1)
                slot[nodes] = np.arange(len(nodes))
                slots.append(slot)
            for block in (block for batch in batches for block in blocks_of(batch)):
                codes, margin = margins(block)
                y, fold = block.labels, None if folds is None else block.values("fold")
                drawn = uniform(*draw, block.values("key")) < params.row_share if params.row_share < 1 else None
                chosen = []
                for m, slot in enumerate(slots):
                    if not build[m]:
                        continue
                    at = slot[trees[m].coded_leaves(codes, block.rows, MISSING)]
                    used = at >= 0
                    if drawn is not None:
                        used &= drawn
                    if fold is not None:
                        used &= fold != m
                    rows = slice(None) if used.all() else np.flatnonzero(used)
                    gradient, hessian = loss.derivatives(y[rows], margin[m, rows])
                    chosen.append((sums[m], places[m], rows, Added(at[rows], gradient, np.maximum(hessian, MIN_HESSIAN), len(build[m]))))
                for column, top in block.frequent.items():
                    own = codes[column]
                    for total, place, rows, given in chosen:
                        if column in place:
                            given.into(total[:, place[column]], own[rows], top)
            part, out = TaskContext.get().partitionId(), []
            for m, nodes in enumerate(build):
                first = np.cumsum([0, *map(len, blocks[m])])
                for i, node in enumerate(nodes):
                    for b in range(len(blocks[m])):
                        payload = sums[m][:, first[b] : first[b + 1], i * SLOTS : (i + 1) * SLOTS]
                        out.append((m, b, node, part, packed(payload.transpose(1, 2, 0))))
            if out:
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["model", "block", "node", "part", "payload"])

        schema = "model int, block int, node int, part int, payload binary"

        def summed(pdf: pd.DataFrame) -> pd.DataFrame:
            one = pdf.iloc[:1].copy()
            one["part"] //= FAN_IN
            one["payload"] = [packed(unpacked(pdf["payload"], len(blocks[int(pdf["model"].iloc[0])][int(pdf["block"].iloc[0])])))]
            return one

        found, parts = self.rows.select(*needed).mapInArrow(added, schema), self.parts
        while parts > FAN_IN:
            found = found.groupBy("model", "block", "node", F.floor(F.col("part") / FAN_IN)).applyInPandas(summed, schema)
            parts = -(-parts // FAN_IN)
        return found

    def _searched(self, partial, parents, derived, blocks, last) -> DataFrame:
        """Histograms of built nodes summed, those of their siblings as the parent's rest, and each one's best split."""
        params, bounds = self.params, [[[len(self.cuts[c]) for c in block] for block in own] for own in blocks]
        fields = ["model", "block", "node", "payload", "feature", "bin", "missing_left", "gain", "gl", "hl", "nl", "g", "h", "n"]
        schema = "model int, block int, node int, payload binary, feature int, bin int, missing_left boolean, gain double, gl double, hl double, nl double, g double, h double, n double"

        def search(built: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
            model, block = int(built["model"].iloc[0]), int(built["block"].iloc[0])
            features = len(blocks[model][block])
            found = {int(node): unpacked(rows, features) for node, rows in built.groupby("node")["payload"]}
            over = dict(zip(above["node"], above["payload"], strict=True))
            for node, parent, sibling in derived[model]:
                found[node] = unpacked([over[parent]], features) - found[sibling]
            nodes = sorted(found)
            out = []
            for node, best in zip(nodes, best_splits(np.stack([found[n] for n in nodes]), bounds[model][block], params), strict=True):
                payload = None if last else packed(found[node])
                total = found[node][0].sum(axis=0).tolist()
                split = (-1, -1, False, 0.0, 0.0, 0.0, 0.0) if best is None else (int(blocks[model][block][best[0]]), *best[1:4], *best[4].tolist())
                out.append((model, block, node, payload, *split, *total))
            return pd.DataFrame(out, columns=fields)

        # A task per model and block: a persisted level keeps its shuffle partitions, however many of them are empty.
        groups = sum(map(len, blocks))
        partial = partial.repartition(groups, "model", "block")
        if parents is None:
            none = pd.DataFrame({"node": [], "payload": []})
            return partial.groupBy("model", "block").applyInPandas(lambda pdf: search(pdf, none), schema)
        above = parents.select("model", "block", "node", "payload").repartition(groups, "model", "block")
        return partial.groupBy("model", "block").cogroup(above.groupBy("model", "block")).applyInPandas(
            lambda built, over: search(built, over) if len(built) else pd.DataFrame([], columns=fields), schema
        )

    def _take(self, growths: list[Growth], level: DataFrame) -> None:
        """The best split of each node over all blocks."""
        best: dict[tuple[int, int], list] = {}
        for r in level.drop("payload").collect():
            best.setdefault((r["model"], r["node"]), []).append(r)
        for (model, node), rows in best.items():
            growth, r = growths[model], min(rows, key=lambda r: r["block"])
            growth.sums[node] = (r["g"], r["h"], r["n"])
            valid = [x for x in rows if x["feature"] >= 0]
            if valid:
                top = max(x["gain"] for x in valid)
                b = min((x for x in valid if x["gain"] >= top - TIE * abs(top)), key=lambda x: x["block"])
                growth.splits[node] = Split(b["feature"], b["bin"], b["missing_left"], b["gain"], (b["gl"], b["hl"], b["nl"]))

    def _expand(self, growth: Growth, nodes: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Split the searched nodes that leaf-wise growth can still reach; their children are the next frontier."""
        above = dict(zip(growth.tree.left, range(len(growth.tree.left)), strict=True)) | dict(zip(growth.tree.right, range(len(growth.tree.right)), strict=True))
        for node, _, _ in nodes:
            if node in growth.splits:
                growth.key[node] = min(growth.splits[node].gain, growth.key.get(above.get(node, -1), np.inf))
        children = []
        made = set(growth.ranked()[: self.params.max_leaves - 1])
        for node, _, _ in nodes:
            if node in made:
                split, (g, h, n) = growth.splits[node], growth.sums[node]
                left, right = growth.tree.add(0.0, 0.0), growth.tree.add(0.0, 0.0)
                growth.sums[left] = split.left
                growth.sums[right] = (g - split.left[0], h - split.left[1], n - split.left[2])
                growth.tree.split(node, split.feature, self._threshold(split), split.bin, split.missing_left, split.gain, left, right)
                children += [(left, node, right), (right, node, left)]
        return children

    def _threshold(self, split: Split) -> float:
        """The upper bound of a split's bin; the last bin holds all values."""
        cuts = self.cuts[split.feature]
        return float(cuts[split.bin]) if split.bin < len(cuts) else float("inf")

    def _finished(self, growth: Growth) -> Tree:
        """The tree of the first splits in leaf-wise order, its leaves' Newton steps with L2."""
        made = set(growth.ranked()[: self.params.max_leaves - 1]) & {n for n, f in enumerate(growth.tree.feature) if f != LEAF}
        tree, old = Tree(), growth.tree

        def leaf(node: int) -> int:
            g, h, n = growth.sums.get(node, (0.0, 0.0, 0.0))
            return tree.add(-g / (h + self.params.l2) if h + self.params.l2 else 0.0, n)

        queue = [(0, leaf(0))]
        for node, new in queue:
            if node in made:
                left, right = leaf(old.left[node]), leaf(old.right[node])
                tree.split(new, old.feature[node], old.threshold[node], old.bin[node], old.missing_left[node], old.gain[node], left, right)
                queue += [(old.left[node], left), (old.right[node], right)]
        return tree

    def add(self, trees: Sequence[Tree], round_: int) -> None:
        """New trees with their weights; those that the round left out are scaled down."""
        left_out = drop_set(self.params, round_)
        k = len(left_out)
        for forest, tree in zip(self.forests, trees, strict=True):
            for t in left_out:
                forest.weights[t] *= k / (k + 1)
            forest.trees.append(tree)
            forest.weights.append(self.params.learning_rate / (k + 1))

    def staged(self) -> DataFrame:
        """(id, y, fold, round, margin) of the rows left out, by their fold's model, after each round since the last checkpoint."""
        stored, forests, read = self.stored, self.forests, self.read([Forest(f.init_score, f.trees[: self.stored], f.weights[: self.stored]) for f in self.forests])

        def rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in (block for batch in batches for block in blocks_of(batch)):
                codes, margins = read(block)
                fold = block.values("fold")
                out = np.zeros((block.rows, len(forests[0].trees) - stored))
                for m, forest in enumerate(forests):
                    rows = np.flatnonzero(fold == m)
                    margin = margins[m, rows]
                    for i, (tree, weight) in enumerate(zip(forest.trees[stored:], forest.weights[stored:], strict=True)):
                        margin = margin + weight * np.array(tree.value)[tree.coded_leaves(codes, block.rows, MISSING)[rows]]
                        out[rows, i] = margin
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in ("id", "y", "fold")), pa.array(list(out), pa.list_(pa.float64()))], ["id", "y", "fold", "staged"])

        kind = dict(self.rows.dtypes)["id"].removeprefix("array<").removesuffix(">")
        found = self.rows.mapInArrow(rounds, f"id {kind}, y double, fold int, staged array<double>")
        return found.select("id", "y", "fold", F.posexplode("staged").alias("at", "margin")).select("id", "y", "fold", (F.col("at") + stored + 1).alias("round"), "margin")


@dataclass
class Boosted:
    """One forest per model, and per model the rank metric of the fold left out after each round, if it was asked for."""

    forests: list[Forest]
    metrics: list[list[float]]


def binned_rows(
    df: DataFrame, label: str, id_col: str, cuts: Sequence[np.ndarray], fold: str | None = None, features: str = "features"
) -> DataFrame:
    """(id, y, fold, bins), written once for all rounds, in partitions of ``ROWS`` rows or more."""
    part = F.lit(0) if fold is None else F.col(fold)
    keep = [F.col(id_col).alias("id"), F.col(label).cast("double").alias("y"), part.cast("int").alias("fold")]
    return in_large_parts(checkpoint_frame(binned(df, keep, cuts, features)))


def in_large_parts(rows: DataFrame) -> DataFrame:
    """A written frame with partitions put together, if they have fewer than ``ROWS`` rows on average or are many more than there are cores."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    few = max(min(-(-n // ROWS), max(TASKS * cores, -(-n // MOST_ROWS))), 1)
    return rows.coalesce(few) if few < rows.rdd.getNumPartitions() else rows


def boost_rows(
    rows: DataFrame,
    cuts: Sequence[np.ndarray],
    loss: LogLoss | FocalLoss,
    params: BoostParams,
    folds: int | None = None,
    init_score: float | None = None,
    allowed: Sequence[Sequence[int]] | None = None,
) -> Boosted:
    """``boost`` on rows that are binned already, or on blocks of them.

    ``allowed`` has the features of each model (default: all); without folds there is a model for each of its lists.
    """
    if params.patience and (folds is None or params.drops):
        raise ValueError("patience needs folds to measure on, and rounds that later ones don't change")
    booster = Booster(rows, cuts, loss, params, folds, init_score, allowed)
    metrics: list[list[float]] = [[] for _ in booster.forests]
    for round_ in range(params.rounds):
        booster.add(booster.grow(round_), round_)
        done = round_ + 1 == params.rounds
        if done or (round_ + 1) % params.checkpoint_every == 0:
            if params.patience:
                _measure(booster, metrics)
                if all(len(m) - best_round(m) >= params.patience for m in metrics):
                    break
            if not done:
                booster.store()
    if params.patience:
        return Boosted([f.first(best_round(m)) for f, m in zip(booster.forests, metrics, strict=True)], metrics)
    return Boosted(booster.forests, metrics)


def boost(
    df: DataFrame,
    label: str,
    id_col: str,
    loss: LogLoss | FocalLoss | None = None,
    params: BoostParams | None = None,
    folds: int | None = None,
    fold: str = "fold",
    features: str = "features",
    init_score: float | None = None,
    cuts: Sequence[np.ndarray] | None = None,
) -> Boosted:
    """Boost on a feature column (array or vector; NULL and NaN are missing): one forest, or one per fold on the rows of the others.

    Leaves hold Newton steps with L2. ``init_score`` is the loss's best constant by default. ``cuts`` and bins
    serve all folds and rounds. Sampling and drops depend on the seed, the round and the id alone. The frame is
    read once for the cuts and once for the bins; freeze it first if it is expensive.
    """
    params = params or BoostParams()
    cuts = quantile_cuts(df, features, bins=params.bins) if cuts is None else cuts
    rows = binned_rows(df, label, id_col, cuts, None if folds is None else fold, features)
    return boost_rows(rows, cuts, loss or LogLoss(), params, folds, init_score)


def best_round(metric: Sequence[float]) -> int:
    """The first round (from 1) with the largest metric."""
    return int(np.argmax(metric)) + 1


def _measure(booster: Booster, metrics: list[list[float]]) -> None:
    """The rank metric of all rounds since the last checkpoint and of all folds, from one ordering."""
    scored = rank_metrics(booster.staged(), "y", "margin", "id", ["fold", "round"]).select("fold", "round", "metric").collect()
    for r in sorted(scored, key=lambda r: r["round"]):
        metrics[r["fold"]].append(-np.inf if r["metric"] is None else r["metric"])


def fold_margins(df: DataFrame, forests: Sequence[Forest], keep: Sequence[str], fold: str = "fold", features: str = "features") -> DataFrame:
    """The ``keep`` columns, the margin of each row by the forest of its fold, and its probability."""
    rows = df.select(*keep, F.col(fold).cast("int").alias("__fold"), as_array(df, features).alias("__x"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = matrix(batch["__x"]), batch["__fold"].to_numpy(zero_copy_only=False)
            margin = np.zeros(batch.num_rows)
            for m, forest in enumerate(forests):
                margin[at == m] = forest.margins(x[at == m])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(margin)], [*keep, "margin"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    return rows.mapInArrow(scored, f"{schema}, margin double").withColumn("prediction", sigmoid("margin"))


def recoded(forest: Forest, cuts: Sequence[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Margins by bin codes instead of values; equal to ``forest.margins`` for the cuts it was grown with."""
    codes = to_bins(x, cuts)
    out = np.full(len(x), forest.init_score)
    for tree, weight in zip(forest.trees, forest.weights, strict=True):
        out += weight * np.array(tree.value)[tree.binned_leaves(codes, MISSING)]
    return out

