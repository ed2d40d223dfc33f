import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions.losses import FocalLoss, LogLoss
from panelspark.operators import binning as B
from panelspark.operators import boosting as G
from panelspark.operators import forest as T
from panelspark.operators.folds import stratified_folds
from panelspark.operators.metrics import focal_init_score, rank_metrics


def frame(spark, x, y, parts=3):
    rows = [(i, float(t), [None if np.isnan(v) else float(v) for v in r]) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, y double, features array<double>").repartition(parts)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(1500, 6)), 2)
    x[rng.random(x.shape) < 0.15] = np.nan
    signal = np.nan_to_num(x[:, 0]) + 2 * np.isnan(x[:, 1]) - np.nan_to_num(x[:, 2]) * (np.nan_to_num(x[:, 0]) > 0)
    y = (signal + rng.normal(scale=0.7, size=1500) > 0.3).astype(float)
    df = frame(spark, x, y)
    folds = stratified_folds(df, "id", "y", 3)
    return x, y, df.join(folds.select("id", "fold"), "id").cache()


# binning


def exact_cuts(values, weights, bins):
    summary = B.summarize(values, weights)
    return B.cuts_of(summary, bins)


@pytest.mark.parametrize("parts", [1, 5, 70])
def test_cuts_are_exact_with_few_values_ties_and_missing_ones(spark, parts):
    rng = np.random.default_rng(parts)
    x = np.stack([rng.integers(0, 300, 4000) / 7, np.where(rng.random(4000) < 0.9, 5.0, rng.random(4000)), rng.integers(0, 4, 4000), np.full(4000, np.nan)], axis=1).astype(float)
    x[::9, 0] = np.nan
    w = rng.integers(1, 5, 4000).astype(float)
    df = spark.createDataFrame([([None if np.isnan(v) else float(v) for v in r], float(k)) for r, k in zip(x, w, strict=True)], "features array<double>, w double")
    for weight, used in ((None, np.ones(4000)), ("w", w)):
        cuts = B.quantile_cuts(df.repartition(parts), weight=weight, bins=16)
        for f in range(4):
            np.testing.assert_array_equal(cuts[f], exact_cuts(x[:, f], used, 16))
    assert 5.0 not in cuts[1][:-1] and len(cuts[2]) == 3 and len(cuts[3]) == 0


def test_short_summaries_keep_ranks_within_the_stated_error(spark):
    rng = np.random.default_rng(0)
    values = np.where(rng.random(60_000) < 0.33, 1.5, rng.normal(size=60_000))
    df = spark.createDataFrame([([float(v)],) for v in values], "features array<double>").repartition(40)
    size = 256
    cuts = B.quantile_cuts(df, bins=20, size=size)[0]
    ordered = np.sort(values)
    times = 3  # once in a task, twice when 40 summaries are merged in two rounds
    for cut in cuts:
        low, high = np.searchsorted(ordered, cut, "left") / len(values), np.searchsorted(ordered, cut, "right") / len(values)
        nearest = min(np.arange(1, 20) / 20, key=lambda q: max(low - q, q - high, 0))
        assert max(low - nearest, nearest - high, 0) <= times / size


def test_merging_in_any_order_agrees_without_shortening():
    rng = np.random.default_rng(1)
    parts = [B.summarize(rng.integers(0, 50, 100).astype(float), np.ones(100)) for _ in range(4)]
    one = B.merge(parts)
    two = B.merge([B.merge(parts[2:]), B.merge(parts[:2])])
    np.testing.assert_array_equal(one[0], two[0])
    np.testing.assert_array_equal(one[1], two[1])


def test_codes_put_values_at_a_cut_left_and_missing_apart():
    codes = B.to_bins(np.array([[1.0], [1.5], [2.0], [9.0], [np.nan], [np.inf], [-np.inf]]), [np.array([1.0, 2.0])])
    assert codes.ravel().tolist() == [0, 1, 1, 2, B.MISSING, 2, 0]


def test_bins_are_bounded(data):
    with pytest.raises(ValueError, match="bins"):
        B.quantile_cuts(data[2], bins=256)


# trees


def brute_tree(codes, cuts, g, h, params, depth):
    """Depth-wise growth by trying every split of every node."""
    nodes = [(np.arange(len(codes)), 0)]
    out = np.zeros(len(codes))
    while nodes:
        rows, level = nodes.pop()
        best = None
        if level < depth:
            total = g[rows].sum() ** 2 / (h[rows].sum() + params.l2)
            for f in range(codes.shape[1]):
                for b in range(len(cuts[f]) + 1):
                    for left_missing in (False, True):
                        left = np.where(codes[rows, f] == B.MISSING, left_missing, codes[rows, f] <= b)
                        if min(left.sum(), (~left).sum()) < params.min_rows:
                            continue
                        gain = sum(g[rows[s]].sum() ** 2 / (h[rows[s]].sum() + params.l2) for s in (left, ~left)) - total
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-9 * abs(best[0])):
                            best = (gain, left)
        if best is None:
            out[rows] = -g[rows].sum() / (h[rows].sum() + params.l2)
        else:
            nodes += [(rows[best[1]], level + 1), (rows[~best[1]], level + 1)]
    return out


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_a_tree_equals_trying_every_split(data, depth):
    x, y, df = data
    params = G.BoostParams(rounds=1, learning_rate=1.0, max_depth=depth, max_leaves=100, l2=2.0, min_rows=30, bins=8, min_hessian=0.0)
    cuts = B.quantile_cuts(df, bins=8)
    forest = G.boost(df, "y", "id", params=params, cuts=cuts, init_score=0.0).forests[0]
    got = forest.margins(x)
    g, h = LogLoss().derivatives(y, np.zeros(len(y)))
    np.testing.assert_allclose(got, brute_tree(B.to_bins(x, cuts), cuts, g, h, params, depth), atol=1e-9)
    np.testing.assert_allclose(got, G.recoded(forest, cuts, x))


def test_many_blocks_parts_and_passes_give_the_same_trees(spark, data, monkeypatch):
    x, y, df = data
    params = G.BoostParams(rounds=3, max_depth=4, min_rows=10, bins=16)
    one = G.boost(df, "y", "id", params=params).forests[0].margins(x)
    monkeypatch.setattr(G, "BLOCK", 2)
    monkeypatch.setattr(G, "FAN_IN", 3)
    monkeypatch.setattr(G, "CELLS", 6 * 256 * 3 * 2)
    np.testing.assert_allclose(G.boost(df.repartition(11), "y", "id", params=params).forests[0].margins(x), one, atol=1e-9)


def test_small_partitions_are_put_together_and_many_give_the_same_trees(data, monkeypatch):
    x, y, df = data
    params = G.BoostParams(rounds=3, max_depth=4, min_rows=10, bins=16)
    cuts, many = B.quantile_cuts(df, bins=16), df.repartition(11)
    rows = G.binned_rows(many, "y", "id", cuts)
    assert rows.rdd.getNumPartitions() == 1 and rows.count() == rows.select("id").distinct().count() == 1500
    one = G.boost_rows(rows, cuts, LogLoss(), params).forests[0].margins(x)
    monkeypatch.setattr(G, "ROWS", 150)
    monkeypatch.setattr(G, "BLOCK", 2)
    monkeypatch.setattr(G, "FAN_IN", 3)
    rows = G.binned_rows(many, "y", "id", cuts)
    assert rows.rdd.getNumPartitions() == 10
    for allowed in (None, [range(6), [0, 2, 5]]):
        found = G.boost_rows(rows, cuts, LogLoss(), params, allowed=allowed).forests[0]
        np.testing.assert_allclose(found.margins(x), one, atol=1e-9)


def test_rows_are_read_as_blocks_by_a_few_tasks_per_core(spark, data, monkeypatch):
    x, y, df = data
    cuts = B.quantile_cuts(df, bins=16)
    monkeypatch.setattr(G, "ROWS", 10)
    rows = G.binned_rows(df.repartition(40), "y", "id", cuts)
    assert rows.rdd.getNumPartitions() == G.TASKS * spark.sparkContext.defaultParallelism
    booster = G.Booster(rows, cuts, LogLoss(), G.BoostParams(max_depth=2))
    assert booster.rows.count() <= 40 and booster.rows.selectExpr("explode(id)").distinct().count() == 1500
    for block in booster.rows.limit(2).collect():
        codes = B.to_bins(x[np.array(block["id"])], cuts)
        assert block["codes"] == codes.T.tobytes() and block["labels"] == y[np.array(block["id"])].tobytes()


@pytest.mark.parametrize("frequent", [0.0, 0.3, 2.0])
def test_narrowed_blocks_and_frequent_codes_give_the_same_trees(data, monkeypatch, frequent):
    x, y, df = data
    x = np.where(np.arange(6) % 2 & (np.abs(np.nan_to_num(x)) < 1), 0.0, x)  # a third or more of every other column is 0
    df = df.withColumn("features", F.expr("transform(features, (v, i) -> if(i % 2 = 1 and abs(coalesce(v, 0)) < 1, 0D, v))"))
    params = G.BoostParams(rounds=4, max_depth=3, min_rows=10, bins=16, row_share=0.8, checkpoint_every=2)
    cuts, own = B.quantile_cuts(df, bins=16), [1, 2, 3, 5]
    monkeypatch.setattr(G, "FREQUENT", frequent)
    blocks = G.in_blocks(G.binned_rows(df, "y", "id", cuts, "fold"), 6)
    whole = G.boost_rows(blocks, cuts, LogLoss(), params, allowed=[own]).forests[0]
    few = G.narrowed(blocks, own)
    assert few.first()["features"] == np.array(own, dtype=np.int32).tobytes()
    part = G.boost_rows(few, cuts, LogLoss(), params, allowed=[own, [2]]).forests[0]
    assert [t.feature for t in part.trees] == [t.feature for t in whole.trees]
    np.testing.assert_allclose(part.margins(x), whole.margins(x), atol=1e-9)
    codes = B.to_bins(x, cuts)
    row = {f: c for f, c in enumerate(np.ascontiguousarray(codes.T))}
    for tree in whole.trees:
        assert max(tree.feature) >= 0
        np.testing.assert_array_equal(tree.coded_leaves(row, len(codes), B.MISSING), tree.binned_leaves(codes, B.MISSING))
    first = G.BoostParams(rounds=1, learning_rate=1.0, max_depth=3, max_leaves=8, min_rows=10, bins=16)
    one = G.boost_rows(blocks, cuts, LogLoss(), first, init_score=0.0).forests[0]
    g, h = LogLoss().derivatives(y, np.zeros(len(y)))
    np.testing.assert_allclose(one.margins(x), leaf_wise(codes, cuts, g, h, first), atol=1e-9)


def test_shapley_values_of_equal_ways_are_computed_once(data, monkeypatch):
    x, _, df = data
    forest = G.boost(df, "y", "id", params=G.BoostParams(rounds=3, max_depth=3, min_rows=10, bins=16)).forests[0]
    once = forest.shapley(x)
    monkeypatch.setattr(T, "PATTERN", -1)
    np.testing.assert_allclose(once, forest.shapley(x), atol=1e-12)


def test_models_on_features_of_their_own_are_those_grown_alone(data):
    x, y, df = data
    params = G.BoostParams(rounds=4, max_depth=3, min_rows=10, bins=16, column_share=0.7, checkpoint_every=2)
    cuts, sets = B.quantile_cuts(df, bins=16), [[0, 1, 2, 3, 4, 5], [4], [1, 3, 5]]
    rows = G.binned_rows(df, "y", "id", cuts)
    together = G.boost_rows(rows, cuts, LogLoss(), params, allowed=sets).forests
    assert len(together) == 3
    for forest, own in zip(together, sets, strict=True):
        alone = G.boost_rows(rows, cuts, LogLoss(), params, allowed=[own]).forests[0]
        assert [t.feature for t in forest.trees] == [t.feature for t in alone.trees]
        assert {f for t in forest.trees for f in t.feature} <= {*own, T.LEAF}
        np.testing.assert_allclose(forest.margins(x), alone.margins(x), atol=1e-9)
    with pytest.raises(ValueError):
        G.boost_rows(rows, cuts, LogLoss(), params, folds=2, allowed=sets)


def leaf_wise(codes, cuts, g, h, params):
    """The largest gain among the leaves is split first, one leaf at a time."""
    hist = lambda rows: np.stack([[np.bincount(codes[rows, f], w[rows], 256) for w in (g, h, np.ones(len(g)))] for f in range(codes.shape[1])]).transpose(0, 2, 1)[None]
    bounds = [len(c) for c in cuts]
    leaves = [(np.arange(len(codes)), 0)]
    best = {0: G.best_splits(hist(leaves[0][0]), bounds, params)[0]}
    while len(leaves) < params.max_leaves:
        open_ = [i for i, (_, depth) in enumerate(leaves) if best[i] is not None and depth < params.max_depth]
        if not open_:
            break
        i = max(open_, key=lambda i: best[i][3])
        rows, depth = leaves[i]
        f, b, missing_left, _, _ = best[i]
        left = np.where(codes[rows, f] == B.MISSING, missing_left, codes[rows, f] <= b)
        leaves[i] = (rows[left], depth + 1)
        leaves.append((rows[~left], depth + 1))
        for j in (i, len(leaves) - 1):
            best[j] = G.best_splits(hist(leaves[j][0]), bounds, params)[0]
    out = np.zeros(len(codes))
    for rows, _ in leaves:
        out[rows] = -g[rows].sum() / (h[rows].sum() + params.l2)
    return out


@pytest.mark.parametrize("leaves", [2, 3, 7, 12])
def test_growth_by_levels_equals_leaf_wise_growth(data, leaves):
    x, y, df = data
    params = G.BoostParams(rounds=1, learning_rate=1.0, max_depth=6, max_leaves=leaves, min_rows=10, bins=16)
    cuts = B.quantile_cuts(df, bins=16)
    forest = G.boost(df, "y", "id", params=params, cuts=cuts, init_score=0.0).forests[0]
    g, h = LogLoss().derivatives(y, np.zeros(len(y)))
    np.testing.assert_allclose(forest.margins(x), leaf_wise(B.to_bins(x, cuts), cuts, g, h, params), atol=1e-9)
    assert sum(f == T.LEAF for f in forest.trees[0].feature) == leaves


def test_folds_learn_from_the_others_only(data):
    x, y, df = data
    params = G.BoostParams(rounds=4, max_depth=3, min_rows=10, checkpoint_every=2, bins=32)
    cuts = B.quantile_cuts(df, bins=32)
    together = G.boost(df, "y", "id", params=params, folds=3, cuts=cuts)
    for k in range(3):
        alone = G.boost(df.filter(F.col("fold") != k), "y", "id", params=params, cuts=cuts).forests[0]
        np.testing.assert_allclose(together.forests[k].margins(x), alone.margins(x), atol=1e-9)
    scored = G.fold_margins(df, together.forests, ["id", "y", "fold"]).toPandas()
    expected = np.array([together.forests[k].margins(x[i : i + 1])[0] for i, k in zip(scored["id"], scored["fold"], strict=True)])
    np.testing.assert_allclose(scored["margin"], expected)


def test_samples_depend_on_seed_round_and_id_alone(data):
    x, _, df = data
    params = G.BoostParams(rounds=3, max_depth=3, row_share=0.5, row_every=2, column_share=0.5, min_rows=5, bins=16)
    one, two = (G.boost(d, "y", "id", params=params).forests[0].margins(x) for d in (df, df.repartition(7)))
    np.testing.assert_allclose(one, two, atol=1e-9)
    other = G.boost(df, "y", "id", params=G.BoostParams(**{**params.__dict__, "seed": 7})).forests[0].margins(x)
    assert not np.allclose(one, other)
    assert len(G.sampled_columns(params, 0, range(6))) == 3
    assert abs(G.uniform(1, 2, np.arange(10_000)).mean() - 0.5) < 0.02


def test_missing_values_go_where_they_gain_more(spark):
    x = np.array([[np.nan]] * 40 + [[1.0]] * 40 + [[2.0]] * 40)
    for labels, missing_left in (([1] * 40 + [1] * 40 + [0] * 40, True), ([0] * 40 + [1] * 40 + [0] * 40, False)):
        forest = G.boost(frame(spark, x, labels), "y", "id", params=G.BoostParams(rounds=1, max_depth=1, min_rows=1)).forests[0]
        assert forest.trees[0].missing_left[0] is missing_left and forest.trees[0].threshold[0] == 1.0
    forest = G.boost(frame(spark, x, [1] * 40 + [0] * 80), "y", "id", params=G.BoostParams(rounds=1, max_depth=1, min_rows=1)).forests[0]
    assert forest.trees[0].threshold[0] == math.inf and not forest.trees[0].missing_left[0]


def test_a_level_has_a_task_per_model_and_block_whatever_the_shuffle_partitions(spark, data):
    df, old = data[2], spark.conf.get("spark.sql.shuffle.partitions")
    cuts = B.quantile_cuts(df, bins=16)
    rows = G.binned_rows(df, "y", "id", cuts, "fold")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        for derives in (False, True):
            booster = G.Booster(rows, cuts, LogLoss(), G.BoostParams(max_depth=2, min_rows=10), 3)
            booster.derives, found = derives, []
            searched = booster._searched

            def counted(*given, searched=searched, found=found):
                level = searched(*given)
                found.append(level.persist().rdd.getNumPartitions())
                return level

            booster._searched = counted
            booster.grow(0)
            assert found == [3, 3]  # three folds, one block
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_siblings_built_or_taken_from_their_parents_give_the_same_trees(data):
    df = data[2]
    cuts = B.quantile_cuts(df, bins=16)
    rows, grown = G.binned_rows(df, "y", "id", cuts, "fold"), []
    for derives in (False, True):
        booster = G.Booster(rows, cuts, LogLoss(), G.BoostParams(max_depth=4, max_leaves=12, min_rows=10), 3)
        booster.derives = derives
        grown.append(booster.grow(0))
    for built, derived in zip(*grown, strict=True):
        assert (built.feature, built.bin, built.missing_left) == (derived.feature, derived.bin, derived.missing_left)
        assert max(built.feature) >= 0
        np.testing.assert_allclose(built.value, derived.value)


@pytest.mark.parametrize("share", [0.0, 0.01, 0.9, 1.0])
def test_packed_histograms_add_up_and_few_rows_take_little_room(share):
    rng = np.random.default_rng(7)
    cells = rng.normal(size=(3, 5, G.SLOTS, 3))
    cells[..., 2] = rng.random(cells.shape[:-1]) < share
    cells[cells[..., 2] == 0] = 0.0
    payloads = [G.packed(c) for c in cells]
    np.testing.assert_array_equal(G.unpacked(payloads, 5), 0.0 + cells[0] + cells[1] + cells[2])
    assert all(len(p) <= 8 + min(c.nbytes, 28 * int(c[..., 2].sum())) for p, c in zip(payloads, cells, strict=True))


def test_constant_labels_and_features_give_one_leaf(spark):
    same = frame(spark, np.ones((50, 2)), np.arange(50) % 2)
    assert len(G.boost(same, "y", "id", params=G.BoostParams(rounds=2)).forests[0].trees[1].feature) == 1


# DART


def test_dart_drops_and_rescales(data):
    x, y, df = data
    params = G.BoostParams(rounds=4, learning_rate=0.5, max_depth=2, min_rows=10, bins=16, drop_sets=((), (0,), (), (0, 2)), checkpoint_every=2)
    cuts = B.quantile_cuts(df, bins=16)
    forest = G.boost(df, "y", "id", params=params, cuts=cuts, init_score=0.0).forests[0]
    assert forest.weights == pytest.approx([0.5 / 2 * 2 / 3, 0.5 / 2, 0.5 * 2 / 3, 0.5 / 3])
    codes, weights, trees = B.to_bins(x, cuts), [], []
    for r, drop in enumerate(params.drop_sets):
        margin = sum((w * t.steps(x) for i, (t, w) in enumerate(zip(trees, weights, strict=True)) if i not in drop), np.zeros(len(y)))
        g, h = LogLoss().derivatives(y, margin)
        np.testing.assert_allclose(forest.trees[r].steps(x), brute_tree(codes, cuts, g, h, params, 2), atol=1e-9)
        trees.append(forest.trees[r])
        for t in drop:
            weights[t] *= len(drop) / (len(drop) + 1)
        weights.append(0.5 / (len(drop) + 1))


def test_drop_sets_are_reproducible():
    params = G.BoostParams(drop_rate=0.3, skip_drop=0.5)
    sets = [G.drop_set(params, r) for r in range(200)]
    assert sets == [G.drop_set(params, r) for r in range(200)] and sets[0] == ()
    assert 60 < sum(not s for s in sets) < 140 and all(t < r for r, s in enumerate(sets) for t in s)


# stopping


def test_the_metric_of_each_round_is_that_of_the_prefix_and_the_first_best_round_stays(data):
    x, y, df = data
    params = G.BoostParams(rounds=9, learning_rate=0.6, max_depth=3, min_rows=5, bins=16, patience=4, checkpoint_every=3)
    found = G.boost(df, "y", "id", params=params, folds=3)
    full = G.boost(df, "y", "id", params=G.BoostParams(**{**params.__dict__, "patience": 0, "rounds": len(found.metrics[0])}), folds=3)
    for k in range(3):
        held = df.filter(F.col("fold") == k)
        for r in (1, len(found.metrics[k])):
            scored = held.select("id", "y", T.margin_column(held, full.forests[k].first(r)).alias("s"))
            assert rank_metrics(scored, "y", "s", "id").first()["metric"] == pytest.approx(found.metrics[k][r - 1])
        assert len(found.forests[k].trees) == found.metrics[k].index(max(found.metrics[k])) + 1
    staged = df.select("id", "y", T.staged_column(df, full.forests[0]).alias("staged"))
    last = T.rounds_of(staged, ["id", "y"]).filter(F.col("round") == len(full.forests[0].trees)).orderBy("id").toPandas()
    np.testing.assert_allclose(last["margin"], full.forests[0].margins(x))


def test_patience_needs_folds(data):
    with pytest.raises(ValueError, match="patience"):
        G.boost(data[2], "y", "id", params=G.BoostParams(patience=3))


# losses


def test_array_losses_equal_the_columns(spark):
    rows = [(float(y), m) for y in (0, 1) for m in (-40.0, -2.0, 0.0, 0.7, 30.0)]
    y, m = (np.array(c) for c in zip(*rows, strict=True))
    df = spark.createDataFrame(rows, "y double, m double").withColumn("p", 1 / (1 + F.exp(-F.col("m"))))
    for loss in (FocalLoss(2.0, 0.3), FocalLoss(1.5)):
        got = df.select(loss.loss("y", "p"), loss.gradient("y", "p"), loss.hessian("y", "p")).collect()
        np.testing.assert_allclose(loss.values(y, m), [r[0] for r in got], rtol=1e-9, atol=1e-300)
        for i, d in enumerate(loss.derivatives(y, m)):
            np.testing.assert_allclose(d, [r[i + 1] for r in got], rtol=1e-6, atol=1e-14)
    labels = spark.createDataFrame([(1,)] * 30 + [(0,)] * 70, "y int")
    assert FocalLoss(2.0, 0.3).start(30, 70) == pytest.approx(focal_init_score(labels, "y", FocalLoss(2.0, 0.3)).first()["init_score"])
    e = 1e-5
    np.testing.assert_allclose(LogLoss().derivatives(y[1:4], m[1:4])[0], (LogLoss().values(y[1:4], m[1:4] + e) - LogLoss().values(y[1:4], m[1:4] - e)) / (2 * e), atol=1e-8)


# Shapley values


def brute_shapley(tree, row, features):
    def value(known, node=0):
        f = tree.feature[node]
        if f == T.LEAF:
            return tree.value[node]
        sides = (tree.left[node], tree.right[node])
        if f in known:
            left = tree.missing_left[node] if np.isnan(row[f]) else row[f] <= tree.threshold[node]
            return value(known, sides[0] if left else sides[1])
        return sum(tree.cover[s] / tree.cover[node] * value(known, s) for s in sides)

    out = np.zeros(features)
    for f in range(features):
        others = [o for o in range(features) if o != f]
        for size in range(features):
            for known in itertools.combinations(others, size):
                share = math.factorial(size) * math.factorial(features - size - 1) / math.factorial(features)
                out[f] += share * (value({*known, f}) - value(set(known)))
    return out, value(set())


def test_shapley_values_equal_all_coalitions_and_sum_to_the_margin(data):
    x, _, df = data
    forest = G.boost(df, "y", "id", params=G.BoostParams(rounds=3, max_depth=5, max_leaves=14, min_rows=5, bins=16)).forests[0]
    got = forest.shapley(x)
    np.testing.assert_allclose(got.sum(axis=1), forest.margins(x), atol=1e-9)
    for i in range(12):
        parts = [brute_shapley(t, x[i], 6) for t in forest.trees]
        expected = sum(w * p for w, (p, _) in zip(forest.weights, parts, strict=True))
        np.testing.assert_allclose(got[i, :-1], expected, atol=1e-9)
        assert got[i, -1] == pytest.approx(forest.init_score + sum(w * e for w, (_, e) in zip(forest.weights, parts, strict=True)))
    column = df.select("id", T.shapley_column(df, forest).alias("s")).orderBy("id").toPandas()
    np.testing.assert_allclose(np.stack(column["s"]), got)


def test_shapley_sums_are_those_of_the_rows(data):
    x, y, df = data
    forest = G.boost(df, "y", "id", params=G.BoostParams(rounds=3, max_depth=3, min_rows=5, bins=16)).forests[0]
    loss, values = LogLoss(), forest.shapley(x)
    got = T.shapley_sums(df, forest, "y", loss.values).orderBy("feature").toPandas()
    margin = forest.margins(x)
    np.testing.assert_allclose(got["importance"], np.abs(values[:, :-1]).mean(axis=0))
    np.testing.assert_allclose(got["loss_change"], [(loss.values(y, margin - values[:, f]) - loss.values(y, margin)).mean() for f in range(6)], atol=1e-12)
    assert set(got["rows"]) == {1500}
