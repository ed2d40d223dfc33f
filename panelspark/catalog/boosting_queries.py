"""Boosted trees on customers, in the parts that SQL can state: cuts, splits, small trees, dropped trees, rounds, selection.

Labels and features are whole numbers and the start score is 0, so gradients are halves and sums are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.catalog.fixtures import PRIORITY_CODES, code, code_sql, rounded, rounded_sql, table
from panelspark.catalog.ranking_queries import metric_ctes
from panelspark.catalog.registry import Registry
from panelspark.operators.binning import feature_array, quantile_cuts
from panelspark.operators.boosted_models import HistogramBoosterModel
from panelspark.operators.boosting import BoostParams, boost
from panelspark.operators.categories import ordered_target_statistics, target_statistics
from panelspark.operators.folds import FOLDS, stratified_folds
from panelspark.operators.forest import LEAF, rounds_of
from panelspark.operators.metrics import rank_metrics
from panelspark.operators.models import cv_check
from panelspark.operators.selection import recursive_selection

R = Registry()
FEATURES = ("orders", "urgent", "year")
MIN_ROWS = 20

#: Customers with orders: whether most are open, their number, how many are urgent (missing where none is of status P), and the last year.
CUSTOMERS = f"""customers AS (
  SELECT o_custkey AS id, CAST(2 * count(*) FILTER (o_orderstatus = 'O') > count(*) AS INT) AS y, CAST(count(*) AS DOUBLE) AS orders,
    CAST(CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0
      THEN count(*) FILTER ({code_sql("o_orderpriority", PRIORITY_CODES)} = 1) END AS DOUBLE) AS urgent,
    CAST(max(year(o_orderdate)) AS DOUBLE) AS year
  FROM orders GROUP BY o_custkey)"""


def customers(spark, sf_dir) -> DataFrame:
    """(id, y, features) as ``CUSTOMERS``."""
    pending = F.count(F.when(F.col("o_orderstatus") == "P", 1)) > 0
    urgent = F.count(F.when(code("o_orderpriority", PRIORITY_CODES) == 1, 1))
    is_open = 2 * F.count(F.when(F.col("o_orderstatus") == "O", 1)) > F.count("*")
    rows = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("id"))
        .agg(is_open.cast("int").alias("y"), F.count("*").alias("orders"), F.when(pending, urgent).alias("urgent"), F.max(F.year("o_orderdate")).alias("year"))
    )
    return rows.select("id", "y", feature_array(rows, FEATURES).alias("features"))


BINS = 8


@R.query(
    f"""WITH measures AS (SELECT CAST(f AS INT) AS f, CASE f WHEN 0 THEN CAST(l_quantity AS DOUBLE)
        WHEN 1 THEN CASE WHEN l_returnflag <> 'R' THEN CAST(l_discount AS DOUBLE) END ELSE CAST(l_linenumber AS DOUBLE) END AS v,
        CAST(l_linenumber AS DOUBLE) AS w FROM lineitem, range(0, 3) t(f)),
    ranked AS (SELECT f, v, sum(sum(w)) OVER (PARTITION BY f ORDER BY v) AS upto, sum(sum(w)) OVER (PARTITION BY f) AS total,
        count(*) OVER (PARTITION BY f) AS distinct_values, max(v) OVER (PARTITION BY f) AS top FROM measures WHERE v IS NOT NULL GROUP BY f, v),
    quantiles AS (SELECT f, i, min(v) AS v FROM ranked, range(1, {BINS}) t(i)
        WHERE distinct_values > {BINS} AND upto >= total * i / {BINS}e0 GROUP BY f, i),
    cuts AS (SELECT DISTINCT f, v FROM quantiles UNION SELECT f, v FROM ranked WHERE distinct_values <= {BINS})
    SELECT f AS feature, v AS cut FROM cuts JOIN (SELECT DISTINCT f, top FROM ranked) USING (f) WHERE v < top"""
)
def weighted_cuts(spark, sf_dir):
    """Cuts at the weighted quantiles of three measures, one with missing values."""
    lines = table(spark, sf_dir, "lineitem")
    lines = lines.withColumn("kept", F.when(F.col("l_returnflag") != "R", F.col("l_discount")))
    rows = lines.select(feature_array(lines, ["l_quantity", "kept", "l_linenumber"]).alias("features"), F.col("l_linenumber").cast("double").alias("w"))
    cuts = quantile_cuts(rows, weight="w", bins=BINS)
    return spark.createDataFrame([(f, float(c)) for f, at in enumerate(cuts) for c in at], "feature INT, cut DOUBLE")


def best_split_sql(name: str, rows: str) -> str:
    """CTEs ending in ``name``: the best split of the customers in ``rows``, if there is one, all cuts and both sides for missing values tried."""
    return f"""{name}_cells AS (SELECT f, CASE f WHEN 0 THEN orders WHEN 1 THEN urgent ELSE year END AS v, count(*) AS n, sum(y) AS s
        FROM {rows}, range(0, 3) t(f) GROUP BY 1, 2),
    {name}_all AS (SELECT f, sum(n) AS n, sum(s) AS s, coalesce(sum(n) FILTER (v IS NULL), 0) AS n0, coalesce(sum(s) FILTER (v IS NULL), 0) AS s0
        FROM {name}_cells GROUP BY f),
    {name}_below AS (SELECT g.f, g.v, g.top, coalesce(sum(c.n), 0) AS n, coalesce(sum(c.s), 0) AS s
        FROM grid g LEFT JOIN {name}_cells c ON c.f = g.f AND c.v <= g.v GROUP BY g.f, g.v, g.top),
    {name}_sides AS (SELECT b.f, b.v, b.top, d = 1 AS missing_left, b.n + d * n0 AS nl, b.s + d * s0 AS sl, a.n AS na, a.s AS sa
        FROM {name}_below b JOIN {name}_all a ON a.f = b.f, range(0, 2) t(d)),
    {name}_gains AS (SELECT *, power(nl / 2.0e0 - sl, 2) / (nl / 4.0e0 + 1) + power((na - nl) / 2.0e0 - (sa - sl), 2) / ((na - nl) / 4.0e0 + 1)
          - power(na / 2.0e0 - sa, 2) / (na / 4.0e0 + 1) AS gain FROM {name}_sides WHERE nl >= {MIN_ROWS} AND na - nl >= {MIN_ROWS}),
    {name} AS (SELECT * FROM {name}_gains WHERE gain > 0 AND gain >= (SELECT max(gain) FROM {name}_gains) * (1 - 1e-9)
        ORDER BY f, v, missing_left LIMIT 1)"""


#: The values at which a feature can be cut; the last one holds all.
GRID = """grid AS (SELECT f, v, v = max(v) OVER (PARTITION BY f) AS top FROM (SELECT DISTINCT f,
    CASE f WHEN 0 THEN orders WHEN 1 THEN urgent ELSE year END AS v FROM customers, range(0, 3) t(f)) WHERE v IS NOT NULL)"""
_THRESHOLD = "CASE WHEN top THEN CAST('Infinity' AS DOUBLE) ELSE v END"


def _side_sql(rows: str, split: str, left: bool) -> str:
    goes = f"CASE WHEN x IS NULL THEN {split}.missing_left ELSE x <= {split}.v END"
    value = f"CASE {split}.f WHEN 0 THEN orders WHEN 1 THEN urgent ELSE year END"
    return f"SELECT r.id, r.y, r.orders, r.urgent, r.year FROM (SELECT r.*, {split}.missing_left, {split}.v, {value} AS x FROM {rows} r, {split}) r WHERE {'' if left else 'NOT '}({goes.replace(split + '.', '')})"


def _depth(depth: int) -> BoostParams:
    return BoostParams(rounds=1, max_depth=depth, max_leaves=1 << depth, l2=1.0, min_rows=MIN_ROWS, learning_rate=1.0)


@R.query(
    f"""WITH {CUSTOMERS}, {GRID}, {best_split_sql("best", "customers")}
    SELECT CAST(f AS INT) AS feature, {_THRESHOLD} AS threshold, missing_left, {rounded_sql("gain", 9)} AS gain FROM best"""
)
def best_split(spark, sf_dir):
    """The first split of a tree, missing values tried on both sides."""
    tree = boost(customers(spark, sf_dir), "y", "id", params=_depth(1), init_score=0.0).forests[0].trees[0]
    rows = [(f, tree.threshold[i], tree.missing_left[i], tree.gain[i]) for i, f in enumerate(tree.feature) if f != LEAF]
    found = spark.createDataFrame(rows, "feature INT, threshold DOUBLE, missing_left BOOLEAN, gain DOUBLE")
    return found.withColumn("gain", rounded("gain", 9))


def _node_sql(path: str, rows: str, split: str | None) -> str:
    """One row for a node of which ``split`` may be the split."""
    sums = f"(SELECT count(*) AS n, sum(y) AS s FROM {rows})"
    value = rounded_sql("-(n / 2.0e0 - s) / (n / 4.0e0 + 1)", 9)
    if split is None:
        return f"SELECT '{path}' AS path, -1 AS feature, NULL AS threshold, NULL AS missing_left, CAST(n AS DOUBLE) AS n, {value} AS value FROM {sums} WHERE n > 0"
    threshold, present = f"(SELECT {_THRESHOLD} FROM {split})", f"EXISTS (SELECT 1 FROM {split})"
    return f"""SELECT '{path}' AS path, CASE WHEN {present} THEN (SELECT CAST(f AS INT) FROM {split}) ELSE -1 END AS feature, {threshold} AS threshold,
      (SELECT missing_left FROM {split}) AS missing_left, CAST(n AS DOUBLE) AS n, CASE WHEN NOT {present} THEN {value} END AS value FROM {sums} WHERE n > 0"""


@R.query(
    f"""WITH {CUSTOMERS}, {GRID}, {best_split_sql("top0", "customers")},
    l AS ({_side_sql("customers", "top0", True)}), r AS ({_side_sql("customers", "top0", False)}),
    {best_split_sql("lbest", "l")}, {best_split_sql("rbest", "r")},
    ll AS ({_side_sql("l", "lbest", True)}), lr AS ({_side_sql("l", "lbest", False)}),
    rl AS ({_side_sql("r", "rbest", True)}), rr AS ({_side_sql("r", "rbest", False)})
    {" UNION ALL ".join(_node_sql(*a) for a in (("", "customers", "top0"), ("L", "l", "lbest"), ("R", "r", "rbest"), ("LL", "ll", None), ("LR", "lr", None), ("RL", "rl", None), ("RR", "rr", None)))}"""
)
def two_level_tree(spark, sf_dir):
    """Splits and leaves of a tree of depth two, by the way to each node."""
    tree = boost(customers(spark, sf_dir), "y", "id", params=_depth(2), init_score=0.0).forests[0].trees[0]
    paths, rows = {0: ""}, []
    for i, f in enumerate(tree.feature):
        split = f != LEAF
        if split:
            paths[tree.left[i]], paths[tree.right[i]] = paths[i] + "L", paths[i] + "R"
        at = (tree.threshold[i], tree.missing_left[i]) if split else (None, None)
        rows.append((paths[i], f, *at, tree.cover[i], None if split else tree.value[i]))
    found = spark.createDataFrame(rows, "path STRING, feature INT, threshold DOUBLE, missing_left BOOLEAN, n DOUBLE, value DOUBLE")
    return found.withColumn("value", rounded("value", 9))


def _step_sql(n: str, s: str, margin: str) -> str:
    """The Newton step of a leaf whose rows have one margin."""
    p = f"(1 / (1 + exp(-({margin}))))"
    return f"(-({n} * {p} - {s}) / ({n} * {p} * (1 - {p}) + 1))"


#: Trees that each round leaves out. With k left out, the new tree weighs 0.5 / (k + 1) and they weigh k / (k + 1) as much.
DROPS = ((), (), (0,), (0, 1))
#: Customers by whether they have more than five orders; a tree of depth one has these two leaves.
HALVES = f"""{CUSTOMERS}, halves AS (SELECT orders > 5 AS many, count(*) AS n, sum(y) AS s FROM customers GROUP BY 1),
  t0 AS (SELECT *, {_step_sql("n", "s", "0")} AS t0 FROM halves),
  t1 AS (SELECT *, {_step_sql("n", "s", "0.5e0 * t0")} AS t1 FROM t0)"""


def _halves(spark, sf_dir) -> DataFrame:
    rows = customers(spark, sf_dir)
    many = (F.col("features")[0] > 5).cast("double")
    return rows.select("id", "y", F.array(many).alias("features"))


@R.query(
    f"""WITH {HALVES}, t2 AS (SELECT *, {_step_sql("n", "s", "0.5e0 * t1")} AS t2 FROM t1),
    t3 AS (SELECT *, {_step_sql("n", "s", "0.25e0 * t2")} AS t3 FROM t2)
    SELECT id, {rounded_sql("0.25e0 * 2 / 3 * t0 + 0.5e0 * 2 / 3 * t1 + 0.25e0 * t2 + 0.5e0 / 3 * t3", 9)} AS margin
    FROM customers JOIN t3 ON many = (orders > 5)"""
)
def dart_stumps(spark, sf_dir):
    """Margins after four rounds of stumps of which some leave earlier ones out."""
    rows = _halves(spark, sf_dir)
    params = BoostParams(rounds=4, learning_rate=0.5, max_depth=1, min_rows=1, min_gain=-math.inf, drop_sets=DROPS, checkpoint_every=2)
    model = HistogramBoosterModel(boost(rows, "y", "id", params=params, init_score=0.0).forests[0])
    return model.scores(rows, ["id"]).select("id", rounded("margin", 9).alias("margin"))


@R.query(
    f"""WITH {HALVES}, t2 AS (SELECT *, {_step_sql("n", "s", "0.5e0 * t0 + 0.5e0 * t1")} AS t2 FROM t1),
    staged AS (SELECT id AS doc_id, y, round, CASE round WHEN 1 THEN 0.5e0 * t0 WHEN 2 THEN 0.5e0 * t0 + 0.5e0 * t1
      ELSE 0.5e0 * t0 + 0.5e0 * t1 + 0.5e0 * t2 END AS margin FROM customers JOIN t2 ON many = (orders > 5), range(1, 4) t(round)),
    {metric_ctes("staged", "margin", "round")} SELECT CAST(part AS INT) AS round, {rounded_sql("metric", 9)} AS metric FROM result"""
)
def staged_metric(spark, sf_dir):
    """The rank metric after each round, from one scoring and one ordering."""
    rows = _halves(spark, sf_dir)
    params = BoostParams(rounds=3, learning_rate=0.5, max_depth=1, min_rows=1, min_gain=-math.inf)
    model = HistogramBoosterModel(boost(rows, "y", "id", params=params, init_score=0.0).forests[0])
    scored = rounds_of(model.staged(rows, ["id", "y"]), ["id", "y"])
    return rank_metrics(scored, "y", "margin", "id", ["round"]).select("round", rounded("metric", 9).alias("metric"))


@R.query(
    f"""WITH {CUSTOMERS}, folds AS (SELECT id, y, orders > 5 AS many,
      CAST((row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS VARCHAR) || '42'), id) - 1) % {FOLDS} AS INT) AS fold FROM customers),
    sums AS (SELECT many, fold, sum(y) AS s, count(*) AS n, sum(sum(y)) OVER (PARTITION BY many) AS all_s,
      sum(count(*)) OVER (PARTITION BY many) AS all_n FROM folds GROUP BY 1, 2),
    scored AS (SELECT id AS doc_id, y, fold, 0.5e0 * {_step_sql("(all_n - n)", "(all_s - s)", "0")} AS margin FROM folds JOIN sums USING (many, fold)),
    losses AS (SELECT fold, avg(-CASE WHEN y = 1 THEN -ln(1 + exp(-margin)) ELSE -ln(1 + exp(margin)) END) AS log_loss FROM scored GROUP BY fold),
    {metric_ctes("scored", "margin", "fold")}
    SELECT fold, {rounded_sql("metric", 9)} AS metric, {rounded_sql("log_loss", 9)} AS log_loss, 1 AS trees FROM result JOIN losses ON part = fold"""
)
def cv_check_stump(spark, sf_dir):
    """The report per fold of one stump."""
    rows = _halves(spark, sf_dir)
    rows = rows.join(stratified_folds(rows.select("id", "y"), "id", "y", FOLDS).select("id", "fold"), "id")
    params = BoostParams(rounds=1, learning_rate=0.5, max_depth=1, min_rows=1, min_gain=-math.inf)
    report = cv_check(rows, params, "id", "y", FOLDS, init_score=0.0)
    return report.select("fold", rounded("metric", 9).alias("metric"), rounded("log_loss", 9).alias("log_loss"), "trees")


@R.query(
    f"""WITH {CUSTOMERS}, {GRID}, {best_split_sql("best", "customers")},
    names AS (SELECT * FROM (VALUES (0, 'orders'), (1, 'urgent'), (2, 'year')) t(f, feature)),
    ranked AS (SELECT feature, CAST(row_number() OVER (ORDER BY CASE WHEN f IN (SELECT f FROM best) THEN 0 ELSE 1 END, f) - 1 AS INT) AS pos FROM names)
    SELECT criterion, target, pos, feature FROM ranked, (VALUES ('shap'), ('importance')) c(criterion), (VALUES (2), (1)) s(target) WHERE pos < target"""
)
def selection_stump(spark, sf_dir):
    """Features that are left when all but the one of the best split are of no use."""
    rows, chosen = customers(spark, sf_dir), []
    for by in ("shap", "importance"):
        kept = recursive_selection(rows, "y", "id", FEATURES, _depth(1), targets=(2, 1), steps=1, by=by, init_score=0.0)
        chosen += [(by, size, i, name) for size, names in kept.items() for i, name in enumerate(names)]
    return spark.createDataFrame(chosen, "criterion STRING, target INT, pos INT, feature STRING")


#: Orders with their customer and priority, a label, and whether they are training rows.
ORDERS = """rows AS (SELECT o_orderkey AS id, CAST(o_totalprice > 150000 AS INT) AS y, CAST(o_custkey AS VARCHAR) AS customer,
    CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderpriority END AS priority, o_orderkey % 4 = 0 AS held FROM orders)"""


def _orders(spark, sf_dir) -> DataFrame:
    priority = F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_totalprice") > 150000).cast("int").alias("y"),
        F.col("o_custkey").cast("string").alias("customer"),
        priority.alias("priority"),
        (F.col("o_orderkey") % 4 == 0).alias("held"),
    )


def _before_sql(category: str) -> str:
    over = f"OVER (PARTITION BY {category} ORDER BY md5(CAST(id AS VARCHAR) || '42'), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"(coalesce(sum(y) {over}, 0) + prior) / (count(*) {over} + 1)"


@R.query(
    f"""WITH {ORDERS}, train AS (SELECT *, (SELECT avg(CAST(y AS DOUBLE)) FROM rows WHERE NOT held) AS prior FROM rows WHERE NOT held)
    SELECT id, {rounded_sql(_before_sql("customer"), 9)} AS customer_ts, {rounded_sql(_before_sql("priority"), 9)} AS priority_ts FROM train"""
)
def ordered_categories(spark, sf_dir):
    """Of each training row and two categories, the smoothed mean label of the rows before it."""
    found = ordered_target_statistics(_orders(spark, sf_dir).filter("NOT held"), "id", "y", ["customer", "priority"])
    return found.select("id", *[rounded(c, 9).alias(c) for c in ("customer_ts", "priority_ts")])


@R.query(
    f"""WITH {ORDERS}, prior AS (SELECT avg(CAST(y AS DOUBLE)) AS prior FROM rows WHERE NOT held),
    customers AS (SELECT customer, sum(y) AS s, count(*) AS n FROM rows WHERE NOT held GROUP BY customer),
    priorities AS (SELECT priority, sum(y) AS s, count(*) AS n FROM rows WHERE NOT held GROUP BY priority)
    SELECT id, {rounded_sql("(coalesce(c.s, 0) + prior) / (coalesce(c.n, 0) + 1)", 9)} AS customer_ts,
      {rounded_sql("(coalesce(p.s, 0) + prior) / (coalesce(p.n, 0) + 1)", 9)} AS priority_ts
    FROM rows r CROSS JOIN prior LEFT JOIN customers c ON c.customer IS NOT DISTINCT FROM r.customer
    LEFT JOIN priorities p ON p.priority IS NOT DISTINCT FROM r.priority WHERE held"""
)
def scored_categories(spark, sf_dir):
    """Of rows to be scored, the smoothed mean label of all training rows of their categories."""
    rows = _orders(spark, sf_dir)
    found = target_statistics(rows.filter("held"), rows.filter("NOT held"), "id", "y", ["customer", "priority"])
    return found.select("id", *[rounded(c, 9).alias(c) for c in ("customer_ts", "priority_ts")])

