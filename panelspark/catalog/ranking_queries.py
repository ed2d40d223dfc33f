"""Ranks, metrics, folds and blends over scored documents and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.catalog.fixtures import SCORED_LABELS, rounded, rounded_sql, scored_labels, table
from panelspark.catalog.registry import Registry
from panelspark.functions.losses import FocalLoss
from panelspark.functions.numeric import sigmoid
from panelspark.operators import blend as B
from panelspark.operators import metrics as M
from panelspark.operators.folds import stratified_folds as folds_of
from panelspark.operators.ranking import percent_rank, running_total

R = Registry()
LOSS = FocalLoss(gamma=2.0, alpha=0.3)


def pct_sql(score: str, partition: str = "") -> str:
    over = f"PARTITION BY {partition}" if partition else ""
    ties = f"PARTITION BY {partition + ', ' if partition else ''}{score}"
    return f"(rank() OVER ({over} ORDER BY {score}) + (count(*) OVER ({ties}) - 1) / 2.0e0) / count(*) OVER ({over})"


@R.query(f"WITH {SCORED_LABELS} SELECT doc_id, {rounded_sql(pct_sql('s1'), 9)} AS r1, {rounded_sql(pct_sql('s3'), 9)} AS r3 FROM scored")
def pct_rank_avg(spark, sf_dir):
    rows = scored_labels(spark, sf_dir).select("doc_id", "s1", "s3")
    ranked = percent_rank(percent_rank(rows, "s1", "r1"), "s3", "r3")
    return ranked.select("doc_id", rounded("r1", 9).alias("r1"), rounded("r3", 9).alias("r3"))


@R.query(
    """SELECT event_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 20 END)
      OVER (ORDER BY value DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_weight FROM events"""
)
def global_cumsum(spark, sf_dir):
    weight = F.when(F.col("event_type") == "purchase", 1).otherwise(20).cast("long")
    rows = table(spark, sf_dir, "events").select("event_id", "value", weight.alias("w"))
    order = [F.col("value").desc(), F.col("event_id").desc()]
    return running_total(rows, order, {"cum_weight": F.col("w")}).select("event_id", "cum_weight")


def metric_ctes(source: str, score: str, partition: str) -> str:
    """CTEs ending in ``result`` (partition, capture, gini, metric), by the definition over sorted rows."""

    def area(order: str) -> str:
        over = f"OVER (PARTITION BY part ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
        return f"sum(y * w) {over} / p - sum(w) {over} / t"

    return f"""weighted AS (SELECT *, {partition} AS part, CASE WHEN y = 0 THEN 20.0e0 ELSE 1.0e0 END AS w FROM {source}),
    totals AS (SELECT *, sum(w) OVER (PARTITION BY part) AS t, sum(y) OVER (PARTITION BY part) AS p FROM weighted),
    curves AS (SELECT part, y, w, t, p,
        sum(w) OVER (PARTITION BY part ORDER BY {score} DESC, doc_id DESC ROWS UNBOUNDED PRECEDING) AS cum,
        {area(f"{score} DESC, doc_id DESC")} AS by_score, {area("y DESC, doc_id DESC")} AS by_label FROM totals),
    shares AS (SELECT part, sum(CASE WHEN cum <= floor(0.04e0 * t) THEN y ELSE 0 END) / any_value(p) AS capture,
        sum(by_score * w) / sum(by_label * w) AS gini FROM curves GROUP BY part),
    result AS (SELECT *, 0.5e0 * (gini + capture) AS metric FROM shares)"""


def _metric_query(name: str, column: str) -> None:
    def query(spark, sf_dir):
        scores = M.rank_metrics(scored_labels(spark, sf_dir), "y", "s1", "doc_id")
        return scores.select(rounded(column, 9).alias(column))

    query.__name__ = name
    R.query(f"WITH {SCORED_LABELS}, {metric_ctes('scored', 's1', '0')} SELECT {rounded_sql(column, 9)} AS {column} FROM result")(query)


_metric_query("top_capture", "capture")
_metric_query("weighted_gini", "gini")
_metric_query("combined_metric", "metric")

FOLDS = """folded AS (SELECT *, CAST((row_number() OVER (PARTITION BY y
  ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id) - 1) % 5 AS INT) AS fold FROM scored)"""


def _folded(spark, sf_dir):
    rows = scored_labels(spark, sf_dir)
    return rows.join(folds_of(rows, "doc_id", "y").drop("y"), "doc_id")


@R.query(
    f"""WITH {SCORED_LABELS}, {FOLDS}, {metric_ctes('folded', 's1', 'fold')},
    {metric_ctes('folded', 's1', '0').replace('weighted', 'weighted_all').replace('totals', 'totals_all')
     .replace('curves', 'curves_all').replace('shares', 'shares_all').replace('result', 'result_all')},
    reports AS (SELECT 'fold' AS scope, part AS fold, metric FROM result
      UNION ALL SELECT 'mean', NULL, avg(metric) FROM result UNION ALL SELECT 'all', NULL, metric FROM result_all)
    SELECT scope, CAST(fold AS INT) AS fold, {rounded_sql('metric', 9)} AS metric FROM reports"""
)
def metric_by_fold(spark, sf_dir):
    report = M.metric_by_fold(_folded(spark, sf_dir), "y", "s1", "doc_id")
    return report.withColumn("metric", rounded("metric", 9))


@R.query(
    f"""WITH {SCORED_LABELS}, ranked AS (SELECT *, s2 / 1008.0e0 AS q,
      rank() OVER (ORDER BY s2) + (count(*) OVER (PARTITION BY s2) - 1) / 2.0e0 AS r FROM scored),
    clipped AS (SELECT *, least(greatest(q, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS c FROM ranked)
    SELECT {rounded_sql("(sum(r * y) - sum(y) * (sum(y) + 1) / 2.0e0) / (sum(y) * (count(*) - sum(y)))", 9)} AS auc,
      {rounded_sql("avg(-CASE WHEN y = 1 THEN ln(c) ELSE ln(1 - c) END)", 9)} AS log_loss FROM clipped"""
)
def auc_logloss(spark, sf_dir):
    rows = scored_labels(spark, sf_dir).withColumn("q", F.col("s2") / 1008.0)
    out = M.auc_log_loss(rows, "y", "q")
    return out.select(rounded("auc", 9).alias("auc"), rounded("log_loss", 9).alias("log_loss"))


# The derivatives are spelled out by class here: z is the probability of the true class.
_TERMS = """terms AS (SELECT *, CASE WHEN y = 1 THEN 0.3e0 ELSE 1 - 0.3e0 END AS a, CASE WHEN y = 1 THEN 1 ELSE -1 END AS sgn,
    CASE WHEN y = 1 THEN c ELSE 1 - c END AS z
  FROM (SELECT *, least(greatest(q, 1e-15), 1 - 1e-15) AS c FROM probs))"""
_FOCAL = "-a * power(1 - z, 2) * ln(z)"


@R.query(
    f"""WITH {SCORED_LABELS}, probs AS (SELECT *, s2 / 1008.0e0 AS q FROM scored), {_TERMS}
    SELECT doc_id, {rounded_sql(_FOCAL, 9)} AS loss,
      {rounded_sql("a * sgn * power(1 - z, 2) * (2 * z * ln(z) + z - 1)", 9)} AS gradient,
      {rounded_sql("a * z * (1 - z) * (power(1 - z, 2) * (2 * ln(z) + 3) - 2 * (1 - z) * (2 * z * ln(z) + z - 1))", 9)} AS hessian
    FROM terms"""
)
def focal_terms(spark, sf_dir):
    rows = scored_labels(spark, sf_dir).withColumn("q", F.col("s2") / 1008.0)
    return rows.select(
        "doc_id",
        rounded(LOSS.loss("y", "q"), 9).alias("loss"),
        rounded(LOSS.gradient("y", "q"), 9).alias("gradient"),
        rounded(LOSS.hessian("y", "q"), 9).alias("hessian"),
    )


@R.query(
    f"""WITH {SCORED_LABELS}, probs AS (SELECT *, 1 / (1 + exp(-(s3 - 48) / 16.0e0)) AS q FROM scored), {_TERMS}
    SELECT {rounded_sql(f"avg({_FOCAL})", 9)} AS focal_loss FROM terms"""
)
def focal_loss_mean(spark, sf_dir):
    rows = scored_labels(spark, sf_dir).withColumn("raw", (F.col("s3") - 48) / 16.0)
    return M.mean_focal_loss(rows, "y", "raw", LOSS).select(rounded("focal_loss", 9).alias("focal_loss"))


def _total_sql(p: str) -> str:
    return f"(n1 * (-0.3e0 * power(1 - {p}, 2) * ln({p})) + n0 * (-(1 - 0.3e0) * power({p}, 2) * ln(1 - {p})))"


@R.query(
    f"""WITH counts AS (SELECT sum(toxic) AS n1, count(*) - sum(toxic) AS n0 FROM labels JOIN documents USING (doc_id)),
    coarse AS (SELECT n1, n0, i / 10000.0e0 AS p FROM counts, range(1, 10000) t(i)),
    best AS (SELECT n1, n0, p FROM coarse ORDER BY {_total_sql('p')}, p LIMIT 1),
    fine AS (SELECT n1, n0, p + i / 1000000.0e0 AS p FROM best, range(-99, 100) t(i)),
    found AS (SELECT p FROM fine ORDER BY {_total_sql('p')}, p LIMIT 1)
    SELECT {rounded_sql('p', 6)} AS best_p, {rounded_sql('ln(p / (1 - p))', 6)} AS init_score FROM found"""
)
def focal_init_score(spark, sf_dir):
    found = M.focal_init_score(scored_labels(spark, sf_dir), "y", LOSS)
    return found.select(rounded("best_p").alias("best_p"), rounded("init_score").alias("init_score"))


@R.query(
    f"""WITH imp AS (SELECT CAST(l_partkey AS VARCHAR) AS feature, l_suppkey % 5 AS fold, sum(l_quantity) AS importance
      FROM lineitem GROUP BY 1, 2)
    SELECT feature, {rounded_sql('avg(importance)')} AS importance FROM imp GROUP BY feature
    ORDER BY avg(importance) DESC, feature LIMIT 40"""
)
def top_importances(spark, sf_dir):
    imp = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").cast("string").alias("feature"), (F.col("l_suppkey") % 5).alias("fold"))
        .agg(F.sum("l_quantity").alias("importance"))
    )
    return M.top_importances(imp).withColumn("importance", rounded("importance"))


@R.query(
    """SELECT c_custkey, CAST(c_acctbal < 0 AS INT) AS target, CAST((row_number() OVER (PARTITION BY c_acctbal < 0
      ORDER BY md5(CAST(c_custkey AS VARCHAR) || '42'), c_custkey) - 1) % 5 AS INT) AS fold FROM customer"""
)
def stratified_folds(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") < 0).cast("int").alias("target"))
    return folds_of(rows, "c_custkey", "target")


# Predictions of five fold models for every document: the scores bent differently by each model.
PREDICTIONS = """predictions AS (SELECT doc_id, CAST(k AS INT) AS fold, (s2 * (k + 1)) % 127 AS prediction
  FROM scored, range(0, 5) t(k))"""


def _fold_predictions(spark, sf_dir):
    models = F.explode(F.sequence(F.lit(0), F.lit(4)))
    rows = scored_labels(spark, sf_dir).select("doc_id", "s2", models.alias("fold"))
    return rows.select("doc_id", "fold", ((F.col("s2") * (F.col("fold") + 1)) % 127).alias("prediction"))


@R.query(
    f"""WITH {SCORED_LABELS}, {PREDICTIONS}, ranked AS (SELECT doc_id, {pct_sql('prediction', 'fold')} AS r FROM predictions)
    SELECT doc_id, {rounded_sql('avg(r)', 9)} AS prediction FROM ranked GROUP BY doc_id"""
)
def fold_rank_average(spark, sf_dir):
    averaged = B.fold_rank_average(_fold_predictions(spark, sf_dir), "doc_id")
    return averaged.withColumn("prediction", rounded("prediction", 9))


@R.query(
    f"WITH {SCORED_LABELS}, {PREDICTIONS} SELECT doc_id, fold, {rounded_sql(pct_sql('prediction', 'fold'), 9)} AS prediction FROM predictions"
)
def fold_rank(spark, sf_dir):
    ranked = B.fold_rank(_fold_predictions(spark, sf_dir), "doc_id")
    return ranked.withColumn("prediction", rounded("prediction", 9))


_BLEND = f"0.6e0 * {pct_sql('s1')} + 0.15e0 * {pct_sql('s2')} + 0.25e0 * {pct_sql('s3')}"


def _models(spark, sf_dir):
    rows = scored_labels(spark, sf_dir)
    return {m: rows.select("doc_id", F.col(m).alias("prediction")) for m in ("s1", "s2", "s3")}


@R.query(f"WITH {SCORED_LABELS} SELECT doc_id, {rounded_sql(_BLEND, 9)} AS prediction FROM scored")
def rank_blend(spark, sf_dir):
    blended = B.rank_blend(_models(spark, sf_dir), {"s1": 0.6, "s2": 0.15, "s3": 0.25}, "doc_id")
    return blended.withColumn("prediction", rounded("prediction", 9))


@R.query(
    f"""WITH {SCORED_LABELS}, once AS (SELECT *, 0.5e0 * {pct_sql('s1')} + 0.5e0 * {pct_sql('s2')} AS b FROM scored)
    SELECT doc_id, {rounded_sql(f"0.95e0 * {pct_sql('b')} + 0.05e0 * {pct_sql('s3')}", 9)} AS prediction FROM once"""
)
def rank_blend_chain(spark, sf_dir):
    models = _models(spark, sf_dir)
    blended = B.rank_blend_chain(models["s1"], [(models["s2"], 0.5), (models["s3"], 0.05)], "doc_id")
    return blended.withColumn("prediction", rounded("prediction", 9))
