"""Index, join and reshape operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.catalog.fixtures import (
    ORDERS_PANEL,
    USER_DAY_PANEL,
    customer_target,
    orders_panel,
    rounded,
    rounded_sql,
    table,
    user_day_panel,
)
from panelspark.catalog.registry import Registry
from panelspark.operators import panel as P
from panelspark.operators.folds import in_holdout

R = Registry()
SLOTS = range(1, P.LAST_INDEX + 1)


@R.query(
    "SELECT o_orderkey, CAST(month(o_orderdate) AS INT) AS month, CAST(year(o_orderdate) AS INT) AS year FROM orders"
)
def date_parts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("day"))
    return P.date_parts(orders, "day").select("o_orderkey", "month", "year")


@R.query(
    """WITH o AS (SELECT *, year(o_orderdate) * 12 + month(o_orderdate) AS st FROM orders)
    SELECT o_orderkey, o_custkey, CAST(13 - (max(st) OVER (PARTITION BY o_custkey) - st) AS INT) AS ind FROM o"""
)
def statement_index(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    indexed = P.statement_index(orders, "o_custkey", P.month_number("o_orderdate"))
    return indexed.select("o_orderkey", "o_custkey", "ind")


@R.query("SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM customer")
def union_split(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    is_test = F.col("c_custkey") % 5 == 0
    both = P.union_split({"train": customer.filter(~is_test), "test": customer.filter(is_test)})
    # Separated and stacked again, which must lose nothing.
    return P.union_split({name: P.take_split(both, name) for name in ("train", "test")})


@R.query("SELECT DISTINCT o_custkey FROM orders")
def distinct_keys(spark, sf_dir):
    return P.distinct_keys(table(spark, sf_dir, "orders"), "o_custkey")


@R.query(
    f"WITH {USER_DAY_PANEL} SELECT i.id, p.ind FROM (SELECT DISTINCT id FROM panel) i, (SELECT DISTINCT ind FROM panel) p"
)
def cross_grid(spark, sf_dir):
    return P.period_grid(user_day_panel(spark, sf_dir), "id")


@R.query(
    f"""WITH {USER_DAY_PANEL}, grid AS (
      SELECT i.id, p.ind FROM (SELECT DISTINCT id FROM panel) i, (SELECT DISTINCT ind FROM panel) p)
    SELECT g.id, g.ind, coalesce(val, 0) AS val, coalesce(buy, 0) AS buy,
      CAST(x.id IS NOT NULL AS INT) AS present
    FROM grid g LEFT JOIN panel x ON g.id = x.id AND g.ind = x.ind"""
)
def densify_panel(spark, sf_dir):
    return P.densify(user_day_panel(spark, sf_dir), "id", ["val", "buy"], fill=0.0, present="present")


@R.query(
    """SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def label_left_join(spark, sf_dir):
    """Labels cover some documents only."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return P.attach(documents, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), ["doc_id"])


@R.query(
    f"""WITH {ORDERS_PANEL}, sums AS (SELECT id, CAST(count(*) AS INT) AS periods FROM panel GROUP BY id)
    SELECT id, c_nationkey AS pos, periods FROM customer JOIN sums ON c_custkey = id"""
)
def id_inner_join(spark, sf_dir):
    sums = orders_panel(spark, sf_dir).groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("periods"))
    index = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("pos"))
    return P.restrict_to(sums, index, "id", "pos")


@R.query(
    f"""WITH {ORDERS_PANEL}
    SELECT a.id, a.ind, a.amt - b.amt AS amt_diff, a.pend - b.pend AS pend_diff
    FROM panel a LEFT JOIN panel b ON a.id = b.id AND b.ind = a.ind - 1"""
)
def exact_lag_diff(spark, sf_dir):
    diffed = P.exact_lag_diff(orders_panel(spark, sf_dir), "id", ["amt", "pend"])
    return diffed.select("id", "ind", "amt_diff", "pend_diff")


@R.query(
    f"""WITH {ORDERS_PANEL},
    a AS (SELECT id, {rounded_sql("sum(amt)", 2)} AS amt_sum FROM panel WHERE prio <= 2 GROUP BY id),
    b AS (SELECT id, {rounded_sql("sum(pend)", 2)} AS pend_sum FROM panel WHERE pend IS NOT NULL GROUP BY id)
    SELECT coalesce(a.id, b.id) AS id, amt_sum, pend_sum, target FROM a FULL JOIN b ON a.id = b.id
    LEFT JOIN (SELECT c_custkey AS id, CAST(c_acctbal < 0 AS INT) AS target FROM customer) t ON t.id = coalesce(a.id, b.id)"""
)
def assemble_features(spark, sf_dir):
    panel = orders_panel(spark, sf_dir)
    urgent = panel.filter(F.col("prio") <= 2).groupBy("id").agg(rounded(F.sum("amt"), 2).alias("amt_sum"))
    pending = panel.filter(F.col("pend").isNotNull()).groupBy("id").agg(rounded(F.sum("pend"), 2).alias("pend_sum"))
    both = P.assemble_features([urgent, pending], "id")
    return P.assemble_features([both, customer_target(spark, sf_dir)], "id", "left")


@R.query(f"WITH {ORDERS_PANEL} SELECT id, ind, amt FROM panel ORDER BY id, ind")
def sort_panel(spark, sf_dir):
    return P.sort_panel(orders_panel(spark, sf_dir).select("id", "ind", "amt"), "id")


_CELLS = ", ".join(f"coalesce(max(CASE WHEN ind = {p} THEN {v} END), 0) AS {v}_{p}" for v in ("val", "buy") for p in SLOTS)


@R.query(f"WITH {USER_DAY_PANEL} SELECT id, {_CELLS} FROM panel GROUP BY id")
def sequence_pivot(spark, sf_dir):
    return P.sequence_pivot(user_day_panel(spark, sf_dir), "id", ["val", "buy"], periods=SLOTS, fill=0.0)


@R.query(
    "SELECT c_custkey, CAST(substr(md5(CAST(c_custkey AS VARCHAR) || '42'), 1, 8) < '33333333' AS INT) AS holdout FROM customer"
)
def holdout_split(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", in_holdout("c_custkey").cast("int").alias("holdout"))
