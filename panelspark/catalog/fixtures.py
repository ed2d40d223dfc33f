"""Panels and score frames derived from the given tables, in Spark and as SQL text.

Amounts are summed as whole cents, which is exact in any order, and divided once at the end, so both
engines see the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.panel import month_number, panel_index
from panelspark.sources.tables import read_panel

# Fixed values of the given tables.
EVENT_CODES = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
PRIORITY_CODES = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_panel(spark, f"{sf_dir}/{name}.parquet")


def money(amount: Column) -> Column:
    """The sum of an amount with two decimals."""
    return F.sum(F.rint(amount * F.lit(100.0)).cast("long")) / F.lit(100.0)


def money_sql(amount: str, where: str | None = None) -> str:
    kept = f" FILTER (WHERE {where})" if where else ""
    return f"CAST(sum(CAST(round_even({amount} * 100.0e0, 0) AS BIGINT)){kept} AS DOUBLE) / 100.0e0"


def code(column: str, codes: dict[str, int]) -> Column:
    """The code of a text; one without a code fails the query."""
    known = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    unknown = F.raise_error(F.concat(F.lit(f"no code for {column} "), F.col(column)))
    value = F.get(F.array(known[F.col(column)]), F.lit(0))
    return F.when(F.col(column).isNull(), F.lit(None)).when(value.isNotNull(), value).otherwise(unknown.cast("int")).cast("int")


def code_sql(column: str, codes: dict[str, int]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in codes.items())
    return f"CASE {column} {cases} ELSE error('no code') END"


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ind) of customer and month: amt, n, pend (null without pending orders), prio."""
    price, pending = F.col("o_totalprice"), F.col("o_orderstatus") == "P"
    monthly = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("id"), month_number("o_orderdate").alias("st"))
        .agg(
            money(price).alias("amt"),
            F.count(F.lit(1)).cast("double").alias("n"),
            money(F.when(pending, price)).alias("pend"),
            F.min(code("o_orderpriority", PRIORITY_CODES)).alias("prio"),
        )
    )
    return panel_index(monthly, "id", "st")


ORDERS_PANEL = f"""orders_month AS (
  SELECT o_custkey AS id, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS st,
    {money_sql("o_totalprice")} AS amt, CAST(count(*) AS DOUBLE) AS n,
    {money_sql("o_totalprice", "o_orderstatus = 'P'")} AS pend,
    CAST(min({code_sql("o_orderpriority", PRIORITY_CODES)}) AS INT) AS prio
  FROM orders GROUP BY 1, 2),
panel AS (SELECT *, CAST(13 - (max(st) OVER (PARTITION BY id) - st) AS INT) AS ind FROM orders_month)"""


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ind) of supplier and ship month: qty, price, disc, ret_qty (null without returns)."""
    quantity, returned = F.col("l_quantity"), F.col("l_returnflag") == "R"
    monthly = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("id"), month_number("l_shipdate").alias("st"))
        .agg(
            F.sum(quantity).alias("qty"),
            money(F.col("l_extendedprice")).alias("price"),
            money(F.col("l_discount")).alias("disc"),
            F.sum(F.when(returned, quantity)).alias("ret_qty"),
        )
    )
    return panel_index(monthly, "id", "st")


SUPPLIER_MEASURES = ("qty", "price", "disc", "ret_qty")

SUPPLIER_PANEL = f"""supplier_month AS (
  SELECT l_suppkey AS id, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INT) AS st,
    sum(l_quantity) AS qty, {money_sql("l_extendedprice")} AS price,
    {money_sql("l_discount")} AS disc,
    sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS ret_qty
  FROM lineitem GROUP BY 1, 2),
panel AS (SELECT *, CAST(13 - (max(st) OVER (PARTITION BY id) - st) AS INT) AS ind FROM supplier_month)"""


def user_day_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ind) of user and day: val, buy (null without purchases), n_types, top_type."""
    daily = (
        table(spark, sf_dir, "events")
        .withColumn("kind", code("event_type", EVENT_CODES))
        .groupBy(F.col("user_id").alias("id"), F.datediff("ts", F.lit("2024-01-01")).alias("st"))
        .agg(
            money(F.col("value")).alias("val"),
            money(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("buy"),
            F.count_distinct("event_type").cast("int").alias("n_types"),
            F.min("kind").alias("top_type"),
        )
    )
    return panel_index(daily, "id", "st")


USER_DAY_PANEL = f"""event_kind AS (
  SELECT *, {code_sql("event_type", EVENT_CODES)} AS kind FROM events),
user_day AS (
  SELECT user_id AS id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS st,
    {money_sql("value")} AS val,
    {money_sql("value", "event_type = 'purchase'")} AS buy,
    CAST(count(DISTINCT event_type) AS INT) AS n_types, CAST(min(kind) AS INT) AS top_type
  FROM event_kind GROUP BY 1, 2),
panel AS (SELECT *, CAST(13 - (max(st) OVER (PARTITION BY id) - st) AS INT) AS ind FROM user_day)"""


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, y and three scores of every labelled document; n_chars has real ties."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return labels.join(documents, "doc_id").select(
        "doc_id",
        "y",
        F.col("n_chars").cast("double").alias("s1"),
        ((F.col("doc_id") * 7919) % 1009).cast("double").alias("s2"),
        (F.col("n_chars") % 97).cast("double").alias("s3"),
    )


SCORED_LABELS = """scored AS (
  SELECT l.doc_id, l.toxic AS y, CAST(d.n_chars AS DOUBLE) AS s1,
    CAST((l.doc_id * 7919) % 1009 AS DOUBLE) AS s2, CAST(d.n_chars % 97 AS DOUBLE) AS s3
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def customer_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, target) of every customer; the target is a negative balance."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_acctbal") < 0).cast("int").alias("target")
    )


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Round half to even with plain double arithmetic, which both engines do alike.

    Negative ``digits`` are significant ones: the value is scaled by a power of ten of its own size, so small
    values keep theirs. Adding zero turns a negative zero into a positive one.
    """
    value = F.col(column) if isinstance(column, str) else column
    if digits >= 0:
        factor = F.lit(10.0**digits)
        return F.rint(value * factor) / factor + F.lit(0.0)
    size = F.abs(value)
    factor = F.pow(F.lit(10.0), F.lit(-digits - 1.0) - F.floor(F.log10(size)))
    return F.when((size > 0) & (size < F.lit(float("inf"))), F.rint(value * factor) / factor).otherwise(value + F.lit(0.0))


def rounded_sql(expression: str, digits: int = 6) -> str:
    if digits >= 0:
        return f"(round_even(({expression}) * 1e{digits}, 0) / 1e{digits} + 0.0e0)"
    value = f"({expression})"
    factor = f"power(10.0e0, {-digits - 1}.0e0 - floor(log10(abs({value}))))"
    finite = f"abs({value}) > 0 AND abs({value}) < CAST('Infinity' AS DOUBLE)"
    return f"(CASE WHEN {finite} THEN round_even({value} * {factor}, 0) / {factor} ELSE {value} + 0.0e0 END)"


def double_sql(value: float) -> str:
    """A literal DuckDB reads as DOUBLE, not as DECIMAL."""
    text = repr(float(value))
    return text if "e" in text else f"{text}e0"
