"""Cleaning operators over lineitem measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.catalog.fixtures import ORDERS_PANEL, double_sql, orders_panel, rounded, rounded_sql, table
from panelspark.catalog.registry import Registry
from panelspark.functions import cleaning
from panelspark.functions.cleaning import Override
from panelspark.operators import panel as P
from panelspark.operators.profile import binary_collapse as collapse
from panelspark.operators.profile import snap_zero_one as snap
from panelspark.plans.denoise import (
    D_63_CODES,
    D_64_CODES,
    S_8_GRID,
    S_8_OVERRIDES,
    S_13_GRID,
    S_13_OVERRIDES,
    credit_panel_preset,
    denoise,
)

R = Registry()
KEYS = ["l_orderkey", "l_linenumber"]
KEY_SQL = "l_orderkey, l_linenumber"


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with ``disc``, the discount with zeros taken for missing."""
    return table(spark, sf_dir, "lineitem").withColumn("disc", F.nullif(F.col("l_discount"), F.lit(0.0)))


LINEITEM = "li AS (SELECT *, nullif(l_discount, 0) AS disc FROM lineitem)"


def ordinal_sql(x: str, interval: float = 1.0, offset: float = 0.0) -> str:
    shifted = f"({x} + {double_sql(offset)})" if offset else x
    return f"CAST(coalesce(floor({shifted} / {double_sql(interval)} + 1e-6), -1) AS INT)"


def grid_sql(x: str, points) -> str:
    whens = " ".join(
        f"WHEN {x} >= {double_sql(p)} AND {x} <= {double_sql(p + 0.01)} THEN {double_sql(p)}" for p in points
    )
    return f"CASE {whens} ELSE {x} END"


def override_ctes(source: str, column: str, rules: list[Override], prefix: str) -> tuple[str, str]:
    """One CTE per rule, each reading the one before; returns the text and the last name."""
    text = []
    for i, r in enumerate(rules):
        name = f"{prefix}{i}"
        text.append(
            f"{name} AS (SELECT * REPLACE (CASE WHEN {column} >= {double_sql(r.low)} AND {column} <= {double_sql(r.high)} "
            f"AND {r.condition} THEN {double_sql(r.value)} ELSE {column} END AS {column}) FROM {source})"
        )
        source = name
    return ", ".join(text), source


@R.query("SELECT user_id, CAST(ts AS DATE) AS day, value FROM events")
def scan_panel(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "value")


@R.query(f"WITH {LINEITEM} SELECT {KEY_SQL}, {ordinal_sql('disc', 0.01)} AS ord FROM li")
def ordinalize(spark, sf_dir):
    return lineitem(spark, sf_dir).select(*KEYS, cleaning.ordinalize("disc", 0.01).alias("ord"))


@R.query(
    f"WITH {LINEITEM} SELECT {KEY_SQL}, {ordinal_sql('disc', 1 / 25, 5 / 25)} AS ord, "
    f"{ordinal_sql('l_tax', 1 / 48, 5 / 48)} AS ord_tax FROM li"
)
def ordinalize_offset(spark, sf_dir):
    return lineitem(spark, sf_dir).select(
        *KEYS,
        cleaning.ordinalize("disc", 1 / 25, 5 / 25).alias("ord"),
        cleaning.ordinalize("l_tax", 1 / 48, 5 / 48).alias("ord_tax"),
    )


@R.query(
    f"WITH {LINEITEM} SELECT {KEY_SQL}, CASE WHEN disc IS NOT NULL THEN least(greatest(disc, -999), 0.05e0) END AS clipped, "
    f"least(greatest(l_quantity - 30, -10), 10)::DOUBLE AS both FROM li"
)
def clip_range(spark, sf_dir):
    return lineitem(spark, sf_dir).select(
        *KEYS,
        cleaning.clip_range("disc", 0.05).alias("clipped"),
        cleaning.clip_range(F.col("l_quantity") - 30, 10, -10).alias("both"),
    )


@R.query("SELECT event_id, CASE WHEN value <= 5 THEN 0 ELSE value END AS value FROM events")
def threshold_zero(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", cleaning.threshold_zero("value", 5.0).alias("value"))


@R.query(f"WITH {LINEITEM} SELECT {KEY_SQL}, CAST(coalesce(floor(disc * 100), -1) AS INT) AS scaled FROM li")
def scale_floor(spark, sf_dir):
    return lineitem(spark, sf_dir).select(*KEYS, cleaning.scale_floor("disc", 100.0).alias("scaled"))


@R.query(
    f"WITH {LINEITEM} SELECT {KEY_SQL}, CAST(coalesce(round_even(disc * 3166, 0), -1) AS INT) AS scaled, "
    "CAST(round_even(l_quantity * 0.5e0, 0) AS INT) AS halves FROM li"
)
def scale_round_even(spark, sf_dir):
    return lineitem(spark, sf_dir).select(
        *KEYS,
        cleaning.scale_round_even("disc", 3166.0).alias("scaled"),
        cleaning.scale_round_even("l_quantity", 0.5).alias("halves"),
    )


@R.query(
    f"WITH x AS (SELECT {KEY_SQL}, l_extendedprice / 100000 AS v FROM lineitem) "
    f"SELECT {KEY_SQL}, {grid_sql('v', S_13_GRID)} AS snapped FROM x"
)
def snap_grid(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(*KEYS, (F.col("l_extendedprice") / 100000).alias("v"))
    return x.select(*KEYS, cleaning.snap_grid("v", S_13_GRID).alias("snapped"))


_OVERRIDES, _OVERRIDDEN = override_ctes("x", "v", S_8_OVERRIDES, "rule")


@R.query(
    f"WITH x AS (SELECT {KEY_SQL}, l_extendedprice / 80000 AS v, CAST(round(l_tax * 100) AS INT) AS S_15 FROM lineitem), "
    f"{_OVERRIDES} SELECT {KEY_SQL}, v FROM {_OVERRIDDEN}"
)
def conditional_override(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(
        *KEYS, (F.col("l_extendedprice") / 80000).alias("v"), F.round(F.col("l_tax") * 100).cast("int").alias("S_15")
    )
    return x.select(*KEYS, cleaning.conditional_override("v", S_8_OVERRIDES).alias("v"))


@R.query(
    f"SELECT {KEY_SQL}, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS flag_code, "
    "CASE nullif(l_linestatus, 'O') WHEN 'F' THEN 0 ELSE -1 END AS status_code FROM lineitem"
)
def dict_encode(spark, sf_dir):
    status = F.nullif(F.col("l_linestatus"), F.lit("O"))
    return table(spark, sf_dir, "lineitem").select(
        *KEYS,
        cleaning.dict_encode("l_returnflag", {"A": 0, "N": 1, "R": 2}).alias("flag_code"),
        cleaning.dict_encode(status, {"F": 0}, -1).alias("status_code"),
    )


# Columns whose noise above 0 and 1 is isolated (both, flag), is not (mixed), or is only at 0 (zero).
NOISY = """noisy AS (SELECT l_orderkey, l_linenumber,
    CASE WHEN l_returnflag = 'R' THEN 1 + l_tax / 10 ELSE l_discount / 10 END AS both_ends,
    CASE WHEN l_linestatus = 'F' THEN NULL WHEN l_returnflag = 'R' THEN 1 ELSE 0 END::DOUBLE AS flag,
    l_discount AS mixed,
    CASE WHEN l_discount <= 0.05e0 THEN l_discount / 5 ELSE l_quantity + 1 END AS zero_end,
    CASE WHEN l_returnflag = 'A' THEN l_discount / 10 ELSE -l_quantity END AS negative
  FROM lineitem)"""
NOISY_COLUMNS = ["both_ends", "flag", "mixed", "zero_end", "negative"]


def noisy(spark, sf_dir):
    returned = F.col("l_returnflag") == "R"
    flag = F.when(F.col("l_linestatus") == "F", None).when(returned, 1.0).otherwise(0.0)
    return table(spark, sf_dir, "lineitem").select(
        *KEYS,
        F.when(returned, 1 + F.col("l_tax") / 10).otherwise(F.col("l_discount") / 10).alias("both_ends"),
        flag.alias("flag"),
        F.col("l_discount").alias("mixed"),
        F.when(F.col("l_discount") <= 0.05, F.col("l_discount") / 5).otherwise(F.col("l_quantity") + 1).alias("zero_end"),
        F.when(F.col("l_returnflag") == "A", F.col("l_discount") / 10).otherwise(-F.col("l_quantity")).alias("negative"),
    )


def _snap_flags_sql(c: str) -> str:
    def any_of(condition: str) -> str:
        return f"coalesce(bool_or({condition}), false)"

    zero = f"{any_of(f'{c} >= 0 AND {c} <= 0.01e0')} AND NOT " + any_of(
        f"({c} < 0 AND {c} >= -0.01e0) OR ({c} > 0.01e0 AND {c} <= 0.02e0)"
    )
    one = f"{any_of(f'{c} >= 1 AND {c} <= 1.01e0')} AND NOT " + any_of(
        f"({c} < 1 AND {c} >= 0.99e0) OR ({c} > 1.01e0 AND {c} <= 1.02e0)"
    )
    return f"{zero} AS {c}_zero, {one} AS {c}_one"


def _snapped_sql(c: str) -> str:
    return (
        f"CASE WHEN {c}_zero AND {c} >= 0 AND {c} <= 0.01e0 THEN 0 "
        f"WHEN {c}_one AND {c} >= 1 AND {c} <= 1.01e0 THEN 1 ELSE {c} END"
    )


def snap_ctes(source: str, columns: list[str]) -> str:
    """CTEs ending in ``snapped``, whose columns are the source's with the named ones snapped."""
    flags = ", ".join(_snap_flags_sql(c) for c in columns)
    replaced = ", ".join(f"{_snapped_sql(c)} AS {c}" for c in columns)
    dropped = ", ".join(f"{c}_zero, {c}_one" for c in columns)
    return (
        f"flags AS (SELECT {flags} FROM {source}), "
        f"snapped AS (SELECT * EXCLUDE ({dropped}) REPLACE ({replaced}) FROM {source}, flags)"
    )


def collapse_ctes(columns: list[str]) -> str:
    """CTEs from ``snapped`` to ``collapsed``: -1 for the missing values of binary columns."""
    binary = ", ".join(
        f"coalesce(bool_and({c} IN (0, 1)) FILTER (WHERE {c} IS NOT NULL), false) AS {c}_bin" for c in columns
    )
    replaced = ", ".join(f"CASE WHEN {c}_bin AND {c} IS NULL THEN -1 ELSE {c} END AS {c}" for c in columns)
    dropped = ", ".join(f"{c}_bin" for c in columns)
    return (
        f"binaries AS (SELECT {binary} FROM snapped), "
        f"collapsed AS (SELECT * EXCLUDE ({dropped}) REPLACE ({replaced}) FROM snapped, binaries)"
    )


@R.query(f"WITH {NOISY}, {snap_ctes('noisy', NOISY_COLUMNS)} SELECT * FROM snapped")
def snap_zero_one(spark, sf_dir):
    return snap(noisy(spark, sf_dir), NOISY_COLUMNS)


@R.query(f"WITH {NOISY}, {snap_ctes('noisy', NOISY_COLUMNS)}, {collapse_ctes(NOISY_COLUMNS)} SELECT * FROM collapsed")
def binary_collapse(spark, sf_dir):
    return collapse(noisy(spark, sf_dir), NOISY_COLUMNS)


def cent_sql(x: str) -> str:
    m = f"({x} % 0.01e0)"
    q = f"(({x} - {m}) / 0.01e0 - CASE WHEN {m} < 0 THEN 1 ELSE 0 END)"
    return f"((floor({q}) + CASE WHEN {q} - floor({q}) > 0.5e0 THEN 1 ELSE 0 END) / 100)"


@R.query(f"SELECT c_custkey, {cent_sql('(c_acctbal / 3)')} AS bal FROM customer")
def floor_to_cent(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return customer.select("c_custkey", cleaning.floor_to_cent("(c_acctbal / 3)").alias("bal"))


@R.query(f"WITH {LINEITEM}, o AS (SELECT {KEY_SQL}, {ordinal_sql('disc', 0.01)} AS ord FROM li) "
         f"SELECT {KEY_SQL}, nullif(ord, -1) AS ord FROM o")  # fmt: skip
def sentinel_null(spark, sf_dir):
    return ordinalize(spark, sf_dir).withColumn("ord", cleaning.sentinel_null("ord"))


@R.query(f"WITH {ORDERS_PANEL} SELECT id, ind, CAST(pend IS NULL AS INT) AS pend_null, CAST(amt IS NULL AS INT) AS amt_null FROM panel")
def null_indicator(spark, sf_dir):
    return orders_panel(spark, sf_dir).select(
        "id", "ind", cleaning.null_indicator("pend").alias("pend_null"), cleaning.null_indicator("amt").alias("amt_null")
    )


@R.query(f"WITH {ORDERS_PANEL} SELECT id, ind, coalesce(pend, 0) AS pend0, coalesce(pend, -1) AS pend1 FROM panel")
def fill_const(spark, sf_dir):
    return orders_panel(spark, sf_dir).select(
        "id", "ind", cleaning.fill_const("pend", 0.0).alias("pend0"), cleaning.fill_const("pend", -1.0).alias("pend1")
    )


@R.query("SELECT c_custkey AS id, c_acctbal AS bal_minus_1, c_nationkey FROM customer")
def select_features(spark, sf_dir):
    customer = P.drop_columns(table(spark, sf_dir, "customer"), ["c_name", "not_there"])
    renamed = P.portable_names(customer.withColumnsRenamed({"c_custkey": "id", "c_acctbal": "bal-1"}))
    return P.select_features(renamed, ["id"], ["bal_minus_1", "absent", "c_nationkey"])


# A panel with the preset's column names, one or more per kind of rule.
STATEMENTS = """statements AS (SELECT l_orderkey, l_linenumber,
    disc AS B_2, l_tax AS B_4, disc * 3 AS B_19, l_discount AS B_29, l_quantity / 7 AS B_3,
    l_tax AS D_59, disc * 20 AS D_77, l_extendedprice / 40000 AS D_133, l_quantity AS D_103,
    CASE l_returnflag WHEN 'A' THEN 'CR' WHEN 'N' THEN 'XZ' ELSE 'CL' END AS D_63,
    CASE l_returnflag WHEN 'A' THEN 'O' WHEN 'N' THEN '-1' END AS D_64,
    CASE WHEN l_returnflag = 'R' THEN 1 + l_tax / 10 ELSE disc / 10 END AS D_62,
    l_extendedprice / 50000 - 0.5e0 AS P_2, disc - 0.05e0 AS S_16,
    l_quantity / 60 AS S_11, l_extendedprice / 100000 AS S_13,
    l_tax AS S_15, l_extendedprice / 80000 AS S_8
  FROM li)"""


def statements(spark, sf_dir):
    c = F.col
    flag, disc, price = c("l_returnflag"), c("disc"), c("l_extendedprice")
    return lineitem(spark, sf_dir).select(
        *KEYS,
        disc.alias("B_2"),
        c("l_tax").alias("B_4"),
        (disc * 3).alias("B_19"),
        c("l_discount").alias("B_29"),
        (c("l_quantity") / 7).alias("B_3"),
        c("l_tax").alias("D_59"),
        (disc * 20).alias("D_77"),
        (price / 40000).alias("D_133"),
        c("l_quantity").alias("D_103"),
        F.when(flag == "A", "CR").when(flag == "N", "XZ").otherwise("CL").alias("D_63"),
        F.when(flag == "A", "O").when(flag == "N", "-1").alias("D_64"),
        F.when(flag == "R", 1 + c("l_tax") / 10).otherwise(disc / 10).alias("D_62"),
        (price / 50000 - 0.5).alias("P_2"),
        (disc - 0.05).alias("S_16"),
        (c("l_quantity") / 60).alias("S_11"),
        (price / 100000).alias("S_13"),
        c("l_tax").alias("S_15"),
        (price / 80000).alias("S_8"),
    )


def _clip_sql(x: str, high: float) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, -999), {double_sql(high)}) END"


def _codes_sql(x: str, codes: dict[str, int], other: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in codes.items()) + f" {other} END"


def _round_sql(x: str, factor: int) -> str:
    return f"CAST(coalesce(round_even({x} * {factor}, 0), -1) AS INT)"


_S13, _S13_LAST = override_ctes("ruled", "S_13", S_13_OVERRIDES, "a")
_S8, _S8_LAST = override_ctes(_S13_LAST, "S_8", S_8_OVERRIDES, "b")
_DOUBLES = ["B_3", "D_77", "D_133", "D_62", "P_2", "S_16"]
_RULED = f"""ruled AS (SELECT * EXCLUDE (B_29, D_103) REPLACE (
    {ordinal_sql("B_2", 1 / 100)} AS B_2, {ordinal_sql("B_4", 1 / 78)} AS B_4,
    CAST(coalesce(floor(B_19 * 100), -1) AS INT) AS B_19, {ordinal_sql("D_59", 1 / 48, 5 / 48)} AS D_59,
    {_clip_sql("D_77", 4)} AS D_77,
    CASE WHEN {_clip_sql("D_133", 1.5)} <= 0.01e0 THEN 0 ELSE {_clip_sql("D_133", 1.5)} END AS D_133,
    {_codes_sql("D_63", D_63_CODES, "")} AS D_63, {_codes_sql("D_64", D_64_CODES, "ELSE -1")} AS D_64,
    {_clip_sql("P_2", 1)} AS P_2, CASE WHEN S_16 <= 0.01e0 THEN 0 ELSE S_16 END AS S_16,
    {ordinal_sql("S_11", 1 / 25, 5 / 25)} AS S_11, {ordinal_sql("S_15", 1 / 10, 3 / 10)} AS S_15)
  FROM statements)"""
_SNAPPED = f"""grids AS (SELECT * REPLACE ({grid_sql("S_13", S_13_GRID)} AS S_13, {grid_sql("S_8", S_8_GRID)} AS S_8)
  FROM {_S8_LAST}),
cleaned AS (SELECT * REPLACE ({_round_sql("S_13", 1034)} AS S_13, {_round_sql("S_8", 3166)} AS S_8) FROM grids)"""


@R.query(
    f"WITH {LINEITEM}, {STATEMENTS}, {_RULED}, {_S13}, {_S8}, {_SNAPPED}, {snap_ctes('cleaned', _DOUBLES)}, "
    f"{collapse_ctes(_DOUBLES)} SELECT * REPLACE ({', '.join(f'{rounded_sql(c, 9)} AS {c}' for c in _DOUBLES)}) FROM collapsed"
)
def denoise_rules(spark, sf_dir):
    cleaned = denoise(statements(spark, sf_dir), credit_panel_preset())
    return cleaned.withColumns({c: rounded(c, 9) for c in _DOUBLES})
