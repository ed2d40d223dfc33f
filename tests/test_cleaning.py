import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import cleaning
from panelspark.functions.cleaning import Override
from panelspark.functions.numeric import floor_divide, nan_to_null, row_mean, safe_ratio


def apply(spark, values, expression, kind="double"):
    """Values through a column expression of ``x``, in input order."""
    frame = spark.createDataFrame(list(enumerate(values)), f"i INT, x {kind}")
    return [r["y"] for r in frame.select("i", expression.alias("y")).orderBy("i").collect()]


def test_ordinalize_steps_missing_and_offset(spark):
    assert apply(spark, [0.0, 0.0999, 0.1, 0.3049, None], cleaning.ordinalize("x", 0.1)) == [0, 0, 1, 3, -1]
    assert apply(spark, [-0.2, 0.0, 0.04], cleaning.ordinalize("x", 1 / 25, 5 / 25)) == [0, 5, 6]
    # A value a hair below its step, as noise leaves it, still belongs to the step.
    assert apply(spark, [3 - 1e-9], cleaning.ordinalize("x")) == [3]


def test_clip_keeps_nulls(spark):
    assert apply(spark, [-5000.0, 0.5, 7.0, None], cleaning.clip_range("x", 1.08)) == [-999.0, 0.5, 1.08, None]


def test_threshold_zero_takes_negatives_too(spark):
    assert apply(spark, [-3.0, 0.01, 0.0101, None], cleaning.threshold_zero("x")) == [0.0, 0.0, 0.0101, None]


def test_scale_floor_and_round_even(spark):
    assert apply(spark, [0.129, -0.001, None], cleaning.scale_floor("x", 100.0)) == [12, -1, -1]
    assert apply(spark, [0.5, 1.5, 2.5, None], cleaning.scale_round_even("x", 1.0)) == [0, 2, 2, -1]


def test_snap_grid_bounds_are_inclusive(spark):
    grid = (0, 0.5, 1)
    values = [0.0, 0.01, 0.0100001, 0.5, 0.51, 0.499, 1.005, -0.001, None]
    assert apply(spark, values, cleaning.snap_grid("x", grid)) == [0.0, 0.0, 0.0100001, 0.5, 0.5, 0.499, 1.0, -0.001, None]
    with pytest.raises(ValueError):
        cleaning.snap_grid("x", (1, 0))


def test_overrides_run_in_sequence(spark):
    rules = [
        Override(0.0, 1.0, "k = 1", 5.0),
        Override(4.0, 6.0, "k >= 1", 9.0),
        Override(9.0, 9.0, "k = 1", 0.5),
        Override(0.0, 1.0, "k = 2", 7.0),
    ]

    def sequential(x, k):
        tests = [lambda k: k == 1, lambda k: k >= 1, lambda k: k == 1, lambda k: k == 2]
        for rule, test in zip(rules, tests):
            if x is not None and rule.low <= x <= rule.high and test(k):
                x = rule.value
        return x

    cases = [(x, k) for x in (0.0, 0.5, 1.0, 1.5, 5.0, 9.0, None) for k in (0, 1, 2)]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i INT, x DOUBLE, k INT")
    got = frame.select("i", cleaning.conditional_override("x", rules).alias("y")).orderBy("i").collect()
    assert [r["y"] for r in got] == [sequential(*c) for c in cases]


def test_dict_encode(spark):
    codes = {"O": 0, "-1": 1}
    assert apply(spark, ["O", "-1", None], cleaning.dict_encode("x", codes, -1), "string") == [0, 1, -1]
    for bad in ("unheard of", None):
        with pytest.raises(Exception, match="no code for category"):
            apply(spark, [bad], cleaning.dict_encode("x", codes), "string")


def test_floor_division_equals_numpy(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate([np.arange(-300, 300) / 100, rng.normal(0, 50, 500), np.arange(0, 400) * 0.01, [0.01, -0.01, 0.0]])
    got = apply(spark, [float(v) for v in values], F.expr(floor_divide("x", 0.01)))
    assert got == list(values // 0.01)
    cents = apply(spark, [float(v) for v in values], cleaning.floor_to_cent("x"))
    assert cents == list((values // 0.01) / 100)


def test_null_helpers(spark):
    assert apply(spark, [-1.0, 2.0, None], cleaning.sentinel_null("x")) == [None, 2.0, None]
    assert apply(spark, [1.0, None], cleaning.null_indicator("x")) == [0, 1]
    assert apply(spark, [1.0, None], cleaning.fill_const("x", -1.0)) == [1.0, -1.0]
    assert apply(spark, [math.nan, 1.0, None], nan_to_null("x")) == [None, 1.0, None]


def test_safe_ratio(spark):
    frame = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0), (None, 0.0), (1.0, None)], "n DOUBLE, d DOUBLE")
    ieee = [r[0] for r in frame.select(safe_ratio("n", "d")).collect()]
    assert ieee == [math.inf, -math.inf, None, 1.5, None, None]
    assert [r[0] for r in frame.select(safe_ratio("n", "d", "null")).collect()] == [None, None, None, 1.5, None, None]


def test_row_mean_skips_nulls_and_cancelling_infinities(spark):
    rows = [(1.0, 3.0, None), (None, None, None), (math.inf, -math.inf, 1.0), (math.inf, 1.0, None)]
    frame = spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, c DOUBLE")
    means = [r[0] for r in frame.select(row_mean([F.col("a"), F.col("b"), F.col("c")])).collect()]
    assert means == [2.0, None, None, math.inf]
