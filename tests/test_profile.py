import pytest

from panelspark.operators.profile import binary_collapse, noise_profile, snap_zero_one
from panelspark.plans.denoise import CleaningPreset, Rule, apply_rules, credit_panel_preset, denoise
from panelspark.functions import cleaning

CASES = {
    "isolated": ([0.004, 0.0, 1.0, 1.007, None], [0.0, 0.0, 1.0, 1.0, -1.0]),
    "near_below_zero": ([-0.005, 0.004, 5.0], [-0.005, 0.004, 5.0]),
    "near_above_zero": ([0.004, 0.015, 5.0], [0.004, 0.015, 5.0]),
    "near_below_one": ([0.995, 1.004, 5.0], [0.995, 1.004, 5.0]),
    "only_ones_noisy": ([1.004, 1.01, 3.0, None], [1.0, 1.0, 3.0, None]),
    "zero_exact": ([0.0, 1.0, None], [0.0, 1.0, -1.0]),
    "negative": ([-3.0, 0.003, 1.002, None], [-3.0, 0.0, 1.0, None]),
    "all_null": ([None, None], [None, None]),
    # The range above 0 is inhabited, and so is its upper neighborhood: 0.0 stays but 0.006 too.
    "unsnapped_binary": ([0.0, 0.006, 0.011], [0.0, 0.006, 0.011]),
}


@pytest.mark.parametrize("name", CASES)
def test_snap_and_collapse(spark, name):
    before, after = CASES[name]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(before)], "i INT, x DOUBLE")
    got = [r["x"] for r in binary_collapse(frame, ["x"]).orderBy("i").collect()]
    assert got == after
    snapped = [r["x"] for r in snap_zero_one(frame, ["x"]).orderBy("i").collect()]
    assert snapped == [None if b is None else a for a, b in zip(after, before)]


def brute_force(values):
    """The three decisions by looking at the values directly."""
    seen = [v for v in values if v is not None]

    def snap(values, p):
        inside = [v for v in values if p <= v <= p + 0.01]
        around = [v for v in values if p - 0.01 <= v < p or p + 0.01 < v <= p + 2 * 0.01]
        return [float(p) if v in inside else v for v in values] if inside and not around else values

    seen = snap(snap(seen, 0), 1)
    return bool(seen) and set(seen) <= {0.0, 1.0}


def test_profile_flags_against_brute_force(spark):
    import random

    rng = random.Random(3)
    pool = [-0.02, -0.005, 0.0, 0.004, 0.01, 0.012, 0.02, 0.5, 0.99, 0.995, 1.0, 1.003, 1.01, 1.015, 1.02, 2.0, None]
    columns = {f"c{i}": [rng.choice(rng.sample(pool, 3)) for _ in range(6)] for i in range(60)}
    rows = list(zip(*columns.values()))
    frame = spark.createDataFrame(rows, ", ".join(f"{c} DOUBLE" for c in columns))
    flags = noise_profile(frame, list(columns)).first()
    for c, values in columns.items():
        assert flags[c]["binary"] == brute_force(values), (c, values)


def test_rules_are_levelled_by_dependency(spark):
    # The second rule must see the ordinal of a, the third its own earlier result.
    rules = [
        Rule("a", lambda c: cleaning.ordinalize(c, 0.1)),
        Rule("b", lambda c: cleaning.conditional_override(c, [cleaning.Override(0, 1, "a = 3", 0.25)]), ("a",)),
        Rule("b", lambda c: cleaning.scale_floor(c, 100.0)),
        Rule("not_there", lambda c: c),
    ]
    frame = spark.createDataFrame([(0.31, 0.9), (0.45, 0.9)], "a DOUBLE, b DOUBLE")
    assert [tuple(r) for r in apply_rules(frame, rules).collect()] == [(3, 25), (4, 90)]
    with pytest.raises(ValueError, match="missing columns"):
        apply_rules(frame.drop("a"), rules)


def test_denoise_snaps_and_drops(spark):
    preset = CleaningPreset([Rule("a", lambda c: cleaning.ordinalize(c))], ["gone", "never"])
    frame = spark.createDataFrame([(1.2, 0.004, 9.0), (2.1, None, 9.0)], "a DOUBLE, x DOUBLE, gone DOUBLE")
    out = denoise(frame, preset)
    assert out.columns == ["a", "x"]
    assert [tuple(r) for r in out.collect()] == [(1, 0.0), (2, -1.0)]


def test_preset_has_every_rule_once(spark):
    preset = credit_panel_preset()
    assert len(preset.rules) == 93 + 15 + 9 + 1 + 2 + 3 + 3
    assert preset.drop == ["B_29", "D_103", "D_139"]
