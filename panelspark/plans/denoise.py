"""Declarative cleaning of a statement panel: rules, their order, and the credit-panel preset."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions import cleaning
from panelspark.functions.cleaning import Override
from panelspark.operators.panel import drop_columns
from panelspark.operators.profile import binary_collapse


@dataclass(frozen=True)
class Rule:
    """A column rewritten by an expression that may read other columns too."""

    column: str
    expression: Callable[[Column], Column]
    reads: tuple[str, ...] = ()


@dataclass(frozen=True)
class CleaningPreset:
    """Rules in order of application, and columns to drop in the end."""

    rules: Sequence[Rule]
    drop: Sequence[str] = field(default=())


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Apply the rules whose column exists, one projection per dependency level.

    A rule comes after the earlier rules that wrote its own column or one that it reads;
    independent rules share a projection.
    """
    level_of: dict[str, int] = {}
    levels: dict[int, dict[str, Column]] = {}
    existing = set(df.columns)
    for rule in rules:
        if rule.column not in existing:
            continue
        missing = set(rule.reads) - existing
        if missing:
            raise ValueError(f"the rule for {rule.column} reads missing columns {sorted(missing)}")
        level = 1 + max(level_of.get(c, 0) for c in (rule.column, *rule.reads))
        level_of[rule.column] = level
        levels.setdefault(level, {})[rule.column] = rule.expression(F.col(rule.column))
    for level in sorted(levels):
        df = df.withColumns(levels[level])
    return df


def denoise(df: DataFrame, preset: CleaningPreset) -> DataFrame:
    """Rules, then data-driven snapping of every double column left, then drops.

    Give it the union of train and test, so that both are cleaned alike.
    """
    ruled = drop_columns(apply_rules(df, preset.rules), preset.drop)
    doubles = [c for c, t in ruled.dtypes if t == "double"]
    return binary_collapse(ruled, doubles) if doubles else ruled


# --- Fixed values of the credit-panel preset -------------------------------------------------

# Denominator of the ordinal interval -> columns.
ORDINAL_COLUMNS = {
    1: "B_8 B_30 B_31 B_32 B_33 B_38 B_41 D_66 D_68 D_81 D_83 D_86 D_87 D_92 D_93 D_94 D_96 D_103 D_108 "
    "D_109 D_114 D_116 D_117 D_120 D_123 D_125 D_126 D_127 D_129 D_135 D_137 D_139 D_140 D_143 R_2 R_4 R_8 "
    "R_10 R_15 R_19 R_20 R_21 R_22 R_23 R_24 R_25 R_28 S_6 S_18 S_20",
    2: "B_22 D_78 D_79 D_82 D_84 D_91 D_111 D_138 R_5 R_11 R_16",
    3: "D_51 D_72 D_107",
    4: "D_70 D_136",
    5: "D_80 D_113",
    6: "R_9",
    7: "D_122",
    8: "D_44",
    9: "D_89",
    10: "R_3 S_15",
    11: "D_145",
    12: "B_16",
    14: "D_74",
    15: "D_75",
    17: "B_20",
    22: "D_124",
    23: "D_106",
    25: "S_11",
    28: "R_26",
    31: "R_13 R_18",
    34: "D_39",
    35: "R_17",
    38: "D_65",
    48: "D_59",
    71: "D_49",
    78: "B_4",
    100: "B_2 D_130",
}

# Offsets added before ordinalizing.
ORDINAL_OFFSETS = {"D_59": 5 / 48, "D_117": 1, "D_124": 1 / 22, "D_126": 1, "S_11": 5 / 25, "S_15": 3 / 10}

# Upper clip bound -> columns; the lower bound is -999.
CLIP_COLUMNS = {
    1: "B_17 B_18 B_39 D_52 D_54 D_60 D_110 D_112 D_134 R_12 R_27 P_2",
    1.08: "D_102",
    1.5: "D_133",
    4: "D_77",
}

THRESHOLD_ZERO_COLUMNS = "D_104 D_133 D_141 D_144 R_1 S_16 S_17 S_19 P_4"

SCALE_FLOOR_FACTORS = {"B_19": 100}
SCALE_ROUND_FACTORS = {"S_13": 1034, "S_8": 3166}

D_63_CODES = {"CR": 0, "XZ": 1, "XM": 2, "CO": 3, "CL": 4, "XL": 5}
D_64_CODES = {"O": 0, "-1": 1, "R": 2, "U": 3}
D_64_NULL_CODE = -1

S_13_GRID = (
    0, 0.0377176456223467, 0.2804642206328049, 0.4013539714415651, 0.4206963381303189, 0.5067698438641042,
    0.5261121975338173, 0.5551258157960416, 0.6218568673028206, 0.6876208933830246, 0.8433269036807703, 1,
)

S_8_GRID = (
    0, 0.1017056275625063, 0.119709415455368, 0.1667719530078215, 0.2438408100936861, 0.3578648754166172,
    0.4055590769093041, 0.4772583808904347, 0.4876816287061991, 0.6620341135675392, 0.7005685574395781,
    0.8509160456526623, 1, 1.0145299163657109, 1.1051803467580654, 1.2214158871037435,
)

S_13_OVERRIDES = (Override(0.67, 0.7, "S_11 IN (15, 16, 17)", 0.6789168283158535),)

S_8_OVERRIDES = (
    Override(0.30, 0.35, "S_15 <= 6", 0.3224889650033656),
    Override(0.30, 0.35, "S_15 = 7", 0.3145925513763017),
    Override(0.45, 0.477, "S_15 = 3", 0.4570436553944634),
    Override(0.45, 0.477, "S_15 = 5", 0.4636765662005172),
    Override(0.45, 0.477, "S_15 = 6", 0.4592546209653157),
    Override(0.55, 0.65, "S_15 = 5", 0.5938092592144236),
    Override(0.55, 0.65, "S_15 = 4", 0.5994946974629933),
    Override(0.55, 0.65, "S_15 <= 2", 0.6017056828901041),
    Override(0.73, 0.78, "S_15 = 3", 0.7441567340107059),
    Override(0.73, 0.78, "S_15 = 5", 0.7517372106519937),
    Override(0.73, 0.78, "S_15 = 4", 0.7586861099807893),
    Override(0.91, 0.98, "S_15 = 4", 0.9147189165383852),
    Override(0.91, 0.98, "S_15 <= 2", 0.9327230426634736),
    Override(0.91, 0.98, "S_15 = 3", 0.935565546481781),
    Override(1.12, 1.17, "S_15 <= 2", 1.1440303975988897),
    Override(1.12, 1.17, "S_15 = 3", 1.151926881019957),
)

CATEGORICAL_COLUMNS = "B_30 B_38 D_114 D_116 D_117 D_120 D_126 D_63 D_64 D_66 D_68"

DROPPED_COLUMNS = "B_29 D_103 D_139"

# Left out of the null sequences besides the date.
NULL_SEQUENCE_DROPPED_COLUMNS = (
    "B_19 B_2 B_20 B_22 B_26 B_27 B_3 B_30 B_33 B_38 D_41 D_54 D_104 D_107 D_128 D_129 D_130 D_131 D_139 "
    "D_141 D_143 D_145 D_114 D_115 D_116 D_117 D_118 D_119 D_120 D_121 D_122 D_123 D_124 D_125"
)

# --- End of the fixed values -----------------------------------------------------------------


def _encode(codes: Mapping[str, int], null_code: int | None = None) -> Callable[[Column], Column]:
    return lambda c: cleaning.dict_encode(c, codes, null_code)


def _ordinal(column: str, parts: int) -> Rule:
    offset = ORDINAL_OFFSETS.get(column, 0.0)
    return Rule(column, lambda c: cleaning.ordinalize(c, 1 / parts, offset))


def credit_panel_preset() -> CleaningPreset:
    """The preset for credit statement panels; rules of columns a panel lacks are skipped.

    Overrides read the ordinal of their second column, so ordinals come first.
    """
    rules = [_ordinal(c, parts) for parts, columns in ORDINAL_COLUMNS.items() for c in columns.split()]
    rules += [
        Rule(c, lambda v, high=high: cleaning.clip_range(v, high))
        for high, columns in CLIP_COLUMNS.items()
        for c in columns.split()
    ]
    rules += [Rule(c, cleaning.threshold_zero) for c in THRESHOLD_ZERO_COLUMNS.split()]
    rules += [Rule(c, lambda v, k=k: cleaning.scale_floor(v, k)) for c, k in SCALE_FLOOR_FACTORS.items()]
    rules += [Rule("D_63", _encode(D_63_CODES)), Rule("D_64", _encode(D_64_CODES, D_64_NULL_CODE))]
    for column, second, overrides, grid in (
        ("S_13", "S_11", S_13_OVERRIDES, S_13_GRID),
        ("S_8", "S_15", S_8_OVERRIDES, S_8_GRID),
    ):
        rules += [
            Rule(column, lambda v, o=overrides: cleaning.conditional_override(v, o), (second,)),
            Rule(column, lambda v, g=grid: cleaning.snap_grid(v, g)),
            Rule(column, lambda v, k=SCALE_ROUND_FACTORS[column]: cleaning.scale_round_even(v, k)),
        ]
    return CleaningPreset(rules, DROPPED_COLUMNS.split())
