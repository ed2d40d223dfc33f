"""Reproducible folds and hold-outs from hashes of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.ranking import row_position

FOLDS = 5
SEED = 42
HOLDOUT = 0.2


def id_hash(id_col: str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))


def stratified_folds(df: DataFrame, id_col: str, label: str, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """(id, label, fold): ids are shuffled by hash within each label and dealt out in turn.

    Labels differ by at most one row between folds. The position within a label is a
    distributed one, since a label has a large share of all rows.
    """
    hashed = df.select(id_col, label, id_hash(id_col, seed).alias("__hash"))
    dealt = row_position(hashed, [F.col("__hash").asc(), F.col(id_col).asc()], "__pos", [label])
    return dealt.select(id_col, label, F.pmod(F.col("__pos") - 1, F.lit(folds)).cast("int").alias("fold"))


def in_holdout(id_col: str, fraction: float = HOLDOUT, seed: int = SEED) -> Column:
    """Whether an id belongs to the hold-out: its first 32 hash bits lie below ``fraction``."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    return F.substring(id_hash(id_col, seed), 1, 8) < F.lit(f"{int(fraction * 2**32):08x}")
