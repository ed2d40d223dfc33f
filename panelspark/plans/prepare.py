"""From raw train and test statements to the cleaned, indexed panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.cleaning import sentinel_null
from panelspark.operators.panel import month_number, statement_index, union_split
from panelspark.plans.denoise import CleaningPreset, denoise


def prepare_panel(
    train: DataFrame, test: DataFrame, id_col: str, ts: str, preset: CleaningPreset, last: int = 13
) -> DataFrame:
    """Clean train and test together and index each customer's statements back from the last.

    The result has the columns ``split`` and ``ind``; write it with ``sources.write_panel`` and
    read a split back from there. What cleaning depends on, the noise profile, is one pass over
    both splits before the one that applies it.
    """
    statements = denoise(union_split({"train": train, "test": test}), preset)
    parsed = F.to_timestamp(ts) if dict(statements.dtypes)[ts] == "string" else F.col(ts)
    return statement_index(statements.withColumn(ts, parsed), id_col, month_number(ts), last=last)


def nulls_for_sentinels(panel: DataFrame, keys: Sequence[str], sentinel: int = -1) -> DataFrame:
    """Turn the cleaning's sentinel back into NULL in every column but the keys, before aggregating."""
    skipped = set(keys)
    measures = [c for c, t in panel.dtypes if c not in skipped and t not in ("string", "timestamp", "timestamp_ntz", "date")]
    return panel.withColumns({c: sentinel_null(c, sentinel) for c in measures})
