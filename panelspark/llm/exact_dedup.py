"""Exact duplicates by a tree-merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import ascii_lower, frozen, whole


def digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_bytes) per row; the digest is SHA-256 of the text with A-Z lower-cased."""
    text = ascii_lower(whole(F.col(text_col)))
    return documents.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )


def merge_runs(rows: DataFrame, keep: str = "max", fan_in: int = 4) -> DataFrame:
    """Merge the partitions' digest runs, ``fan_in`` at a time, to one entry per text.

    Each partition of ``rows`` is a run. A run is sorted by digest and holds one entry per text: the id
    that stays and the number of rows. In each round groups of ``fan_in`` runs become one. A text of
    which there are any number of copies is one entry per run from the first partial aggregation on, so
    no task ever sees more than ``fan_in`` entries of a text from then on. The byte length is part of
    the key at every level, so only texts that agree in both merge.
    """
    pick = {"max": F.max, "min": F.min}[keep]
    key = ["digest", "n_bytes"]
    runs = max(1, rows.rdd.getNumPartitions())
    entries = rows.select(F.spark_partition_id().alias("run"), *key, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    while True:
        merged = entries.groupBy((F.col("run") / fan_in).cast("int").alias("run"), *key)
        entries = merged.agg(pick("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")).sortWithinPartitions("run", *key)
        runs = -(-runs // fan_in)
        if runs == 1:
            return entries.drop("run")


def exact_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """Per row of ``documents``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they agree after lower-casing A-Z; null counts as empty. The row with the largest
    id stays (``keep="min"``: the smallest); a null id stays only where all ids of the group are null.
    Repeated rows of one id count towards group_size and are marked alike. Other columns, of whatever
    name, are not read; an empty table gives no rows.
    """
    rows = frozen(digests(documents, id_col, text_col))
    groups = merge_runs(rows, keep)
    return rows.join(groups, ["digest", "n_bytes"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
