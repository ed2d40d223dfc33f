"""Repeated lines across documents, as one keep bitmap per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import WHITE, ascii_lower, frozen, whole


def _lines(text: Column) -> Column:
    return F.split(whole(text), "\n", -1)


def _identity(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart: the id, and the text for ids that come with several."""
    return [F.col(id_col).alias("doc_id"), F.xxhash64(whole(F.col(text_col))).alias("text_hash")]


def line_keep_bitmaps(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc_id, text_hash, n_dropped, keep) per document; bit i % 64 of keep[i / 64] says if line i stays.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of ``min_chars``
    code points or more that at least two ids hold stay only in the smallest of them, with all their
    lines there. Hashes of the keys are range-partitioned and sorted by document and position, so a line
    that a third of the corpus repeats spans as many partitions as it needs; each streams its runs to
    one (first, last) pair, and only keys with two ids are joined to the lines. Rows with a null id keep
    all lines; rows that agree in id and text share a bitmap.
    """
    identity = _identity(id_col, text_col)
    rows = documents.select(*identity, F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    key = ascii_lower(F.trim(F.col("line"), F.lit(WHITE)))
    hashed = rows.where(F.col("doc_id").isNotNull()).select("doc_id", "text_hash", "pos", key.alias("key"))
    hashed = hashed.where(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "pos", "text_hash"
    )
    order = ["h1", "h2", "doc_id", "pos"]
    runs = frozen(hashed.repartitionByRange(*order).sortWithinPartitions(*order))
    firsts = runs.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    # Frozen, so that the join deals both sides anew and Spark can split what a hot line fills.
    shared = frozen(firsts.where(F.col("first_id") < F.col("last_id")).drop("last_id"))
    bit = F.expr("shiftleft(1L, pos % 64)")
    dropped = runs.join(shared, ["h1", "h2"]).where(F.col("doc_id") > F.col("first_id"))
    dropped = dropped.select("doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word"), bit.alias("bits"))
    count = F.octet_length(whole(F.col(text_col))) - F.octet_length(F.regexp_replace(whole(F.col(text_col)), "\n", ""))
    blank = documents.select(*identity, F.explode(F.sequence(F.lit(0), (count / 64).cast("int"))).alias("word"), F.lit(0).cast("long").alias("bits"))
    words = blank.unionByName(dropped).groupBy("doc_id", "text_hash", "word").agg(F.bit_or("bits").alias("bits"))
    packed = words.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return packed.select(
        "doc_id",
        "text_hash",
        F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w["bits"])).alias("n_dropped"),
        F.transform("words", lambda w: F.bitwise_not(w["bits"])).alias("keep"),
    )


def apply_keep_bitmaps(documents: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) per row of ``documents``. A null or empty text is one empty line."""
    docs = documents.select(*_identity(id_col, text_col), whole(F.col(text_col)).alias("text"))
    match = docs["doc_id"].eqNullSafe(bitmaps["doc_id"]) & (docs["text_hash"] == bitmaps["text_hash"])
    rows = docs.join(bitmaps, match).select(docs["doc_id"], "text", "n_dropped", "keep")
    stays = lambda line, i: F.getbit(F.get(F.col("keep"), F.shiftright(i, 6)), i.bitwiseAND(63)) == 1
    return rows.select(
        "doc_id",
        (F.regexp_count(F.col("text"), F.lit("\n")) + 1).cast("long").alias("n_lines"),
        "n_dropped",
        F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n", -1), stays), "\n")).alias("kept_text"),
    )


def line_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Documents without lines that an earlier document holds: doc_id, n_lines, n_dropped, kept_text.

    See ``line_keep_bitmaps`` for which lines go. Columns other than id and text are not read.
    """
    return apply_keep_bitmaps(documents, line_keep_bitmaps(documents, id_col, text_col, min_chars), id_col, text_col)
