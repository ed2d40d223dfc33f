"""Benchmark passages in documents, by a prefix-filtered join of word windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm.common import ascii_lower, fresh, frozen, small, whole, words_of

#: What stands between words: ASCII other than digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10


def _words(text_col: str):
    return words_of(ascii_lower(whole(F.col(text_col))), SEPARATORS)


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(win, tokens, items) per different window: its text, its words, the ids of the items that have it.

    A shorter item, if it has words at all, is one window. A null id counts as the empty id.
    """
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), _words(text_col).alias("w"))
    last = F.greatest(F.size("w") - window, F.lit(0))
    starts = items.where(F.size("w") > 0).select("item", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    windows = starts.select("item", F.slice("w", F.col("at") + 1, F.lit(window)).alias("tokens"))
    return windows.groupBy(F.array_join("tokens", " ").alias("win")).agg(
        F.first("tokens").alias("tokens"), F.array_sort(F.collect_set("item")).alias("items")
    )


def word_counts(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, n) over all of ``words`` (one array ``w`` a row), for the words of the vocabulary."""
    counted = words.select(F.explode("w").alias("word")).join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("n"))
    return vocabulary.join(counted, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def find_items(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """Per row of ``documents``: doc_id, text_hash, n_words, n_hit, items (sorted ids with occurring windows).

    A window occurs if its words stand next to each other in a document. That asks for all of its words,
    so its prefix is one word: the rarest, by counts over all documents. Only that word of each window is
    joined to the words of the documents, with its place, which gives where the window would start; starts
    outside the document are dropped, the rest is compared word by word in the document itself.

    The windows are broadcast while their counted rows are few, and joined by shuffle beyond that. Null
    texts have no words; rows that agree in id and text are found alike and each is returned. An empty
    benchmark hits nothing. Other columns are not read.
    """
    windows = frozen(item_windows(benchmark, item_col, item_text_col, window))
    n_windows = windows.count()
    identity = [F.col(id_col).alias("doc_id"), F.xxhash64(whole(F.col(text_col))).alias("text_hash")]
    docs = documents.select(*identity, _words(text_col).alias("w"))

    vocabulary = frozen(windows.select(F.explode("tokens").alias("word")).distinct())
    counts = frozen(word_counts(docs.select("w"), small(vocabulary, n_windows * window)))
    tokens = windows.select("win", "items", F.size("tokens").alias("len"), F.posexplode("tokens").alias("offset", "word"))
    rarest = Window.partitionBy("win").orderBy("n", "word", "offset")
    prefixes = tokens.join(counts, "word").withColumn("rank", F.row_number().over(rarest)).where("rank = 1")
    prefixes = frozen(prefixes.select("word", "offset", "len", "win", "items"))

    placed = docs.select("doc_id", "text_hash", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "word"))
    met = placed.join(small(prefixes, n_windows), "word").withColumn("start", F.col("pos") - F.col("offset"))
    met = met.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
    candidates = met.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "len", "win", "items")).alias("cands"))

    texts = documents.select(*identity, whole(F.col(text_col)).alias("body"))
    same = texts["doc_id"].eqNullSafe(candidates["doc_id"]) & (texts["text_hash"] == candidates["text_hash"])
    rows = texts.join(candidates, same, "left").select(texts["doc_id"], texts["text_hash"], "body", "cands")
    empty = F.array().cast("array<struct<start:int,len:int,win:string,items:array<string>>>")

    def verify(w):
        spelled = lambda c: F.array_join(F.slice(w, c["start"] + 1, c["len"]), " ") == c["win"]
        hits = F.array_sort(F.filter(F.coalesce("cands", empty), spelled))
        return F.struct(F.size(w).cast("long").alias("n_words"), hits.alias("hits"))

    # The words are the one element of an array, so that they are split once however many candidates there are.
    verified = F.get(F.transform(F.array(_words("body")), verify), F.lit(0)).alias("v")
    found = rows.select("doc_id", "text_hash", verified).select("doc_id", "text_hash", "v.n_words", "v.hits")
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def cover(seen, hit):
        end = F.greatest(seen["end"], hit["start"] + hit["len"])
        return F.struct(end.alias("end"), (seen["n"] + end - F.greatest(seen["end"], hit["start"])).cast("long").alias("n"))

    return found.select(
        "doc_id",
        "text_hash",
        "n_words",
        F.aggregate("hits", start, cover, lambda seen: seen["n"]).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"])))).alias("items"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``documents``, all columns, that hold no window of any benchmark item."""
    found = find_items(documents, benchmark, id_col, text_col, **options)
    (name,) = fresh(documents, "_key")
    bad = found.where("n_hit > 0").select(F.struct("doc_id", "text_hash").alias(name)).distinct()
    key = F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(whole(F.col(text_col))).alias("text_hash"))
    return documents.withColumn(name, key).join(bad, name, "left_anti").select(*documents.columns)
