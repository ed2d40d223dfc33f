"""Passages that repeat across documents, by sparse suffix arrays at minimiser positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import whole, written

#: Words from which a repeated passage counts.
PASSAGE = 50
#: Windows whose minimum is sought at a time, and words whose hashes a task remembers.
CHUNK, CACHE = 1 << 16, 400_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, text: str) -> np.ndarray:
        """Hashes of the words between ASCII white space, A-Z lower-cased."""
        if len(self) > CACHE:
            self.clear()
        words = text.encode().lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Grams:
    """Hashes of the runs of any length in a sequence of words, from one running sum."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.n = n
        power = np.full(n, BASE, np.uint64)
        back = np.full(n, INVERSE, np.uint64)
        power[:1] = back[:1] = 1
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(power))])
        self.back = np.cumprod(back)

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return _mixed((self.sums[starts + length] - self.sums[starts]) * self.back[starts])

    def all(self, length: int) -> np.ndarray:
        return self.at(np.arange(max(0, self.n - length + 1)), length)


def minimisers(seeds: np.ndarray, window: int) -> np.ndarray:
    """Where the smallest of any ``window`` neighbouring seeds stands; the leftmost of equals."""
    found = []
    for i in range(0, len(seeds) - window + 1, CHUNK):
        part = seeds[i : i + CHUNK + window - 1]
        found.append(i + np.unique(np.arange(len(part) - window + 1) + np.lib.stride_tricks.sliding_window_view(part, window).argmin(axis=1)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def anchors(documents: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """(key, doc_id, pos): the suffixes that are kept, each with the hash of its first ``passage // 2`` words.

    Every run of ``passage`` words holds at least one, at the same place wherever the run stands.
    """
    seed = passage // 2
    window = passage - seed + 1

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["body"], strict=True):
                seeds = Grams(words.of(text.as_py())).all(seed)
                if len(seeds) < window:
                    continue
                at = minimisers(seeds, window)
                ids = pa.array([doc.as_py()], doc.type).take(pa.array(np.zeros(len(at), np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(seeds[at].view(np.int64)), ids, pa.array(at.astype(np.int32))], ["key", "doc_id", "pos"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.mapInArrow(sparse, f"key long, doc_id {kind}, pos int")


def repeated_keys(suffixes: DataFrame) -> DataFrame:
    """Keys that suffixes of two documents or more begin with.

    Each partition of ``suffixes``, sorted by key and document, is an array of its own. A task compares
    neighbours and passes on one row per run of equal keys, with the run's first and last document; runs of
    all partitions are merged by key. So a key that a third of all documents hold is one row per task.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys, docs = batch["key"].to_numpy(), batch["doc_id"]
            begins = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1])
            ends = np.concatenate([begins[1:], [len(keys)]]) - 1
            runs = pa.RecordBatch.from_arrays([pa.array(keys[begins]), docs.take(pa.array(begins)), docs.take(pa.array(ends))], ["key", "low", "high"])
            if held is not None:
                yield held  # a run that goes on in this batch is merged with its rest later
            if len(begins) > 1:
                yield runs.slice(0, len(begins) - 1)
            held = runs.slice(len(begins) - 1)
        if held is not None:
            yield held

    kind = dict(suffixes.dtypes)["doc_id"]
    runs = suffixes.select("key", "doc_id").mapInArrow(compare, f"key long, low {kind}, high {kind}")
    return runs.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("key")


def _shared(windows: DataFrame) -> DataFrame:
    """(wkey, first_id) of windows that two documents or more hold.

    As a table, so that a join deals both sides anew and Spark can split what a hot window fills.
    """
    held = windows.groupBy("wkey").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return written(held.where("first_id < last_id").drop("last_id"))


def repeated_passages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, first) per maximal run of words that repeats across documents.

    A word is covered if it lies in a run of ``passage`` words that another document holds too; words are
    those between ASCII white space with A-Z lower-cased. ``first``: no smaller id holds any part of it.

    Suffixes are kept at minimiser positions only, sorted in each task, and neighbours compared on half a
    passage; equal neighbours of different tasks meet in a merge of the tasks' runs. From
    each repeated suffix the match is extended left and right: first by half a passage to either side,
    which settles the inside of long repeats; where that is not repeated as a whole, by every place in
    between. Texts are joined only to their own repeated suffixes, and a passage that a third of all
    documents hold is one entry per task in every aggregation.

    Null and short texts have no passages, rows without an id are not compared, rows that share an id
    are one document with several texts: their places are those of each text, and spans may mix. Documents
    without repeats give no rows. Other columns are not read.
    """
    half = passage // 2
    docs = documents.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("body")).where(F.col("doc_id").isNotNull())
    suffixes = written(anchors(docs, passage).sortWithinPartitions("key", "doc_id", "pos"))
    repeated = written(repeated_keys(suffixes.sortWithinPartitions("key", "doc_id")))
    spots = suffixes.join(repeated, "key").groupBy("doc_id").agg(F.collect_set("pos").alias("spots"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for doc, text, spots in zip(batch["doc_id"], batch["body"], batch["spots"], strict=True):
                grams = Grams(words.of(text.as_py()))
                at = np.sort(spots.values.to_numpy().astype(np.int64))
                at = at[at + half <= grams.n]
                starts = at[:, None] + np.arange(half - passage, 1)[None, :]
                outside = (starts < 0) | (starts + passage > grams.n)
                keys = grams.at(np.where(outside, 0, starts), passage) if grams.n >= passage else np.zeros(starts.shape, np.uint64)
                flat = pa.array(keys.view(np.int64).ravel(), mask=outside.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * starts.shape[1]), flat)
                ids = pa.array([doc.as_py()], doc.type).take(pa.array(np.zeros(len(at), np.int32)))
                seeds = grams.at(at, half).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(seeds), ids, pa.array(at.astype(np.int32)), lists], ["key", "doc_id", "pos", "wkeys"])

    kind = dict(docs.dtypes)["doc_id"]
    extended = docs.join(spots, "doc_id").select("doc_id", "body", "spots")
    extended = written(extended.mapInArrow(extend, f"key long, doc_id {kind}, pos int, wkeys array<long>"))

    def placed(rows: DataFrame) -> DataFrame:
        each = rows.select("key", "doc_id", "pos", F.posexplode("wkeys").alias("j", "wkey")).where("wkey IS NOT NULL")
        return each.withColumn("start", F.col("pos") + F.col("j") - F.lit(passage - half))

    far = placed(extended.withColumn("wkeys", F.array(F.get("wkeys", F.lit(0)), F.get("wkeys", F.size("wkeys") - 1))))
    far = far.withColumn("start", F.when(F.col("j") == 0, F.col("pos") - (passage - half)).otherwise(F.col("pos")))
    hit = written(far.join(_shared(far), "wkey").select("key", "doc_id", "pos", "start", "first_id"))
    settled = hit.groupBy("key", "doc_id", "pos").agg(F.count("*").alias("n")).where("n = 2").drop("n")
    ragged = extended.select("key", "doc_id", "pos").join(settled, ["key", "doc_id", "pos"], "left_anti").select("key").distinct()
    near = placed(extended.join(ragged, "key", "left_semi"))
    near_hit = near.join(_shared(near), "wkey")
    columns = ["doc_id", "start", (F.col("doc_id") == F.col("first_id")).alias("first")]
    windows = hit.select(*columns).union(near_hit.select(*columns)).groupBy("doc_id", "start").agg(F.bool_and("first").alias("first"))
    listed = windows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "first"))).alias("w"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, listed in zip(batch["doc_id"], batch["w"], strict=True):
                starts = listed.values.field("start").to_numpy()[: len(listed.values)]
                first = listed.values.field("first").to_numpy(zero_copy_only=False)
                begin = np.concatenate([[0], np.nonzero(np.diff(starts) > passage)[0] + 1])
                end = np.concatenate([begin[1:], [len(starts)]]) - 1
                low, high = starts[begin].astype(np.int64), starts[end].astype(np.int64) + passage
                alone = np.logical_and.reduceat(first, begin)
                ids = pa.array([doc.as_py()], doc.type).take(pa.array(np.zeros(len(begin), np.int32)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(low), pa.array(high), pa.array(high - low), pa.array(alone)], ["doc_id", "start_word", "end_word", "n_words", "first"])

    return listed.mapInArrow(spans, f"doc_id {kind}, start_word long, end_word long, n_words long, first boolean")
