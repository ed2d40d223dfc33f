"""Phrases that are more than their parts, counted over a prefix-free parse of all texts."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm.common import whole, written
from panelspark.llm.hash_sets import WordHashes, bit_table, in_table, mixed

MAX_WORDS = 4
MIN_COUNT = 30
#: A phrase goes if a longer one around it has at least this share of its occurrences, in percent.
SHARE = 80
SCALE = 2_000_000
TOP = 2000
NO_LANG = "und"
#: What ends a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"
#: Stands for any run of piece ends inside a chunk. No word contains it.
END = b"."
#: One in so many windows of words starts a chunk.
PERIOD = 24
#: A chunk without such a window is cut after so many tokens.
LONGEST = 4096
#: Bits of the tables of frequent words, pairs and so on (8 MB each).
TABLE_BITS = 26
#: Distinct chunks, words or phrases that a task holds before it passes their counts on.
HELD = 400_000
#: Files of the dictionary that a task reads when it counts frequent phrases by text.
GATHERED = 4
#: Bits of the second hash of a phrase, summed with its counts as a proof that all counted under one hash are one phrase.
PROOF_BITS = 24
PROOF_BASE = np.uint64(0xD6E8FEB86659FD93)
#: Parts in which the first phrases of a language are ranked before they meet.
RANK_PARTS = 64


def normalized(text: str) -> bytes:
    """Words, A-Z lower-cased, and one ``END`` for each run of piece ends, with single blanks between."""
    marked = text.encode().lower().translate(_TO_END)
    return b" ".join(_END_RUN.sub(b" . ", marked).split())


_TO_END = bytes.maketrans(ENDS, END * len(ENDS))
_END_RUN = re.compile(rb"\.[. \t]*")


def cuts(hashes: np.ndarray, overlap: int, period: int = PERIOD, longest: int = LONGEST) -> np.ndarray:
    """Where chunks start: at 0 and at each window of ``overlap`` tokens whose hash is 0 modulo ``period``."""
    n = len(hashes)
    if n <= overlap:
        return np.zeros(1, dtype=np.int64)
    window = hashes
    for _ in range(overlap - 1):
        window = mixed(window[:-1], window[1:])
    starts = np.union1d([0], np.flatnonzero(window % np.uint64(period) == 0))
    gaps = np.diff(np.append(starts, n))
    if (gaps > longest).any():
        starts = np.concatenate([np.arange(s, s + gap, longest) for s, gap in zip(starts, gaps, strict=True)])
    return starts


def parse(documents: DataFrame, text: Column, lang: Column, overlap: int) -> DataFrame:
    """(lang, chunk, own, n, spot): the distinct chunks of all texts, how often each occurs in the parse, and a hash of each.

    A text is a stream of words and piece ends. Chunks start where the words at hand say so, so equal
    passages give equal chunks wherever they stand; each runs on for ``overlap`` tokens into the next one.
    The first ``own`` tokens are its own: a phrase belongs to the one chunk that owns its first word.
    """

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = WordHashes(), {}

        def rows() -> pa.RecordBatch:
            langs, chunks, own = zip(*held, strict=True)
            columns = [pa.array(langs, pa.string()), pa.array(chunks, pa.binary()).cast(pa.string()), pa.array(own, pa.int32()), pa.array(held.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "chunk", "own", "n"])

        for batch in batches:
            for body, tongue in zip(batch["body"], batch["lang"].to_pylist(), strict=True):
                stream = normalized(body.as_py())
                words, starts, ends = hashes.spans(stream)
                if not len(words):
                    continue
                first = cuts(words, overlap)
                after = np.append(first[1:], len(words))
                spans = zip(starts[first].tolist(), ends[np.minimum(after + overlap, len(words)) - 1].tolist(), (after - first).tolist(), strict=True)
                for a, b, own in spans:
                    key = (tongue, stream[a:b], own)
                    held[key] = held.get(key, 0) + 1
                    if len(held) >= HELD:
                        yield rows()
                        held.clear()
        if held:
            yield rows()

    bodies = documents.select(lang.alias("lang"), text.alias("body"))
    parts = bodies.mapInArrow(chunked, "lang string, chunk string, own int, n long")
    return parts.groupBy("lang", "chunk", "own").agg(F.sum("n").alias("n")).withColumn("spot", F.hash("lang", "chunk", "own"))


class Chunks:
    """The words of many chunks side by side, an end between two chunks, with their hashes by language."""

    def __init__(self, batch: pa.RecordBatch, hashes: WordHashes):
        import xxhash

        sizes = pc.binary_length(batch["chunk"]).to_numpy(zero_copy_only=False)
        self.stream = b" . ".join(text.encode() for text in batch["chunk"].to_pylist())
        words, self.starts, self.ends = hashes.spans(self.stream)
        first = np.cumsum(sizes + 3) - sizes - 3
        self.chunk = np.searchsorted(first, self.starts, side="right") - 1
        self.langs = batch["lang"].to_pylist()
        seeds = {lang: xxhash.xxh64_intdigest(lang) for lang in set(self.langs)}
        seed = np.array([seeds[lang] for lang in self.langs], dtype=np.uint64)
        self.words = (self.ends - self.starts != 1) | (np.frombuffer(self.stream, dtype=np.uint8)[self.starts] != END[0])
        self.hashes = mixed(seed[self.chunk], words)
        place = np.arange(len(words)) - np.searchsorted(self.starts, first)[self.chunk]
        self.own = place < batch["own"].to_numpy(zero_copy_only=False)[self.chunk]
        self.weights = batch["n"].to_numpy(zero_copy_only=False)[self.chunk]
        self.spots = batch["spot"].to_numpy(zero_copy_only=False)[self.chunk]

    def phrases(self, tables: Sequence[np.ndarray], max_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 to ``max_words`` words: hashes of the phrases from each place on, and whether all their shorter parts are in the tables there are."""
        hashes, alive = self.hashes, self.words
        yield hashes, alive
        for size in range(1, max_words):
            if size <= len(tables):
                at = np.flatnonzero(alive)
                alive = alive.copy()
                alive[at] = in_table(tables[size - 1], hashes[at])
            hashes, alive = mixed(hashes[:-1], hashes[1:]), alive[:-1] & alive[1:]
            yield hashes, alive

    def proofs(self, at: np.ndarray, size: int) -> np.ndarray:
        """Second hashes, of ``PROOF_BITS`` bits, of the phrases of ``size`` words at the places ``at``."""
        out = np.zeros(len(at), dtype=np.uint64)
        for i in range(size):
            out = out * PROOF_BASE + self.hashes[at + i]
        out ^= out >> np.uint64(32)
        out *= PROOF_BASE
        return (out >> np.uint64(64 - PROOF_BITS)).view(np.int64)

    def distinct(self, hashes: np.ndarray, at: np.ndarray, size: int) -> Iterator[tuple[str, bytes, int, int]]:
        """(language, phrase, hash, weight) of the different phrases of ``size`` words at the places ``at``."""
        keys, sums, first, *_ = _sorted(hashes[at], self.weights[at])
        places = at[first]
        langs = [self.langs[c] for c in self.chunk[places].tolist()]
        ends = self.ends[places + size - 1].tolist()
        for lang, a, b, key, n in zip(langs, self.starts[places].tolist(), ends, keys.view(np.int64).tolist(), sums.tolist(), strict=True):
            yield lang, self.stream[a:b], key, n


def _sorted(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, the sums of their counts, a place of each, the order that sorts the keys, and where each begins in it."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    sums = np.add.reduceat(count[order], first) if len(first) else count
    return key[first], sums, order[first], order, first


def count_words(chunks: DataFrame) -> DataFrame:
    """(lang, word, hash, n) of all words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = WordHashes(), {}

        def rows() -> pa.RecordBatch:
            langs, words, keys = zip(*held, strict=True)
            columns = [pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(keys, pa.int64()), pa.array(held.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "word", "hash", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            seen = Chunks(batch, hashes)
            for lang, word, key, n in seen.distinct(seen.hashes, np.flatnonzero(seen.own & seen.words), 1):
                held[lang, word, key] = held.get((lang, word, key), 0) + n
            if len(held) >= HELD:
                yield rows()
                held.clear()
        if held:
            yield rows()

    parts = chunks.mapInArrow(counted, "lang string, word string, hash long, n long")
    return parts.groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))


def count_hashes(chunks: DataFrame, tables: Sequence[Broadcast], max_words: int, bits: int = 64) -> DataFrame:
    """(hash, n, spot, proof) of all phrases of more words than there are tables, up to ``max_words``, whose shorter parts are in the tables.

    ``spot`` is the least one of the chunks that own the phrase, ``proof`` the sum of its second hash over all
    occurrences. ``bits``: of the hash, fewer only to try out collisions.
    """
    tables, least = list(tables), len(tables) + 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size, tests = WordHashes(), [], 0, [t.value for t in tables]

        def rows() -> pa.RecordBatch:
            keys, counts, spots, proofs = (np.concatenate(c) for c in zip(*held, strict=True))
            found, sums, _, order, first = _sorted(keys, counts)
            if len(first):
                spots, proofs = np.minimum.reduceat(spots[order], first), np.add.reduceat(proofs[order], first)
            columns = [pa.array(found.view(np.int64)), pa.array(sums), pa.array(spots), pa.array(proofs)]
            return pa.RecordBatch.from_arrays(columns, ["hash", "n", "spot", "proof"])

        for batch in batches:
            if not batch.num_rows:
                continue
            seen = Chunks(batch, words)
            for length, (hashes, alive) in enumerate(seen.phrases(tests, max_words), 1):
                if length < least:
                    continue
                at = np.flatnonzero(alive & seen.own[: len(alive)])
                counts = seen.weights[at]
                held.append((hashes[at] >> np.uint64(64 - bits), counts, seen.spots[at], counts * seen.proofs(at, length)))
                size += len(at)
            if size >= 4 * HELD:
                yield rows()
                held, size = [], 0
        if held:
            yield rows()

    parts = chunks.mapInArrow(counted, "hash long, n long, spot int, proof long")
    return parts.groupBy("hash").agg(F.sum("n").alias("n"), F.min("spot").alias("spot"), F.sum("proof").alias("proof"))


def phrase_texts(chunks: DataFrame, counts: DataFrame, max_words: int, bits: int = 64) -> DataFrame:
    """(lang, phrase, words, a, sure) of the phrases of ``counts``, each read from the chunks of its spot alone.

    ``sure``: the sum of second hashes is that of this phrase alone, so no other was counted with it.
    """
    wanted = counts.groupBy("spot").agg(F.collect_list("hash").alias("wanted"))
    table = bit_table(counts, F.shiftleft(F.col("spot").cast("long"), 32), TABLE_BITS)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = batch["spot"].to_numpy().astype(np.int64) << 32
            yield batch.filter(pa.array(in_table(table.value, spots.view(np.uint64))))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            if not batch.num_rows:
                continue
            seen, keys = Chunks(batch, words), np.unique(pc.list_flatten(batch["wanted"]).to_numpy()).view(np.uint64)
            for size, (hashes, alive) in enumerate(seen.phrases([], max_words), 1):
                if size == 1:
                    continue
                hashes = hashes >> np.uint64(64 - bits)
                at = np.flatnonzero(alive & seen.own[: len(alive)])
                at = at[np.isin(hashes[at], keys)]
                proofs = seen.proofs(at, size)
                own = {}
                spans = zip(seen.chunk[at].tolist(), seen.starts[at].tolist(), seen.ends[at + size - 1].tolist(), strict=True)
                for (c, a, b), key, second in zip(spans, hashes[at].view(np.int64).tolist(), proofs.tolist(), strict=True):
                    own[seen.langs[c], seen.stream[a:b]] = key, second
                if own:
                    (langs, phrases), (hashed, seconds) = zip(*own, strict=True), zip(*own.values(), strict=True)
                    columns = [pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.full(len(own), size, np.int32)), pa.array(hashed, pa.int64()), pa.array(seconds, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "words", "hash", "second"])

    near = chunks.mapInArrow(kept, chunks.schema).join(wanted, "spot").select(*chunks.columns, "wanted")
    texts = near.mapInArrow(found, "lang string, phrase string, words int, hash long, second long").distinct()
    joined = texts.join(counts, "hash")
    return joined.select("lang", "phrase", "words", F.col("n").alias("a"), (F.col("n") * F.col("second") == F.col("proof")).alias("sure"))


def count_phrases(chunks: DataFrame, tables: Sequence[Broadcast], max_words: int) -> DataFrame:
    """(lang, phrase, words, a) of all phrases of 2 to ``max_words`` words that are in the tables with all their parts, by text.

    A task reads several files, as frequent phrases are in most of them and leave a task once.
    """
    tables = list(tables)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, bits = WordHashes(), {}, [t.value for t in tables]

        def rows() -> pa.RecordBatch:
            langs, phrases, sizes = zip(*held, strict=True)
            columns = [pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int32()), pa.array(held.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "words", "a"])

        for batch in batches:
            if not batch.num_rows:
                continue
            seen = Chunks(batch, words)
            for size, (hashes, alive) in enumerate(seen.phrases(bits, max_words), 1):
                if size == 1:
                    continue
                at = np.flatnonzero(alive & seen.own[: len(alive)])
                if size <= len(bits):
                    at = at[in_table(bits[size - 1], hashes[at])]
                for lang, phrase, _, n in seen.distinct(hashes, at, size):
                    key = (lang, phrase, size)
                    held[key] = held.get(key, 0) + n
            if len(held) >= 2 * HELD:
                yield rows()
                held.clear()
        if held:
            yield rows()

    files = chunks.coalesce(max(chunks.rdd.getNumPartitions() // GATHERED, 1))
    parts = files.mapInArrow(counted, "lang string, phrase string, words int, a long")
    return parts.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a"))


def frequent_phrases(chunks: DataFrame, words: DataFrame, max_words: int, min_count: int, bits: int = 64) -> DataFrame:
    """(lang, phrase, words, a) of all phrases of 2 to ``max_words`` words with ``min_count`` occurrences or more.

    Pairs of frequent words are counted by hash, then all longer phrases of frequent pairs, and the text of
    each frequent hash is read from one chunk. Where two words, or two phrases, share a hash, all are
    counted by text instead.
    """
    often = F.col("n") >= min_count
    tables = [bit_table(words.where(often), "hash", TABLE_BITS)]
    counts = written(count_hashes(chunks, tables, min(2, max_words), bits).where(often))
    if max_words > 2:
        tables.append(bit_table(counts, F.shiftleft("hash", 64 - bits), TABLE_BITS))
        counts = counts.union(written(count_hashes(chunks, tables, max_words, bits).where(often)))
    phrases = written(phrase_texts(chunks, counts, max_words, bits))
    shared = words.groupBy("hash").agg(F.count("*").alias("words")).where("words > 1")
    if phrases.where("NOT sure").isEmpty() and shared.isEmpty():
        return phrases.drop("sure")
    return written(count_phrases(chunks, tables, max_words).where(F.col("a") >= min_count))


def _part(words: Column, first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def collocations(
    documents: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    share: int = SHARE,
    scale: int = SCALE,
    top: int = TOP,
) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase is 2 to ``max_words`` words of one piece with ``min_count`` occurrences (a) or more. Of its cuts
    in two, l and r being the occurrences of the parts, the one with the lowest floor(scale * a / (l + r))
    gives its score. Phrases inside a longer one with ``share`` percent of their occurrences go. n is the
    language's word count. Ranks are by score and a, largest first, then by phrase.

    Texts become a dictionary of overlapping chunks with frequencies, and all counting is done once per
    distinct chunk. Words are counted first, then pairs of frequent words, then longer phrases of frequent pairs: no
    phrase is more frequent than its parts. What is frequent is kept as bit tables of a fixed size, which let some
    rare phrases through and miss none. Phrases are counted by hash, with sums of a second hash that show whether
    two share one; if any do, all are counted by text. Counts are longs, products decimals.

    A null language is ``und``, a null or empty text has no words, repeated rows count each time, an empty
    table gives no rows. Texts of any length are read whole; other columns are not read.
    """
    text, lang = whole(F.col(text_col)), F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG))
    chunks = written(parse(documents, text, lang, max_words - 1))
    words = written(count_words(chunks))
    frequent = words.where(F.col("n") >= min_count)
    candidates = frequent_phrases(chunks, words, max_words, min_count)
    return _scored(candidates, frequent, words.groupBy("lang").agg(F.sum("n").alias("n")), share, scale, top)


def _scored(candidates: DataFrame, frequent: DataFrame, totals: DataFrame, share: int, scale: int, top: int) -> DataFrame:
    """Scores, what longer phrases cover, and ranks, from counts alone."""
    grams = candidates.select("lang", "phrase", "a").union(frequent.select("lang", "word", "n"))
    of, exact = F.split("phrase", " "), partial(Column.cast, dataType="decimal(38,0)")
    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _part(of, 1, F.col("k")).alias("left"), _part(of, F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    cut = cut.join(grams.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cut = cut.join(grams.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    cut = cut.withColumn("up", exact(F.col("a")) * scale).withColumn("down", exact(F.col("l")) + F.col("r")).withColumn("score", F.expr("up div down"))
    lowest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = candidates.where("words > 2").select("lang", "a", "words", of.alias("of"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", "of", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    inner = inner.groupBy("lang", _part(F.col("of"), F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = lowest.join(inner, ["lang", "phrase"], "left")
    kept = kept.where(F.coalesce(exact(F.col("longer")) * 100 < exact(F.col("a")) * share, F.lit(True)))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
