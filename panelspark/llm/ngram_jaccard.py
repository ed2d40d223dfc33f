"""Jaccard join of documents as sets of word shingles, by prefixes of single rare shingles and pairs of frequent ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import frozen, whole, written
from panelspark.llm.components import connected_components
from panelspark.llm.hash_sets import WordHashes, bit_table, in_table, mixed

SHINGLE_WORDS = 3
#: Similarity from which two sets are linked, as a fraction of whole numbers.
SIMILARITY = (9, 10)
#: Documents that have a shingle from which it is of the frequent class; each further class has so many times as many.
FREQUENT = 8
#: Bits of the table of one class (2 MB each), and of the texts whose sets are compared (8 MB).
CLASS_BITS = 24
TEXT_BITS = 26
#: Of the table of keys that several classes have (8 MB).
KEY_BITS = 26
#: Slots are counted by ranges, 2^8 of them.
RANGE_BITS = 8
#: Longs of the parity sketch of a set.
SKETCH = 4
#: Members of a key up to which all of its pairs are compared where they meet, by size and sketch.
COMPARED = 64
#: Large keys of a member, its smallest, by which a pair that meets at several of them is known from the second on.
EARLIER = 64
#: Shingles that a task counts before it passes their counts on.
HELD = 2_000_000


class Shingler:
    """Sets of shingles as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.size, self.hashes = words, WordHashes()

    def of(self, text: str) -> np.ndarray:
        """Words are between ASCII white space, A-Z lower-cased; a text of fewer words is one shingle, one without words has none."""
        found = self.hashes.of(text.encode().lower())
        for _ in range(min(self.size, len(found)) - 1):
            found = mixed(found[:-1], found[1:])
        return np.unique(found)


def set_id(shingles: np.ndarray) -> bytes:
    """16 bytes that stand for the set."""
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def count_slots(documents: DataFrame, text: Column, words: int) -> DataFrame:
    """(hash, n): documents that have a shingle in each of 2^32 slots by the upper half of its hash, from ``FREQUENT`` on.

    A task sends the slots that it met as sorted differences, by range of slots; the counters of one range fill
    64 MB at any size of the input. Few shingles share a slot until there are as many as slots.
    """

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size = Shingler(words), [], 0

        def rows() -> pa.RecordBatch:
            slots, n = np.unique((np.concatenate(held) >> np.uint64(32)).astype(np.uint32), return_counts=True)
            ranges = slots >> np.uint32(32 - RANGE_BITS)
            first = np.flatnonzero(np.diff(ranges, prepend=np.uint32(1 << 31)))
            parts = [_packed(s, c) for s, c in zip(np.split(slots, first[1:]), np.split(n, first[1:]), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ranges[first].astype(np.int32)), pa.array(parts, pa.binary())], ["range", "met"])

        for batch in batches:
            for body in batch["body"]:
                found = shingler.of(body.as_py())
                for at in range(0, len(found), HELD):
                    held.append(found[at : at + HELD])
                    size += len(held[-1])
                    if size >= HELD:
                        yield rows()
                        held, size = [], 0
        if size:
            yield rows()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, at = None, None

        def rows() -> pa.RecordBatch:
            often = np.flatnonzero(counters >= FREQUENT)
            hashes = (np.uint64(at) << np.uint64(64 - RANGE_BITS)) | (often.astype(np.uint64) << np.uint64(32))
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counters[often])], ["hash", "n"])

        for batch in batches:
            for i, packed in zip(batch["range"].to_pylist(), batch["met"].to_pylist(), strict=True):
                if i != at:
                    if counters is not None:
                        yield rows()
                    counters, at = np.zeros(1 << (32 - RANGE_BITS), dtype=np.int64), i
                slots, n = _unpacked(packed)
                counters[slots & np.uint32(len(counters) - 1)] += n
        if counters is not None:
            yield rows()

    parts = documents.select(text.alias("body")).mapInArrow(met, "range int, met binary")
    return parts.repartition("range").sortWithinPartitions("range").mapInArrow(counted, "hash long, n long")


def _packed(slots: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted distinct slots as differences in two bytes each, or four if one is too large, and the counts above one."""
    steps = np.diff(slots)
    wide = bool((steps > 0xFFFF).any())
    more = np.flatnonzero(n > 1).astype(np.uint32)
    head = np.array([wide, len(slots), len(more), slots[0]], dtype=np.uint32)
    return b"".join(x.tobytes() for x in (head, more, n[more].astype(np.uint32), steps.astype(np.uint32 if wide else np.uint16)))


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide, size, extra, first = (int(x) for x in np.frombuffer(packed, dtype=np.uint32, count=4))
    more = np.frombuffer(packed, dtype=np.uint32, count=extra, offset=16)
    n = np.ones(size, dtype=np.int64)
    n[more] = np.frombuffer(packed, dtype=np.uint32, count=extra, offset=16 + 4 * extra)
    steps = np.frombuffer(packed, dtype=np.uint32 if wide else np.uint16, offset=16 + 8 * extra)
    return np.concatenate([[first], first + np.cumsum(steps, dtype=np.uint64)]).astype(np.uint32), n


def frequency_classes(counts: DataFrame, least: int = FREQUENT) -> list[Broadcast]:
    """A bit table per class of frequent shingles: those in ``least`` documents or more, in its square, and so on."""
    frequent = written(counts.where(F.col("n") >= least))
    most, bound, tables = frequent.agg(F.max("n")).first()[0] or 0, least, []
    while bound <= most:
        tables.append(bit_table(frequent.where(F.col("n") >= bound), "hash", CLASS_BITS))
        bound *= least
    return tables


def by_rarity(shingles: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """The set in one order that all sets share, rare shingles first, and how many of them are rare.

    A shingle's class is how many tables in a row have it. A table lets some others through, for every
    set alike, so the order is the same everywhere.
    """
    kind, left = np.zeros(len(shingles), dtype=np.int8), np.arange(len(shingles))
    for table in tables:
        left = left[in_table(table, shingles[left])]
        kind[left] += 1
    return shingles[np.lexsort((shingles, kind))], int((kind == 0).sum())


def signatures(ordered: np.ndarray, rare: int, similarity: tuple[int, int]) -> np.ndarray:
    """Keys of which two different sets of the similarity share one at least.

    Let the sets A and B have a and b shingles that the other has not; similarity t or more means a + t b <=
    (1 - t)|A|. Without a common shingle among the first floor((1 - t)|A|) + 1 of each, they are not similar:
    rare shingles of this prefix are keys by themselves. A prefix that is not rare throughout is extended
    in the frequent class, and pairs of neighbours in the order are keys there: if no rare shingle is
    common, at most a' = a - r and b frequent ones differ (r: rare ones of A), at most a' + b + 1 common ones
    come before the first two in a row, so A has these two among its first 2 a' + b + 2 <= 2 (1 - t)|A| - 2 r + 2.
    The keys are linear in the set where all pairs of a prefix would be its square.
    """
    part, of = similarity
    apart = (of - part) * len(ordered) // of
    single = ordered[: min(rare, apart + 1)]
    if rare > apart:
        return single
    extended = ordered[rare : rare + 2 * (of - part) * len(ordered) // of - 2 * rare + 2]
    return np.concatenate([single, mixed(extended[:-1], extended[1:])])


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bits that flip with each shingle: two sketches differ in no more bits than the sets in shingles."""
    places = (shingles * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - (SKETCH * 64).bit_length() + 1)
    flips = np.bincount(places.astype(np.int64), minlength=SKETCH * 64) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def fine_parity(shingles: np.ndarray) -> bytes:
    """The same with at least two bits a shingle, a power of two, so that sets of any size are told apart."""
    bits = 1 << max(2 * len(shingles) - 1, 63).bit_length()
    places = ((shingles * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(places.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def fine_flips(a: bytes, b: bytes) -> int:
    """In how many bits two fine sketches differ, the longer one folded to the other's length."""
    x, y = (np.frombuffer(s, dtype=np.uint64) for s in sorted((a, b), key=len))
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sketched(documents: DataFrame, doc_id: Column, text: Column, words: int, similarity: tuple[int, int], tables: list[Broadcast]) -> DataFrame:
    """(doc_id, row_hash, v, n, sketch, keys) per row; v stands for the set and n is its size."""
    rows = documents.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("row_hash"), text.alias("body"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, classes = Shingler(words), [t.value for t in tables]
        for batch in batches:
            sets = [shingler.of(body.as_py()) for body in batch["body"]]
            keys = [signatures(*by_rarity(s, classes), similarity).view(np.int64) for s in sets]
            columns = [
                pa.array([set_id(s) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([parity(s) for s in sets], pa.list_(pa.int64())),
                pa.array(keys, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row_hash"], *columns], ["doc_id", "row_hash", "v", "n", "sketch", "keys"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(sketched, f"doc_id {kind}, row_hash long, v binary, n long, sketch array<long>, keys array<long>")


#: What is known of a class at a key: its number, its size, the hash of the row its text is read from, its sketch.
MEMBER = ["x", "n", "h", *[f"s{i}" for i in range(SKETCH)]]
_LONGS = "key long, x long, n long, h long, " + ", ".join(f"s{i} long" for i in range(SKETCH))


def _index(classes: DataFrame) -> DataFrame:
    """(key, member) of the keys that two classes or more have; a bit table lets some others through."""
    often = classes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    table = bit_table(often, "key", KEY_BITS)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch["keys"].offsets.to_numpy())
            keys = batch["keys"].flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
            hit = in_table(table.value, keys.view(np.uint64))
            row = np.repeat(np.arange(len(sizes)), sizes)[hit]
            sketch = batch["sketch"].flatten().to_numpy(zero_copy_only=False).reshape(-1, SKETCH)
            known = [batch[c].to_numpy()[row] for c in ("x", "n", "row_hash")] + [sketch[row, i] for i in range(SKETCH)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (keys[hit], *known)], ["key", *MEMBER])

    return classes.select("x", "n", "row_hash", "sketch", "keys").mapInArrow(shared, _LONGS)


def _meetings(index: DataFrame, bound: Bound) -> DataFrame:
    """Pairs of members of a key that can be similar (x, h, y, yh): kind 0 with the smallest member, kind 2 with another one;
    kind 1 are the members of a key of more than ``COMPARED``, whose other pairs are still to be compared.

    Rows are streamed in the order of keys, and no more of a key is held than ``COMPARED`` members.
    """

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = np.zeros((0, len(MEMBER) + 1), dtype=np.int64), None

        def rows(kind: int, known: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
            columns = [np.full(len(known), kind), *known.T, other[:, 1], other[:, 3]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["kind", "key", *MEMBER, "y", "yh"])

        for batch in (*batches, None):
            new = np.stack([c.to_numpy() for c in batch.columns], axis=1) if batch is not None else held[:0]
            here = np.concatenate([held, new])
            if not len(here):
                continue
            starts = np.flatnonzero(np.concatenate([[True], here[1:, 0] != here[:-1, 0]]))
            sizes = np.diff(np.append(starts, len(here)))
            smallest, large = here[np.repeat(starts, sizes)], np.repeat(sizes > COMPARED, sizes)
            if first is not None and first[0] == here[0, 0]:  # a large key goes on
                smallest[: sizes[0]], large[: sizes[0]] = first, True
            stop = len(here) if batch is None or large[-1] else starts[-1]  # a key with fewer may still get more
            held, first = here[stop:], smallest[-1].copy() if large[-1] else None
            few = (starts < stop) & ~large[starts]
            for size in np.unique(sizes[few & (sizes > 2)]).tolist():
                i, j = np.triu_indices(size, 1)
                at = starts[few & (sizes == size), None]
                a, b = (here[(at + k[i > 0]).ravel()] for k in (i, j))
                pair = (a[:, 1] != b[:, 1]) & bound.reachable_rows(a, b)
                yield rows(2, a[pair], b[pair])
            here, smallest, large = here[:stop], smallest[:stop], large[:stop]
            pair = (here[:, 1] != smallest[:, 1]) & bound.reachable_rows(here, smallest)
            yield rows(0, here[pair], smallest[pair])
            yield rows(1, here[large], here[large])

    dealt = index.repartition("key").sortWithinPartitions("key", "x")
    return written(dealt.mapInArrow(met, f"kind long, {_LONGS}, y long, yh long"))


@dataclass
class Sets:
    """Where the sets of classes come from: the text of one row of each is read again."""

    documents: DataFrame
    doc_id: Column
    text: Column
    words: int

    def of(self, hashes: DataFrame) -> DataFrame:
        """(h, shingles) of the rows with the hashes (h), written; some others may come along."""
        return self._read(hashes, "shingles array<long>", lambda sets: [pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))])

    def sketches(self, hashes: DataFrame) -> DataFrame:
        """(h, n, fine) of the same rows: the size of the set and its fine sketch."""
        return self._read(hashes, "n long, fine binary", lambda sets: [pa.array([len(s) for s in sets], pa.int64()), pa.array([fine_parity(s) for s in sets], pa.binary())])

    def _read(self, hashes: DataFrame, schema: str, columns: Callable[[list[np.ndarray]], list[pa.Array]]) -> DataFrame:
        table = bit_table(hashes, "h", TEXT_BITS)
        rows = self.documents.select(F.xxhash64(self.doc_id, self.text).alias("h"), self.text.alias("body"))
        words, names = self.words, ["h", *(c.split()[0] for c in schema.split(", "))]

        def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler, seen = Shingler(words), set()
            for batch in batches:
                of = batch["h"].to_numpy()
                at = [i for i in np.flatnonzero(in_table(table.value, of.view(np.uint64))).tolist() if of[i] not in seen]
                seen.update(of[at].tolist())
                sets = [shingler.of(batch["body"][i].as_py()) for i in at]
                if len(seen) > HELD:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(of[at], pa.int64()), *columns(sets)], names)

        return written(rows.mapInArrow(shingled, f"h long, {schema}"))


@dataclass
class Bound:
    """The similarity asked for, as conditions on pairs."""

    part: int
    of: int

    def reachable(self) -> Column:
        """By sizes and sketches the member (n, s0, ...) and the other (yn, ys0, ...) can be similar enough."""
        n, m = F.col("n"), F.col("yn")
        flipped = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"ys{i}"))) for i in range(SKETCH)), F.lit(0))
        return (F.least(n, m) * self.of >= F.greatest(n, m) * self.part) & (flipped * (self.of + self.part) <= (n + m) * (self.of - self.part))

    def reachable_rows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same of rows (key, member) of two matrices."""
        n, m = a[:, 2], b[:, 2]
        flipped = np.bitwise_count((a[:, 4:] ^ b[:, 4:]).view(np.uint64)).sum(axis=1, dtype=np.int64)
        return (np.minimum(n, m) * self.of >= np.maximum(n, m) * self.part) & (flipped * (self.of + self.part) <= (n + m) * (self.of - self.part))

    def near(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """The pairs (ha, hb) that can be similar enough by their fine sketches."""
        left, right = (sketches.select(F.col("h").alias(f"h{x}"), F.col("n").alias(f"{x}_n"), F.col("fine").alias(f"{x}_fine")) for x in "ab")
        both, columns = pairs.join(left, "ha").join(right, "hb"), pairs.columns

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flips = np.array([fine_flips(a.as_py(), b.as_py()) for a, b in zip(batch["a_fine"], batch["b_fine"], strict=True)], dtype=np.int64)
                sizes = batch["a_n"].to_numpy() + batch["b_n"].to_numpy()
                near = pa.array(flips * (self.of + self.part) <= sizes * (self.of - self.part))
                yield batch.select(columns).filter(near)

        return both.mapInArrow(kept, pairs.schema)

    def similar(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (ha, hb) whose sets are similar, by all their shingles."""
        left, right = (sets.select(F.col("h").alias(f"h{x}"), F.col("shingles").alias(f"{x}_set")) for x in "ab")
        both = pairs.join(left, "ha").join(right, "hb")
        common = F.size(F.array_intersect("a_set", "b_set"))
        return both.where(common * (self.part + self.of) >= (F.size("a_set") + F.size("b_set")) * self.part).select(*pairs.columns)


def _linked(index: DataFrame, sets: Sets, bound: Bound) -> DataFrame:
    """(x, c): components of the classes in ``index`` that meet another, under similarity.

    Members of a key are first compared with its smallest one: copies of one another need one link each. Of the other
    pairs only those of different components are compared by whole sets. In large keys they are found by a join
    of what is not of the most frequent component with all members, by size and sketch; two members that
    meet at several large keys are a pair at the first of them only, as far as that is among the ``EARLIER`` smallest of both.
    """
    found = _meetings(index, bound)
    pairs = found.where("kind <> 1").select("kind", F.col("h").alias("ha"), F.col("yh").alias("hb"), F.col("x").alias("c"), F.col("y").alias("d"))
    members = found.where("kind = 1")
    labels = pairs.select("c").union(pairs.select("d")).union(members.select("x")).distinct().select(F.col("c").alias("x"), "c")
    labels = frozen(_more(labels, pairs.where("kind = 0").drop("kind"), sets, bound))
    of_c, of_d = (labels.select(F.col("x").alias(c), F.col("c").alias(f"new_{c}")) for c in "cd")
    apart = pairs.where("kind = 2").drop("kind").distinct().join(of_c, "c").join(of_d, "d").where("new_c <> new_d")
    apart = apart.select("ha", "hb", F.col("new_c").alias("c"), F.col("new_d").alias("d"))

    rows = written(members.join(labels, "x").select("key", *MEMBER, "c"))
    sizes = rows.groupBy("key", "c").agg(F.count("*").alias("n"))
    major = written(sizes.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("major"), F.count("*").alias("kinds")).where("kinds > 1").select("key", "major"))
    met_at = rows.groupBy("x").agg(F.slice(F.sort_array(F.collect_set("key")), 1, EARLIER).alias("keys"))
    others = rows.join(major, "key").join(met_at, "x").withColumn("before", F.filter("keys", lambda k: k < F.col("key")))
    others = written(others.select("key", *MEMBER, "c", "major", "before"))
    strangers = others.where("c <> major").select("key", *[F.col(c).alias(f"y{c}") for c in (*MEMBER, "before")], F.col("c").alias("d"))
    apart_here = (F.col("c") != F.col("d")) & ((F.col("c") == F.col("major")) | (F.col("c") < F.col("d")))
    met = others.join(strangers, "key").where(apart_here & bound.reachable() & ~F.arrays_overlap("before", "ybefore"))
    met = met.select(F.col("h").alias("ha"), F.col("yh").alias("hb"), "c", "d")
    return _more(labels, met.union(apart), sets, bound)


def _more(labels: DataFrame, pairs: DataFrame, sets: Sets, bound: Bound) -> DataFrame:
    """The labels (x, c) after verifying ``pairs`` (ha, hb, c, d) of different components c and d.

    Fine sketches, a thirty-second to a sixteenth of the sets, leave few pairs whose sets are read and moved.
    """

    def rows_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("ha").alias("h")).union(pairs.select("hb"))

    pairs = frozen(pairs.distinct())
    pairs = frozen(bound.near(pairs, sets.sketches(rows_of(pairs))).distinct())
    links = frozen(bound.similar(pairs, sets.of(rows_of(pairs))).select(F.col("c").alias("a"), F.col("d").alias("b")).distinct())
    found = connected_components(links.select(F.col("a").alias("v")).union(links.select("b")).distinct(), links)
    return labels.select("x", F.col("c").alias("v")).join(found.withColumnRenamed("c", "to"), "v", "left").select("x", F.coalesce("to", "v").alias("c"))


def ngram_jaccard_components(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: tuple[int, int] = SIMILARITY,
    shingle_words: int = SHINGLE_WORDS,
) -> DataFrame:
    """Per row of ``documents``: doc_id, n_shingles (size of its set), component_id (smallest id reachable).

    A document is the set of its shingles of ``shingle_words`` words, or its whole word sequence if it has fewer.
    Two are linked from a Jaccard ``similarity`` of part / of on, three quarters at least. Shingles are ordered
    by how many documents have them; similar sets share a rare shingle of their prefixes or two neighbouring
    frequent ones of the extended prefixes (``signatures``). Candidates are compared by sizes, by sketches that
    never rule out a similar pair, then by all their shingles (64-bit hashes).

    Equal sets are one vertex, so copies in any number cost one. Null and wordless texts have the empty set and are
    linked with nothing. A null id takes part, but a component's id is null only if all of its ids are. Repeated
    rows are all returned; an empty table gives no rows; other columns are not read.
    """
    bound = Bound(*similarity)
    if not 3 * bound.of <= 4 * bound.part < 4 * bound.of:
        raise ValueError(f"similarity must be from 3/4 to below 1, not {similarity}")
    text, doc_id = whole(F.col(text_col)), F.col(id_col)
    tables = frequency_classes(count_slots(documents, text, shingle_words))
    rows = written(_sketched(documents, doc_id, text, shingle_words, similarity, tables))
    classes = rows.where("n > 0").groupBy("v").agg(F.min("doc_id").alias("first"), F.any_value(F.struct("n", "sketch", "row_hash", "keys")).alias("one"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("x"), "v", "first", "one.*"))

    linked = frozen(_linked(_index(classes), Sets(documents, doc_id, text, shingle_words), bound))

    labelled = written(classes.select("x", "v", "first").join(linked, "x", "left").select("v", "first", F.coalesce("c", "x").alias("c")))
    by_set = written(labelled.join(labelled.groupBy("c").agg(F.min("first").alias("component_id")), "c").select("v", "component_id"))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "v", "n").join(by_set, "v", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
