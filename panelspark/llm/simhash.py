"""Near duplicates by SimHash, found by a generalised pigeonhole over groups of bits."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import fresh, frozen, row_identity, whole
from panelspark.llm.components import connected_components

BITS = 64
SHINGLE_WORDS = 4
DISTANCE = 4
SEED = 42
#: Fingerprints on which the bit groups and thresholds are planned. They steer cost, never results.
PLAN_SAMPLE = 1024
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of one text: words between ASCII white space, A-Z lower-cased, all shingles with repeats."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda end, size: end + 1 + size))
    starts = itertools.chain([0], (end + 1 for end in ends))
    last = ends[shingle_words - 1 :] or ends[-1:]
    counts, n = np.zeros(BITS, dtype=np.int64), len(last)
    spans = zip(starts, last, strict=False)
    while chunk := list(itertools.islice(spans, CHUNK)):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in chunk], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(text.as_py(), shingle_words) for text in batch["body"]], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(values.view(np.int64))], ["doc_id", "fp"])

    kind = dict(documents.dtypes)[id_col]
    rows = documents.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("body"))
    return rows.mapInArrow(hashed, f"doc_id {kind}, fp long")


@dataclass(frozen=True)
class Part:
    """A group of bits and how many of them may differ for a pair to be probed by it; -1: it is not probed."""

    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return signed(sum(1 << b for b in self.bits))

    def flips(self) -> list[int]:
        """All sets of at most ``threshold`` bits of the part, as masks."""
        sets = (c for k in range(self.threshold + 1) for c in itertools.combinations(self.bits, k))
        return [signed(sum(1 << b for b in c)) for c in sets]


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def group_bits(sample: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Share the bits among parts of (nearly) one size, strongly correlated ones together."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    centred = bits - bits.mean(axis=0)
    norm = np.sqrt((centred**2).sum(axis=0)) + 1e-9
    related = np.abs(centred.T @ centred) / np.outer(norm, norm)
    left, groups = set(range(BITS)), []
    for size in (len(x) for x in np.array_split(np.arange(BITS), parts)):
        group = [max(sorted(left), key=lambda b: related[b, sorted(left)].sum())]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(sorted(left), key=lambda b: related[b, group].mean()))
            left.remove(group[-1])
        groups.append(tuple(sorted(group)))
    return groups


def plan_parts(sample: np.ndarray, n: int, distance: int = DISTANCE, probe_cost: float = 4.0) -> list[Part]:
    """Bit groups and thresholds for ``n`` fingerprints.

    If thresholds sum to distance - parts + 1, two fingerprints within the distance differ in at most
    threshold bits of at least one part. Which thresholds cost least is settled by dynamic programming
    over the parts; a cost is the probes made (times ``probe_cost``) plus the candidates expected, from
    the distances within the sample and no less than for independent even bits.
    """
    n = max(n, 2)
    best: tuple[float, list[Part]] | None = None
    pairs = (sample[:, None] ^ sample[None, :])[np.triu_indices(len(sample), 1)]
    for parts in range(1, distance + 2):
        groups, costs = group_bits(sample, parts), []
        for group in groups:
            apart = np.bitwise_count(pairs & np.uint64(sum(1 << b for b in group)))
            row = [0.0]  # threshold -1
            for t in range(distance + 1):
                probes = sum(math.comb(len(group), k) for k in range(t + 1))
                share = max(probes / 2.0 ** len(group), float((apart <= t).mean()) if len(pairs) else 0.0)
                row.append(probe_cost * n * probes + share * n * n / 2)
            costs.append(row)
        # reach[s]: cheapest way for the thresholds so far, each raised by one, to sum to s.
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in costs:
            following: dict[int, tuple[float, list[int]]] = {}
            for s, (cost, chosen) in reach.items():
                for raised, more in enumerate(row):
                    if s + raised <= distance + 1 and (s + raised not in following or cost + more < following[s + raised][0]):
                        following[s + raised] = (cost + more, [*chosen, raised - 1])
            reach = following
        cost, thresholds = reach[distance + 1]
        if best is None or cost < best[0]:
            best = (cost, [Part(g, t) for g, t in zip(groups, thresholds, strict=True)])
    return best[1]


def _within(a: str, b: str, distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def _keyed(fps: DataFrame, parts: list[Part], flipped: bool) -> DataFrame:
    """fps with (part, value) rows: the bits of each probed part, or those and all values near enough."""
    keys = [
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(p.mask)).bitwiseXOR(F.lit(flip)).alias("value"))
        for i, p in enumerate(parts)
        for flip in (p.flips() if flipped else [0])
        if p.threshold >= 0
    ]
    return fps.select("*", F.explode(F.array(*keys)).alias("key")).select(*fps.columns, "key.part", "key.value")


def link_fingerprints(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, c) for different fingerprints: components under links of ``distance`` differing bits or fewer.

    First each bucket (same bits in one part) links its members to its smallest one where they are near
    enough; that puts a large group of near copies into few components with one link each. Then all
    fingerprints probe the buckets within their part's threshold, but only pairs of different components
    are compared: where most of a bucket is one component, its members are never compared among
    themselves, so the work is members times strangers and no pairs within a group are made. Every link
    between components is found and verified on all bits.
    """
    fps = frozen(fps.select("fp").distinct())
    chosen = [r["fp"] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(PLAN_SAMPLE).collect()]
    parts = plan_parts(np.array(chosen, dtype=np.int64).view(np.uint64), fps.count(), distance)

    own = _keyed(fps, parts, flipped=False)
    pivots = own.groupBy("part", "value").agg(F.min("fp").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = own.join(pivots, ["part", "value"]).where("fp <> pivot")
    stars = stars.where(_within("fp", "pivot", distance)).select(F.col("fp").alias("a"), F.col("pivot").alias("b")).distinct()
    first = connected_components(fps.select(F.col("fp").alias("v")), frozen(stars)).select(F.col("v").alias("fp"), "c")

    index = frozen(_keyed(first, parts, flipped=False))
    sizes = index.groupBy("part", "value", "c").agg(F.count("*").alias("n"))
    major = sizes.groupBy("part", "value").agg(F.max_by("c", F.struct("n", "c")).alias("major"))
    index = frozen(index.join(major, ["part", "value"]))
    members = index.select("part", "value", F.col("fp").alias("other"), F.col("c").alias("other_c"), "major")
    probes = _keyed(first, parts, flipped=True)
    near = _within("fp", "other", distance) & (F.col("c") != F.col("other_c"))
    strangers = members.where("other_c <> major").drop("major")
    own_kind = members.where("other_c = major").drop("major")
    by_strangers = probes.join(strangers, ["part", "value"]).where(near)
    foreign = probes.join(index.select("part", "value", "major").distinct(), ["part", "value"]).where("c <> major").drop("major")
    by_foreign = foreign.join(own_kind, ["part", "value"]).where(near)
    links = by_strangers.union(by_foreign.select(*by_strangers.columns)).select(F.col("c").alias("a"), F.col("other_c").alias("b")).distinct()
    second = connected_components(first.select(F.col("c").alias("v")).distinct(), frozen(links))
    return first.select("fp", F.col("c").alias("v")).join(second, "v").select("fp", "c")


def simhash_components(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle_words: int = SHINGLE_WORDS
) -> DataFrame:
    """Per row of ``documents``: doc_id, fp (signed long), component_id (the smallest id reachable by links).

    Two rows are linked if their fingerprints differ in ``distance`` bits or fewer; null counts as the
    empty text, whose fingerprint is zero and is linked like any other. Equal fingerprints are one vertex,
    so copies in any number cost one. A null id takes part, but a component's id is null only if all of
    its ids are. Repeated rows are all returned; other columns are not read.
    """
    rows = frozen(fingerprints(documents, id_col, text_col, shingle_words))
    linked = frozen(link_fingerprints(rows, distance))
    smallest = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    ids = linked.join(smallest, "fp").groupBy("c").agg(F.min("first").alias("component_id"))
    by_fp = frozen(linked.join(ids, "c").select("fp", "component_id"))
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``documents`` per component, all columns: the one with the smallest id.

    Rows of one id are told apart by text, then by the other columns, and the first of that order stays;
    rows without an id all stay.
    """
    (name,) = fresh(documents, "_identity")
    order = F.struct(F.col(id_col).isNull().alias("no_id"), row_identity(documents, id_col, text_col).alias("identity"))
    rows = documents.withColumn(name, order)
    found = simhash_components(rows, name, text_col, **options)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(name))
    with_id, without = rows.where(F.col(id_col).isNotNull()), rows.where(F.col(id_col).isNull())
    return with_id.join(kept, name, "left_semi").dropDuplicates([name]).unionByName(without).drop(name)
