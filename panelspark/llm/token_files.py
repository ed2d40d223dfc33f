"""Token ids as files of directly addressable codes."""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm.bpe import PieceEncoder
from panelspark.llm.common import shared_folder, whole

#: The pattern that the word vocabulary keeps of a text.
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END_ID = 2
#: Bits of an id in each level; ids of the last level have no continuation.
LEVEL_BITS = 8
#: Bits of a continuation bitmap that one entry of its rank directory covers.
RANK_BITS = 512
#: Ids after which a segment ends, at the next document's end.
SEGMENT_IDS = 1 << 18
CACHE = 400_000
COLUMNS = ["shard", "segment", "n_ids", "doc_ids", "lengths", "codes"]
#: White space to Python's split, but not to the vocabulary.
ODD_WHITE = re.compile("[\x1c-\x1f]")


class Codes:
    """A sequence of ids of which any can be read without decoding the ones around it.

    Level 0 has the low ``LEVEL_BITS`` bits of every id. A bitmap says which ids go on; level 1 has the
    next bits of those alone, and so on. An id's place in the next level is the rank of its bit, which
    the directory gives: set bits before each ``RANK_BITS`` block, plus those inside the block.
    """

    def __init__(self, levels: list[np.ndarray], bitmaps: list[np.ndarray], ranks: list[np.ndarray]):
        self.levels, self.bitmaps, self.ranks = levels, bitmaps, ranks

    @classmethod
    def pack(cls, ids: np.ndarray) -> Codes:
        rest, levels, bitmaps, ranks = ids.astype(np.uint64), [], [], []
        while True:
            levels.append((rest & np.uint64((1 << LEVEL_BITS) - 1)).astype(np.uint8))
            rest = rest >> np.uint64(LEVEL_BITS)
            more = rest > 0
            if not more.any():
                return cls(levels, bitmaps, ranks)
            bits = np.zeros(-(-len(more) // RANK_BITS) * RANK_BITS, dtype=np.uint8)
            bits[: len(more)] = more
            per_block = bits.reshape(-1, RANK_BITS).sum(axis=1, dtype=np.uint64)
            ranks.append(np.concatenate([[0], np.cumsum(per_block)[:-1]]).astype("<u4"))
            bitmaps.append(np.packbits(bits, bitorder="little"))
            rest = rest[more]

    def to_bytes(self) -> bytes:
        head = [len(self.levels), *(len(level) for level in self.levels)]
        parts = [np.array(head, dtype="<u4").tobytes(), self.levels[0].tobytes()]
        for level, bitmap, rank in zip(self.levels[1:], self.bitmaps, self.ranks, strict=True):
            parts += [bitmap.tobytes(), rank.tobytes(), level.tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Codes:
        n = int(np.frombuffer(data, "<u4", 1)[0])
        sizes = np.frombuffer(data, "<u4", n, 4).tolist()
        at = 4 * (n + 1)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(data, kind, count, at)
            at += part.nbytes
            return part

        levels, bitmaps, ranks = [take("u1", sizes[0])], [], []
        for above, size in zip(sizes, sizes[1:], strict=False):
            blocks = -(-above // RANK_BITS)
            bitmaps.append(take("u1", blocks * RANK_BITS // 8))
            ranks.append(take("<u4", blocks))
            levels.append(take("u1", size))
        return cls(levels, bitmaps, ranks)

    def __getitem__(self, place: int) -> int:
        """One id: a byte of each level that it reaches."""
        value, at = int(self.levels[0][place]), place
        for k, bitmap in enumerate(self.bitmaps):
            if not bitmap[at >> 3] >> (at & 7) & 1:
                break
            block = at // RANK_BITS
            first = block * RANK_BITS // 8
            before = np.unpackbits(bitmap[first : (at >> 3) + 1], bitorder="little")[: at - block * RANK_BITS]
            at = int(self.ranks[k][block]) + int(before.sum())
            value |= int(self.levels[k + 1][at]) << (LEVEL_BITS * (k + 1))
        return value

    def all(self) -> np.ndarray:
        """All ids in order, level by level."""
        values = self.levels[0].astype("<u4")
        places = np.arange(len(values))
        for k, bitmap in enumerate(self.bitmaps):
            places = places[np.unpackbits(bitmap, count=len(self.levels[k]), bitorder="little").astype(bool)]
            values[places] |= self.levels[k + 1].astype("<u4") << np.uint32(LEVEL_BITS * (k + 1))
        return values


class WordIds(dict):
    """Ids of each white-space-free part of a text, found on first sight."""

    def __init__(self, name: str, most: int = CACHE):
        super().__init__()
        import regex

        self.encoder, self.split, self.most = PieceEncoder(name), regex.compile(WORD_LEVEL).findall, most

    def __missing__(self, unit: str) -> list[int]:
        ids = self[unit] = [i for word in self.split(unit) for i in self.encoder.ids(word)]
        return ids

    def of(self, text: str) -> list[int]:
        """Ids of a text as the library gives them: NFC, lower case, white space dropped."""
        if len(self) > self.most:
            self.clear()
        if "<|" in text and self.encoder.special_words.search(text) or ODD_WHITE.search(text):
            return self.encoder.whole_text(text)
        # Capital sigma has one lower case here, wherever in a word it stands.
        lower = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        ids: list[int] = []
        for unit in map(self.__getitem__, lower.split()):
            ids += unit
        return ids


def write_token_files(documents: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode whole texts and write their ids, each with ``end_id`` after them, in ascending id order.

    Documents are range-partitioned and sorted by id (ties: by text); partition p is shard p of the
    files. A shard is rows of (shard, segment, n_ids, doc_ids, lengths, codes): up to about
    ``SEGMENT_IDS`` ids as ``Codes``, of whole documents, so memory is bounded by a segment or the longest
    document. Spark's own writer commits the files, so a task that is lost and run again leaves one copy.
    Null texts are empty and have the end id alone; a null id comes first.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        segment, docs, lengths, parts, n, shard = 0, [], [], [], 0, 0

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            codes = Codes.pack(np.concatenate(parts)).to_bytes()
            values = [[shard], [segment], [n], [docs], [lengths], [codes]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(kind), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], COLUMNS)

        for batch in batches:
            for shard, doc, text in zip(batch["shard"].to_pylist(), batch["doc_id"].to_pylist(), batch["body"], strict=True):
                ids = np.array([*words.of(text.as_py()), end_id], dtype=np.uint32)
                docs.append(doc)
                lengths.append(len(ids))
                parts.append(ids)
                n += len(ids)
                if n >= SEGMENT_IDS:
                    yield flush(batch["doc_id"].type)
                    segment, docs, lengths, parts, n = segment + 1, [], [], [], 0
        if docs:
            yield flush(batch["doc_id"].type)

    kind = dict(documents.dtypes)[id_col]
    rows = documents.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("body"))
    ranged = rows.repartitionByRange("doc_id", F.xxhash64("body")).sortWithinPartitions("doc_id", "body")
    ranged = ranged.select(F.spark_partition_id().alias("shard"), "doc_id", "body")
    schema = f"shard int, segment int, n_ids long, doc_ids array<{kind}>, lengths array<int>, codes binary"
    ranged.mapInArrow(encode, schema).write.mode("overwrite").parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids before it), n_tokens, ids_crc32.

    The files' totals per segment, one row per ``SEGMENT_IDS`` ids, are summed per shard; only the shards'
    totals, one row per written partition, meet in one place.
    """
    segments = spark.read.parquet(folder)
    kind = dict(segments.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    sizes = segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()  # one row per partition
    before, offsets = 0, []
    for row in sorted(sizes, key=lambda r: r["shard"]):
        offsets.append((row["shard"], before))
        before += row["n"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "segment", "doc_id", "place", "n_tokens", "ids_crc32"]
        for batch in batches:
            for i, (shard, segment) in enumerate(zip(batch["shard"].to_pylist(), batch["segment"].to_pylist(), strict=True)):
                ids, lengths = Codes.from_bytes(batch["codes"][i].as_py()).all(), batch["lengths"][i].values.to_numpy()
                ends = np.cumsum(lengths, dtype=np.int64)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends - lengths, ends, strict=True)]
                same = [pa.array(np.full(len(crc), v, np.int32)) for v in (shard, segment)]
                rest = [pa.array(v, pa.int64()) for v in (ends - lengths, lengths, crc)]
                yield pa.RecordBatch.from_arrays([*same, batch["doc_ids"][i].values, *rest], names)

    docs = segments.mapInArrow(decode, f"shard int, segment int, doc_id {kind}, place long, n_tokens long, ids_crc32 long")
    earlier = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    at = segments.select("shard", "segment", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("within"))
    shards = F.broadcast(spark.createDataFrame(offsets, "shard int, before long"))
    placed = docs.join(at, ["shard", "segment"]).join(shards, "shard")
    return placed.select("doc_id", (F.col("before") + F.col("within") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_files(documents: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files (see ``write_token_files``) and return what ``read_token_files`` reads from them.

    Without a folder they go to a new one in the session's checkpoint folder.
    """
    spark = documents.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/token-files-{uuid.uuid4()}"
    write_token_files(documents, folder, tokenizer, id_col, text_col)
    return read_token_files(spark, folder)
