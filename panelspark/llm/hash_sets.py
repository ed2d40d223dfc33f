"""Sets of 64-bit hashes as bit tables of a fixed size, which tasks may look up without a join."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one row of a table, 4 KB; what bitmap_construct_agg makes.
ROW_BITS = 15


def bit_table(keys: DataFrame, key: str | Column, bits: int) -> Broadcast:
    """A broadcast table of 2^bits bits with a bit set for each key (a long, evenly spread).

    Its size is 2^bits / 8 bytes however many keys there are: bits are set by an aggregation, and at most
    2^(bits - 15) rows of 4 KB reach the driver. Lookups never miss a key; other keys are let through as
    often as the table is full, so callers use it to leave out work and settle the rest exactly.
    """
    place = F.shiftrightunsigned(key, 64 - bits).alias("place")
    rows = keys.select(place).groupBy(F.shiftright("place", ROW_BITS).alias("row"))
    rows = rows.agg(F.bitmap_construct_agg(F.col("place").bitwiseAND((1 << ROW_BITS) - 1)).alias("bitmap"))
    table = np.zeros((1 << (bits - ROW_BITS), 1 << (ROW_BITS - 3)), dtype=np.uint8)
    for row in rows.collect():
        table[row["row"]] = np.frombuffer(row["bitmap"], dtype=np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table.ravel())


def in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (unsigned 64-bit) have their bit set."""
    bits = int(table.size * 8).bit_length() - 1
    place = keys >> np.uint64(64 - bits)
    return (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One hash of two, in order; products wrap at 64 bits."""
    out = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


#: ASCII white space: tab to carriage return, and space.
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes that are hashed at a time.
BLOCK = 1 << 20


class WordHashes:
    """64-bit hashes of all words of a text, between ASCII white space, without a step in Python per word.

    A word's bytes are looked up as random numbers and summed with powers of an odd number, modulo 2^64; what
    stands before the word is taken off by differences of running sums.
    """

    def __init__(self, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.letters = draw.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(draw.integers(0, 1 << 62)) * 4 + 3
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 1 << 16)
            steps = np.full(n, self.base, dtype=np.uint64), np.full(n, pow(self.base, -1, 1 << 64), dtype=np.uint64)
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.multiply.accumulate(s) for s in steps)

    def of(self, text: bytes) -> np.ndarray:
        """The words' hashes in order."""
        return self.spans(text)[0]

    def spans(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' hashes, and where each starts and ends."""
        out, at = [(np.zeros(0, dtype=np.uint64), *np.zeros((2, 0), dtype=np.int64))], 0
        while at < len(text):
            end = self._cut(text, at)
            hashes, starts, ends = self._block(np.frombuffer(text, dtype=np.uint8, count=end - at, offset=at))
            out.append((hashes, starts + at, ends + at))
            at = end
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _cut(self, text: bytes, at: int) -> int:
        """The end of a block: white space before its limit, or else the next there is."""
        limit = at + BLOCK
        if limit >= len(text):
            return len(text)
        block = WHITE[np.frombuffer(text, dtype=np.uint8, count=BLOCK, offset=at)]
        if block.any():
            return at + len(block) - int(block[::-1].argmax())
        rest = WHITE[np.frombuffer(text, dtype=np.uint8, offset=limit)]
        return limit + int(rest.argmax()) if rest.any() else len(text)

    def _block(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._powers(len(raw))
        white = np.ones(len(raw) + 2, dtype=bool)
        white[1:-1] = WHITE[raw]
        edges = np.flatnonzero(white[1:] != white[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.letters[raw] * self.up[: len(raw)], out=sums[1:])
        found = (sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)
        found ^= found >> np.uint64(31)
        found *= np.uint64(0xBF58476D1CE4E5B9)
        return found ^ (found >> np.uint64(32)), starts, ends
