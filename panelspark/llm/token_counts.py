"""Token counts from distinct pre-tokens, without ids."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.bpe import PieceEncoder, units
from panelspark.llm.common import whole

#: The pattern that byte-level vocabularies split text by before merging.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens that a task remembers; when there are more, it forgets them and counts them again.
CACHE = 400_000


class PieceCounts(dict):
    """Pieces of each unit of a text, counted on first sight and for each distinct pre-token once."""

    def __init__(self, name: str, most: int = CACHE):
        super().__init__()
        import regex

        self.encoder, self.split, self.most = PieceEncoder(name), regex.compile(BYTE_LEVEL).findall, most
        self.pieces: dict[str, int] = {}

    def __missing__(self, unit: str) -> int:
        n = 0
        for pre in self.split(unit):
            if (k := self.pieces.get(pre)) is None:
                k = self.pieces[pre] = self.encoder.count(pre)
            n += k
        self[unit] = n
        return n

    def forget(self) -> None:
        if len(self) > self.most:
            self.clear()
        if len(self.pieces) > self.most:
            self.pieces.clear()

    def of(self, text: str) -> int:
        """Tokens of a text: frequencies of its units, joined to their piece counts, and summed."""
        self.forget()
        total = 0
        parts = self.encoder.special_words.split(text)
        for part in parts:
            if len(part) < 4_000_000:
                total += sum(n * self[unit] for unit, n in Counter(units(part)).items())
            else:
                for unit, n in Counter(units(part)).items():
                    total += n * self[unit]
                    self.forget()
        return total + len(parts) - 1


def count_tokens(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per row of ``documents``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Counts agree with the tokenizers library for byte-level BPE files, without begin, end or padding; a
    special string inside a text is one token, as in the library. Each task counts the pieces of a
    distinct pre-token once and joins them to the frequencies within each document in place: shuffling
    (document, pre-token, frequency) rows for a join would move several times the input, as nearly all
    pre-tokens of a document are distinct. No ids are made. Null texts are empty, with 0 tokens; a text of
    any length is read whole. Rows are returned one for one; other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PieceCounts(tokenizer)
        for batch in batches:
            n = [counts.of(text.as_py()) for text in batch["body"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = dict(documents.dtypes)[id_col]
    text = whole(F.col(text_col))
    rows = documents.select(F.col(id_col).alias("doc_id"), text.alias("body"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
