"""Token counts and token files against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelspark.llm.bpe import units
from panelspark.llm.token_counts import PieceCounts, count_tokens
from panelspark.llm.token_files import Codes, WordIds, token_files

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
ALPHABET = " \t\n\r\x0b  '  stdrevml''.,<|>endoftext ABCÉéßİıǅſK 12²½Ⅷ٣ 你好ñ́ẞ😀‍\x00\x1c\x1f\x85﻿Σς"
SPECIAL = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> <|endoftext|>  x", "<|startoftext|>Hi<|endoftext|>", "", " ", "  ", "\n ", "x\n ", "x \n  y", "don't  DON'T"]


def texts(n=3000):
    rng = random.Random(5)
    return SPECIAL + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_counts_agree_with_the_library():
    library, counts = Tokenizer.from_file(public_tokenizers.path(BYTE)), PieceCounts(BYTE, most=500)
    for text in texts():
        assert counts.of(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_ids_agree_with_the_library():
    library, words = Tokenizer.from_file(public_tokenizers.path(WORD)), WordIds(WORD, most=500)
    for text in texts():
        assert words.of(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_units_lose_nothing():
    for text in texts(500):
        assert "".join(units(text)) == text


@pytest.mark.parametrize("n", [1, 511, 512, 513, 3000])
def test_any_code_is_read_alone(n):
    ids = np.random.default_rng(n).choice([0, 3, 255, 256, 49407, 70_000, 2**31], n).astype(np.uint32)
    codes = Codes.from_bytes(Codes.pack(ids).to_bytes())
    assert (codes.all() == ids).all()
    assert [codes[i] for i in range(n)] == ids.tolist()


def test_count_tokens_returns_every_row(documents, odd_rows):
    library = Tokenizer.from_file(public_tokenizers.path(BYTE))
    got = sorted(map(tuple, count_tokens(documents(odd_rows), BYTE).collect()), key=repr)
    want = [(r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in odd_rows]
    assert got == sorted([(*w, w[2] > 1024) for w in want], key=repr)
    assert count_tokens(documents([]), BYTE).count() == 0


def test_token_files_round_trip(documents, odd_rows, tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path(WORD))
    got = token_files(documents(odd_rows), WORD, str(tmp_path / "files")).collect()
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for row in rows:
        ids = [*library.encode(row[1] or "", add_special_tokens=False).ids, 2]
        want.append((row[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, got), key=lambda r: r[1])
    assert [r[0] for r in got] == [w[0] for w in want]
    assert sorted((r[0], r[2], r[3]) for r in got if r[0] is not None) == sorted((w[0], w[2], w[3]) for w in want if w[0] is not None)
    assert [r[1] for r in got] == list(np.cumsum([0, *(r[2] for r in got[:-1])]))


def test_token_files_of_an_empty_table(documents, tmp_path):
    assert token_files(documents([]), WORD, str(tmp_path / "none")).count() == 0
