"""Byte-pair encoding of single pre-tokens, from a tokenizer file of the tokenizers library."""

from __future__ import annotations

import json
import os
import re

#: Marks the end of a word where a vocabulary has an end-of-word suffix; no UTF-8 text holds this byte.
END = b"\xff"
WHITE_RUNS = re.compile(r"\s*\S+|\s+")


def file_of(name: str) -> str:
    """A path as it is; any other name is a file of the installed public tokenizers."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(name))


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, to the byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PieceEncoder:
    """Ids of one pre-token at a time, merging by rank.

    Ranks come from the order of the file's merges. An end-of-word suffix is a byte of its own here, which
    joins the byte before it first of all, as the library does when it splits a word into characters.
    Texts with special strings, and files of other kinds, are left to the library (``whole_text``).
    """

    def __init__(self, name: str):
        import tiktoken
        from tokenizers import Tokenizer

        path = file_of(name)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.special_words = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        suffix = model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()

        def raw(token: str) -> bytes:
            ends = bool(suffix) and token.endswith(suffix)
            return bytes(alphabet[c] for c in (token[: -len(suffix)] if ends else token)) + (END if ends else b"")

        ids = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        ranks = {bytes([b]): b for b in range(256)}
        if suffix:
            ranks |= {bytes([b]) + END: 256 + b for b in range(256)}
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ranks[raw(left) + raw(right)] = len(ranks)
        self.end = END if suffix else b""
        self.id_of = {rank: ids.get(token) for token, rank in ranks.items()}
        self.merge = tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def count(self, piece: str) -> int:
        return len(self.merge(piece.encode() + self.end))

    def ids(self, piece: str) -> list[int]:
        return [self.id_of[rank] for rank in self.merge(piece.encode() + self.end)]

    def whole_text(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids


def units(text: str) -> list[str]:
    """The text cut before each run of white space that follows something else.

    No pre-token of a byte-level pattern crosses such a cut. Splitting at single spaces gives the same
    cuts, quicker, if no space stands next to a space or last after other white space.
    """
    if "  " in text or (text[-1:] == " " and text[-2:-1].isspace()):
        return WHITE_RUNS.findall(text)
    first, *rest = text.split(" ")
    spaced = [" " + unit for unit in rest]
    return [first, *spaced] if first else spaced
