"""Token ids of whole texts by a public tokenizer file, with bounded caches.

For tokenizer files that split a text into words and drop the white space between them (``word_bpe_49k.json``), the ids of a
text are the ids of its white-space-delimited pieces in order. Pieces recur, so each is encoded once per task and cache life.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from functools import lru_cache

from tokenizers import Tokenizer

CACHE_ENTRIES = 600_000  # of pieces, and as many of words: about 250 MB
LONGEST_CACHED = 200
# White space of str.split() that the tokenizer does not take for white space.
_ODD = re.compile("[\x1c-\x1f]")
_PIECE = re.compile("(?:[\x1c-\x1f]|\\S)+")


# Characters that the tokenizers library knows and Python's tables (Unicode 15.1) do not yet.
LATER_LETTERS = [
    (0x1C8A, 0x1C8A), (0xA7CD, 0xA7CD), (0xA7DB, 0xA7DB), (0x105C0, 0x105F3), (0x10D4A, 0x10D4F), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
LATER_DIGITS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
]
LATER_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB,
    0xA7DC: 0x19B, **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}


def pieces(text: str) -> list[str]:
    return _PIECE.findall(text) if _ODD.search(text) else text.split()


class BoundedCache(dict):
    """Results of ``make`` by piece. Long pieces are not kept. A full half makes room and stays readable until the next one is full."""

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.half, self.older = make, entries // 2, {}

    def __missing__(self, piece: str):
        value = self.older.get(piece)
        if value is None:
            value = self.make(piece)
        if len(piece) <= LONGEST_CACHED:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[piece] = value
        return value


@lru_cache(None)
def char_class(major: str) -> str:
    """Ranges of all characters of a general category, for use inside square brackets."""
    found, first, last = [], None, None
    for c in range(sys.maxunicode + 2):
        if c <= sys.maxunicode and unicodedata.category(chr(c))[0] == major:
            first = c if first is None else first
            last = c
        elif first is not None:
            found.append(f"\\U{first:08x}-\\U{last:08x}")
            first = None
    later = {"L": LATER_LETTERS, "N": LATER_DIGITS}[major]
    return "".join(found + [f"\\U{a:08x}-\\U{b:08x}" for a, b in later])


@lru_cache(None)
def word_pattern() -> re.Pattern:
    """The split of the word tokenizer: clitics, letter runs, single digits, runs of other signs. Not for text with white space."""
    letters, digits = char_class("L"), char_class("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{letters}{digits}]+")


_ASCII_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def words_of(piece: str) -> list[str]:
    """Words of a normalised piece without white space."""
    return (_ASCII_WORDS if piece.isascii() else word_pattern()).findall(piece)


def lowered(piece: str) -> str:
    """NFC, then lower case character by character, as the tokenizer file says."""
    if piece.isascii():
        return piece.lower()
    piece = unicodedata.normalize("NFC", piece)
    piece = "".join(map(str.lower, piece)) if "Σ" in piece else piece.lower()  # a final sigma is no special case there
    return piece.translate(LATER_LOWER) if max(piece) > "\u1c88" else piece


@lru_cache(None)
def byte_signs() -> list[str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    signs = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [signs[b] for b in range(256)]


def as_signs(word: str) -> str:
    return word if word.isascii() and word.isprintable() else "".join(map(byte_signs().__getitem__, word.encode()))


def special_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


class PieceIds:
    """ids as little-endian unsigned 32-bit numbers, made by the tokenizers library: ``PieceIds(path).of(text)``."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        self.special = re.compile("|".join(map(re.escape, special_tokens(path))))
        self.encode = lambda piece: tokenizer.encode(piece, add_special_tokens=False).ids
        self.model = tokenizer.model
        self.packed = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]
        self.words = BoundedCache(self._word, entries)
        self.cache = BoundedCache(self._piece, entries)

    def _word(self, word: str) -> bytes:
        return b"".join([self.packed[t.id] for t in self.model.tokenize(as_signs(word))])

    def _piece(self, piece: str) -> bytes:
        if self.special.search(piece):
            return b"".join([self.packed[i] for i in self.encode(piece)])
        # The library's model on the words of the piece: its whole pipeline costs ten times as much on a short text.
        return b"".join(map(self.words.__getitem__, words_of(lowered(piece))))

    def of(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, pieces(text)))


@lru_cache(2)
def piece_ids(path: str, entries: int = CACHE_ENTRIES) -> PieceIds:
    """One per Python worker and tokenizer file, so that tasks share the caches."""
    return PieceIds(path, entries)
