"""Ids of a lower-casing word BPE, exactly as the tokenizers library gives them, with a cache of words.

The library spends most of its time on words it has seen before.  Here a text made of
ordinary Latin characters is cut at white space, and each distinct word is looked up in a
cache of encoded words.  A new word is cut by the vocabulary's own pattern and each part is
merged by ranks: the token ids are the merge ranks, and the end-of-word mark is one more
byte whose merge with the last letter ranks before all others.  Both procedures take the
lowest-ranked adjacent pair first, and every token of the vocabulary is built by its own
merges, so they give the same ids (a test checks this for the whole vocabulary).  Any
text with other characters, or with the string of a special token, goes to the library.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

#: Words kept in a worker's cache before it starts afresh.
CACHE_WORDS = 1_000_000

_END = b"\xff"  # never part of UTF-8
_PLAIN = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x250), *range(0x2010, 0x2028))]


def _kind(letter: str) -> str:
    return "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] in letter)


_LETTERS, _DIGITS = _kind("L"), _kind("N")
_OTHER = "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] not in "LN")
_ORDINARY = re.compile(f"[\t-\r {_LETTERS}{_DIGITS}{_OTHER}]*")
#: The pattern of the vocabulary file, with the classes written out for ordinary characters.
_PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_DIGITS}]|[{_OTHER}]+").findall


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level alphabets print a visible byte as itself and the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordPieces(dict):
    """White-space word -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        special = {t["content"] for t in data["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        byte = _byte_of_symbol()
        ranks = {}
        for symbols, i in data["model"]["vocab"].items():
            if symbols in special:
                continue
            ended = symbols.endswith("</w>")
            ranks[bytes(byte[c] for c in (symbols[:-4] if ended else symbols)) + _END * ended] = i
        ranks[_END] = max(ranks.values()) + len(special) + 1
        self.ranked = tiktoken.Encoding("word pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        self.parts: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= CACHE_WORDS:
                self.parts.clear()
            ids = np.array(self.ranked._encode_single_piece(part.encode() + _END), "<u4").tobytes()
            self.parts[part] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = b"".join([self.part(p) for p in _PARTS(word.lower())])
        if len(word) <= 64:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """All ids of ``text``, without special tokens of the library's own."""
        if _ORDINARY.fullmatch(text) and not self.special.search(text):
            return b"".join(map(self.__getitem__, text.split()))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_OPEN: dict[str, WordPieces] = {}


def word_pieces(path: str) -> WordPieces:
    """One per Python worker and vocabulary, so that the cache serves all tasks of the worker."""
    if path not in _OPEN:
        _OPEN[path] = WordPieces(path)
    return _OPEN[path]
