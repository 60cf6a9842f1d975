"""SentencePiece encoding and decoding through a table of distinct marked words.

The library puts a marker where a word begins (in place of each space, and one before the text) and merges pieces
from there.  If no piece of the model has anything before a marker but other markers, no merge crosses the border
before a marker, and the ids of a text are the ids of its marked words one after the other.
``MarkedWords`` checks this for the model, and that the model leaves white space as it is; it refuses others.  Every
distinct marked word is then segmented once by the library, and documents take its ids by position.

Null text counts as empty: no ids, and an empty decoded text.  Rows that repeat, and null ids, get a row each.  An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.chunks import ANSWER, Documents, Uses, cut, pack, pack_runs, per_bucket, per_chunk, unpack, unpack_runs

SPACE_MARK = "▁"
#: Larger chunks than elsewhere: ids are most of what travels, and a word's ids travel once for each chunk.
CHUNK_BYTES = 44_000_000
_MARKED = re.compile(r" *[^ ]+| +\Z").findall


def marked_words(text: str) -> list[str]:
    """Runs of markers (written as spaces) with what follows them up to the next marker."""
    return _MARKED(" " + text.replace(SPACE_MARK, " ")) if text else []


class MarkedWords:
    """The library's model, used on one marked word at a time."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = library = SentencePieceProcessor(model_file=path)
        pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        crossing = [p for p in pieces if re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p)]
        if crossing or library.decode(library.encode("  a  b ")) != "  a  b ":
            raise ValueError(f"pieces of this model cross markers, or it changes white space: {crossing[:3]}")
        self.marker = library.piece_to_id(SPACE_MARK)

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each marked word; the library adds the first marker itself, save to an empty text."""
        ids = self.library.encode([w[1:] for w in words], num_threads=1)
        return [i if w != " " else [self.marker] for i, w in zip(ids, words, strict=True)]


_OPEN: dict[str, MarkedWords] = {}


def model(path: str) -> MarkedWords:
    if path not in _OPEN:
        _OPEN[path] = MarkedWords(path)
    return _OPEN[path]


def encode_decode(docs: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them."""
    table = cut(docs.select("doc_id", "text", F.lit(False).alias("flag")), marked_words, chunk_bytes)

    def segment(uses: Uses) -> pd.DataFrame:
        ids = model(path).encode(uses.words)
        length = np.array([len(i) for i in ids], np.uint32)
        first = np.cumsum(length, dtype=np.int64) - length
        flat = np.array([i for word in ids for i in word], np.uint32)
        out = []
        for chunk, used in zip(uses.chunks, uses.lists, strict=True):
            out.append((chunk, uses.bucket, pack(length[used]), pack_runs(flat[ranges(first[used], length[used])])))
        return pd.DataFrame(out, columns=["chunk", "bucket", "data", "more"])

    def join_back(order: np.ndarray, answers: pd.DataFrame, documents: Documents) -> pd.DataFrame:
        library = model(path).library
        length = np.zeros(len(order), np.int64)
        first = np.zeros(len(order), np.int64)
        flat = np.zeros(0, np.uint32)
        if len(order):
            in_order = np.concatenate([unpack(d) for d in answers["data"]]).astype(np.int64)
            length[order], first[order] = in_order, np.cumsum(in_order) - in_order
            flat = np.concatenate([unpack_runs(d) for d in answers["more"]])
        out = []
        for doc_id, _, places in documents:
            ids = flat[ranges(first[places], length[places])].tolist()
            out.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
        return pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]).astype({"doc_id": "Int64"})

    answers = per_bucket(table, segment, ANSWER)
    return per_chunk(table, answers, join_back, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of each range, one range after the other."""
    before = np.cumsum(length, dtype=np.int64) - length
    return np.repeat(first - before, length) + np.arange(int(length.sum(dtype=np.int64)))
