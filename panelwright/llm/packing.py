"""Packing documents into fixed windows: best-fit decreasing over a segment tree of free space.

A document longer than a window is first cut into full windows; the rest of it, and every
shorter document, is one piece.  Pieces are dealt at random into lots of about
``LOT_WINDOWS`` windows, and each lot is packed on its own: longest piece first, each into
the open window with the least free space that still holds it.  A lot has a bounded size,
so no task depends on the size of the corpus, and the space lost at the end of a lot is
at most one window in ``LOT_WINDOWS``.

Only lengths and checksums move between executors, never ids or texts.

Null text counts as empty (one piece with the end id alone); a null doc_id is kept; rows that
repeat are packed once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.storage import keep
from panelwright.llm.wordpieces import word_pieces

WINDOW = 4096
END_ID = 2
LOT_WINDOWS = 512

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, lot_key long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class FreeSpace:
    """Open windows by their free space, in a segment tree of counts over 0..capacity."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: dict[int, list[int]] = {}

    def _add(self, space: int, step: int) -> None:
        node = self.leaves + space
        while node:
            self.count[node] += step
            node >>= 1

    def put(self, space: int, window: int) -> None:
        self.windows.setdefault(space, []).append(window)
        self._add(space, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out (window, free space) with the least free space >= need."""
        node = self.leaves + need
        if not self.count[node]:
            # climb until a right sibling holds windows, then go down to its leftmost leaf
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        space = node - self.leaves
        window = self.windows[space].pop()
        self._add(space, -1)
        return window, space


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset for each length; ``lengths`` must be in decreasing order."""
    free, opened = FreeSpace(window), 0
    number = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        found = free.tightest(length)
        if found is None:
            found, opened = (opened, window), opened + 1
        number[i], space = found
        offset[i] = window - space
        if space > length:
            free.put(space - length, found[0])
    return number, offset


def cut_pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece; ``doc_id`` and ``text`` are read."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = word_pieces(vocabulary).encode
        seen = 0
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids = encode(text or "") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    seen += 1
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total, seen))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "lot_key"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(cut, PIECES)


def pack(pieces: DataFrame, window: int = WINDOW, lot_windows: int = LOT_WINDOWS) -> DataFrame:
    """Assign every piece a sequence and an offset in it."""
    # the row number that salts the lot differs when a task runs again, so it is fixed in a table first
    pieces = keep(pieces)
    tokens = pieces.agg(F.sum("length")).first()[0] or 0
    lots = max(1, round(tokens / (window * lot_windows)))
    lot = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "lot_key"), F.lit(lots))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        number, offset = best_fit_decreasing(rows["length"].to_numpy(), window)
        rows["sequence_id"], rows["offset"] = (int(key[0]) << 32) + number, offset
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return pieces.withColumn("lot", lot).groupBy("lot").applyInPandas(fill, PACKED)


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Tokenize, cut and pack all documents."""
    return pack(cut_pieces(docs, vocabulary, window, end_id), window)
