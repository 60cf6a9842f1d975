"""Documents as positions in word tables: each distinct word is handled once and joined back by position.

Documents are read in chunks of about ``CHUNK_BYTES`` of text.  A chunk has a table of its distinct words, the frequent
ones first, and its documents are one sequence of places in that table.  The words of all chunks are dealt to buckets by
their hash and travel packed, one row for a chunk and bucket; a bucket sees all uses of its words
and answers once for each distinct word; the answers go back to the chunks in the order of the words.  The text itself
is never shuffled, and a frequent word is one entry in each chunk, however often it is used.

The table of chunks is written to the shared folder first: everything after reads the same chunks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.storage import keep

CHUNK_BYTES = 32_000_000
#: Rows of a chunk that are no words: each document, the sequence of places, the bucket of each word.
DOCUMENT, PLACES, LAYOUT = -3, -2, -1
SCHEMA = "chunk long, bucket int, doc_id long, flag boolean, nth long, length long, data binary, counts binary"
ANSWER = "chunk long, bucket int, data binary, more binary"
#: Between words; never part of UTF-8.
MARK = b"\xff"


def pack(values: np.ndarray) -> bytes:
    """Numbers compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(planes.tobytes(), 3)


def pack_runs(values: np.ndarray) -> bytes:
    """Numbers among which sequences repeat, compressed as they are."""
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 9)


def unpack_runs(data: bytes, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def unpack(data: bytes, kind: type = np.uint32) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def pack_words(words: list[str]) -> bytes:
    return zstandard.compress(MARK.join([w.encode() for w in words]), 9)


def unpack_words(data: bytes) -> list[str]:
    return [w.decode() for w in zstandard.decompress(data).split(MARK)]


class Chunk:
    """Word table and documents of one chunk while it is read."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.places: dict[str, int] = {}
        self.documents: list[tuple] = []

    def add(self, doc_id, flag: bool, text: str, words: list[str]) -> None:
        places = self.places
        self.documents.append((doc_id, flag, np.array([places.setdefault(w, len(places)) for w in words], np.uint32)))
        self.bytes += len(text)

    def rows(self, buckets: int) -> pd.DataFrame:
        lengths = [len(places) for _, _, places in self.documents]
        places = np.concatenate([p for _, _, p in self.documents])
        frequent = np.argsort(-np.bincount(places, minlength=len(self.places)), kind="stable")
        number = np.empty(len(frequent), np.uint32)
        number[frequent] = np.arange(len(frequent), dtype=np.uint32)
        places, listed = number[places], list(self.places)
        words = [listed[i] for i in frequent]
        bucket = np.array([zlib.crc32(w.encode()) % buckets for w in words], np.uint32)
        counted = np.repeat([not held_out for _, held_out, _ in self.documents], lengths)
        count = np.bincount(places[counted], minlength=len(words)).astype(np.uint64)
        out = [(self.number, LAYOUT, None, None, None, None, pack(bucket), None), (self.number, PLACES, None, None, None, None, pack(places), None)]
        for nth, (doc_id, flag, own) in enumerate(self.documents):
            out.append((self.number, DOCUMENT, doc_id, flag, nth, len(own), None, None))
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(words) else ():
            out.append((self.number, int(bucket[part[0]]), None, None, None, None, pack_words([words[i] for i in part]), pack(count[part])))
        frame = pd.DataFrame(out, columns=["chunk", "bucket", "doc_id", "flag", "nth", "length", "data", "counts"])
        return frame.astype({"doc_id": "Int64", "flag": "boolean", "nth": "Int64", "length": "Int64"})


def cut(docs: DataFrame, split: Callable[[str], list[str]], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The table of chunks of ``docs`` (doc_id, text, flag); null text is empty.  ``flag`` marks documents not to be counted."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-size // chunk_bytes))
    # small input partitions are read together, so that chunks reach their size
    docs = docs.coalesce(max(buckets, docs.sparkSession.sparkContext.defaultParallelism))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # numbers are unique within the one run whose rows are kept
        first = TaskContext.get().partitionId() << 32
        chunk = Chunk(first)
        for frame in frames:
            for doc_id, flag, text in zip(frame["doc_id"].astype("Int64"), frame["flag"], frame["text"], strict=True):
                text = text or ""
                chunk.add(doc_id, bool(flag), text, split(text))
                if chunk.bytes >= chunk_bytes:
                    yield chunk.rows(buckets)
                    chunk = Chunk(chunk.number + 1)
        if chunk.documents:
            yield chunk.rows(buckets)

    return keep(docs.select(F.col("doc_id").cast("long"), F.col("flag").cast("boolean"), F.col("text").cast("string")).mapInPandas(read, SCHEMA))


class Uses:
    """The words of a bucket in all chunks: distinct words, and their places in each chunk's list."""

    def __init__(self, rows: pd.DataFrame):
        places: dict[str, int] = {}
        self.chunks = rows["chunk"].tolist()
        self.lists = [np.array([places.setdefault(w, len(places)) for w in unpack_words(d)], np.int64) for d in rows["data"]]
        self.words = list(places)
        self.bucket = int(rows["bucket"].iloc[0])
        self.counts = np.zeros(len(places), np.uint64)
        for used, counts in zip(self.lists, rows["counts"], strict=True):
            self.counts[used] += unpack(counts, np.uint64)  # a word appears once in a chunk's list


def per_bucket(table: DataFrame, work: Callable[[Uses], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``work`` to all uses of each bucket's words."""
    return table.where("bucket >= 0").groupBy("bucket").applyInPandas(lambda rows: work(Uses(rows)), schema)


Documents = Iterator[tuple[object, bool, np.ndarray]]


def per_chunk(table: DataFrame, answers: DataFrame, work: Callable[[np.ndarray, pd.DataFrame, Documents], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``work`` to (order, answers by bucket, documents) of each chunk.

    The answers of a chunk's buckets, one after the other, are in the order ``order`` of its words.
    Documents come as (doc_id, flag, places).
    """

    def documents(own: pd.DataFrame) -> Documents:
        places = unpack(own[own["bucket"] == PLACES]["data"].iloc[0])
        rows = own[own["bucket"] == DOCUMENT].sort_values("nth")
        start = 0
        for doc_id, flag, length in zip(rows["doc_id"].astype("Int64"), rows["flag"], rows["length"].astype(int), strict=True):
            yield doc_id, bool(flag), places[start : start + length]
            start += length

    def meet(own: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        layout = own[own["bucket"] == LAYOUT]["data"].iloc[0]
        order = np.argsort(unpack(layout), kind="stable")
        return work(order, answered.sort_values("bucket"), documents(own))

    return table.where("bucket < 0").drop("counts").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(meet, schema)
