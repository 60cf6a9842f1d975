"""Compression of vectors to short codes: product codebooks with memoised grid cells.

Components become integers, ``floor(scale * x)``.  A vector is cut into consecutive parts, each with a codebook of
``entries`` integer points that start at the parts of the vectors with the smallest ids and move to the floor of the mean
of what is assigned to them, ``rounds`` times.  A part is assigned to the entry at the least squared distance, the lower
index among equals; an entry that nothing chose stays.

Assignment goes through grid cells.  A part's components shifted right name its cell, a box.  For a cell that a task has
not met, the least and greatest distance from the box to every entry are found once, and the entries whose least distance is
not beyond the smallest greatest distance are remembered: no other entry can be nearest to a point of the box.  Parts
in the cell are compared exactly with those entries only.  The memo of a task holds ``MEMO_CELLS`` cells at most and is
emptied when it is full, which costs time but changes no result.

Each round is one pass over the vectors; a task sends one sum for each codebook component, and what reaches the driver is
the size of the codebooks.  Vectors are read again in every round, so pass a stored table.  All arithmetic is on integers, so
results are the same under any partitioning.

A vector that is null, that holds null or non-finite components, or whose length is not the commonest one (of equally
common ones the longest) is left out.  A length that the parts do not divide is cut as evenly as it goes, longer parts
first.  Integers saturate at +-2^25, so that distances fit in 64 bits.  A null id has its row coded but starts no entry; of
vectors that share an id the least one starts an entry; with fewer ids than ``entries`` the codebooks are smaller, and
with none, but only rows of null id, every code is empty and the error null.  Rows that repeat are coded once each; labels
that are null count as equal; a label's sum beyond 64 bits is null.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.storage import keep

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
MEMO_CELLS = 1 << 17
SATURATED = 1 << 25


@dataclass
class Codebooks:
    """Entries by part ([entries, length of the part] integers) and how vectors become integers."""

    length: int
    scale: int
    parts: list[np.ndarray]

    def spans(self) -> list[slice]:
        edges = np.cumsum([0, *(p.shape[1] for p in self.parts)])
        return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def sha256(self) -> str:
        """Digest of all components in decimal by part, entry and position."""
        return hashlib.sha256(",".join(str(x) for part in self.parts for x in part.ravel().tolist()).encode()).hexdigest()


def integers(column: pa.Array, length: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the usable rows and their integer components, one row each."""
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == length)
    values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), length)
    whole = np.isfinite(values).all(axis=1)
    scaled = np.clip(np.floor(values[whole] * float(scale)), -SATURATED, SATURATED)
    return at[whole], scaled.astype(np.int64)


def cell_bits(entries: np.ndarray) -> int:
    """Binary logarithm of the cell width, at most the mean spread of the entries in one component."""
    spread = float(entries.std(axis=0).mean()) if entries.size else 0.0
    return int(np.log2(max(spread, 2.0)))


class CellMemo:
    """Nearest entries of one part's codebook, through the cells met so far."""

    def __init__(self, entries: np.ndarray, bits: int | None = None, most: int = MEMO_CELLS):
        self.entries, self.most = entries, most
        self.bits = cell_bits(entries) if bits is None else bits
        self.place: dict[bytes, int] = {}
        self.alive = np.zeros((0, len(entries)), bool)
        self.exact = self.points = self.boxes = 0

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """Entries that no other entry dominates across each box."""
        out = np.empty((len(cells), len(self.entries)), bool)
        for at in range(0, len(cells), 4096):
            low = (cells[at : at + 4096] << self.bits)[:, None, :]
            high = low + (1 << self.bits) - 1
            inside = np.clip(self.entries[None], low, high)
            least = ((self.entries[None] - inside) ** 2).sum(axis=2)
            far = np.maximum(np.abs(self.entries[None] - low), np.abs(self.entries[None] - high))
            out[at : at + 4096] = least <= (far**2).sum(axis=2).min(axis=1, keepdims=True)
        return out

    def look_up(self, points: np.ndarray) -> np.ndarray:
        """Candidate entries [points, entries]."""
        cells = np.ascontiguousarray(points >> self.bits)
        names = cells.view(f"V{8 * cells.shape[1]}").ravel()
        distinct, first, inverse = np.unique(names, return_index=True, return_inverse=True)
        if len(self.place) + len(distinct) > self.most:
            self.place, self.alive = {}, self.alive[:0]
        keys = [n.tobytes() for n in distinct]
        new = [i for i, k in enumerate(keys) if k not in self.place]
        if new:
            for j, i in enumerate(new, len(self.alive)):
                self.place[keys[i]] = j
            self.alive = np.concatenate([self.alive, self.candidates(cells[first[new]])])
        self.boxes += len(new)
        return self.alive[[self.place[k] for k in keys]][inverse]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of every point and its squared distance."""
        owner, best = np.zeros(len(points), np.int64), np.full(len(points), np.iinfo(np.int64).max)
        if not len(points) or not points.shape[1]:
            return owner, np.zeros(len(points), np.int64)
        alive = self.look_up(points)
        for k, entry in enumerate(self.entries):
            at = np.flatnonzero(alive[:, k])
            distance = ((points[at] - entry) ** 2).sum(axis=1)
            closer = distance < best[at]
            owner[at[closer]], best[at[closer]] = k, distance[closer]
        self.points, self.exact = self.points + len(points), self.exact + int(alive.sum())
        return owner, best


def common_length(vectors: DataFrame, vector: str) -> int | None:
    """The commonest length of the vectors that are not null; of equally common ones the longest."""
    lengths = vectors.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    return None if top is None else top.length


def first_vectors(vectors: DataFrame, key: str, vector: str, length: int, entries: int, scale: int) -> np.ndarray:
    """Integer vectors of the smallest ids, in their order; a task sends its own smallest ones only."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[int]] = {}
        for batch in batches:
            at, whole = integers(batch.column(1), length, scale)
            ids = batch.column(0).take(pa.array(at)).to_pylist()
            named = sorted((i, row) for row, i in enumerate(ids) if i is not None)
            for i, row in named:
                if len(found) == entries and i > max(found):
                    break
                value = whole[row].tolist()
                found[i] = min(value, found.get(i, value))
            found = {i: found[i] for i in sorted(found)[:entries]}
        yield pa.RecordBatch.from_pydict({"id": pa.array(list(found), pa.int64()), "whole": pa.array(list(found.values()), pa.list_(pa.int64()))})

    own = vectors.select(F.col(key).cast("long"), vector).mapInArrow(least, "id long, whole array<long>")
    rows = own.groupBy("id").agg(F.min("whole").alias("whole")).orderBy("id").limit(entries).collect()
    return np.array([r.whole for r in rows], np.int64).reshape(len(rows), length)


def learn(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> Codebooks | None:
    """Codebooks of a table of vectors; None where no vector is usable."""
    length = common_length(vectors, vector)
    if length is None:
        return None
    books = Codebooks(length, scale, [p.copy() for p in np.array_split(first_vectors(vectors, key, vector, length, entries, scale), parts, axis=1)])
    for _ in range(rounds if len(books.parts[0]) else 0):
        books = moved(vectors, vector, books)
    return books


def moved(vectors: DataFrame, vector: str, books: Codebooks) -> Codebooks:
    """Codebooks whose entries are the floors of the means of the parts assigned to them."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [CellMemo(p) for p in books.parts]
        n = [np.zeros(len(p), np.int64) for p in books.parts]
        total = [np.zeros_like(p) for p in books.parts]
        for batch in batches:
            _, whole = integers(batch.column(0), books.length, books.scale)
            for j, span in enumerate(books.spans()):
                owner, _ = memos[j].nearest(whole[:, span])
                n[j] += np.bincount(owner, minlength=len(n[j]))
                np.add.at(total[j], owner, whole[:, span])
        place = [(j, k, i) for j, p in enumerate(books.parts) for k in range(p.shape[0]) for i in range(p.shape[1])]
        columns = [np.array([x[c] for x in place], np.int32) for c in range(3)]
        sums = np.concatenate([t.ravel() for t in total])
        counts = np.concatenate([np.repeat(c, p.shape[1]) for c, p in zip(n, books.parts, strict=True)])
        yield pa.RecordBatch.from_pydict(dict(zip(("part", "entry", "at", "total", "n"), (*columns, sums, counts), strict=True)))

    sums = vectors.select(vector).mapInArrow(totals, "part int, entry int, at int, total long, n long")
    parts = [p.copy() for p in books.parts]
    for r in sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # the codebooks' size
        if r.n:
            parts[r.part][r.entry, r.at] = r.total // r.n
    return Codebooks(books.length, books.scale, parts)


def encode(vectors: DataFrame, books: Codebooks, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, label, codes (one index a part, as bytes) and error of every usable row."""
    carried = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    schema = carried.select("id", "label").schema.add("codes", "binary").add("error", "long")
    known = len(books.parts[0]) > 0

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [CellMemo(p) for p in books.parts]
        for batch in batches:
            rows, whole = integers(batch.column(2), books.length, books.scale)
            found = [memo.nearest(whole[:, span]) for memo, span in zip(memos, books.spans(), strict=True)] if known else []
            codes = np.stack([o for o, _ in found], axis=1).astype(np.uint8) if found else np.zeros((len(rows), 0), np.uint8)
            error = pa.array(sum(d for _, d in found)) if found else pa.nulls(len(rows), pa.int64())
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([c.tobytes() for c in codes], pa.binary()), error], ["id", "label", "codes", "error"])

    return carried.mapInArrow(coded, schema)


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **how) -> DataFrame:
    """Learn codebooks and code all rows: vec_id, code, error, label_error, codebooks_sha256."""
    books = learn(vectors, key, vector, **how)
    if books is None:
        books = Codebooks(0, SCALE, [np.zeros((0, 0), np.int64)] * PARTS)
    coded = keep(encode(vectors, books, key, vector, label))
    # one row a label; written, so that Spark knows its size when it picks the join
    sums = keep(coded.groupBy(F.col("label").alias("same")).agg(F.try_sum("error").alias("label_error")))
    joint = coded.join(sums, F.col("label").eqNullSafe(F.col("same")))
    return joint.select(F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def compress_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same over a table ``embeddings`` of unique ids whose vectors have one length that ``parts`` divides."""
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cut AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS p FROM kept, (SELECT unnest(range({parts})) AS part))",
        f"book0 AS MATERIALIZED (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS BIGINT) AS entry, p AS c FROM cut WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"near{r} AS MATERIALIZED (SELECT vec_id, cut.part, min(struct_pack(d := CAST(list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - c[i]) * (p[i] - c[i]))) AS BIGINT), entry := entry)) AS best "
            f"FROM cut JOIN book{r} ON cut.part = book{r}.part GROUP BY vec_id, cut.part)"
        )
        if r < rounds:
            steps.append(
                f"sum{r} AS (SELECT part, entry, i, CAST(sum(x) AS BIGINT) AS total, count(*) AS n FROM "
                f"(SELECT cut.part, best.entry AS entry, unnest(range(len(p))) AS i, unnest(p) AS x FROM cut JOIN near{r} ON cut.vec_id = near{r}.vec_id AND cut.part = near{r}.part) GROUP BY part, entry, i)"
            )
            steps.append(
                f"book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{r} AS b LEFT JOIN "
                f"(SELECT part, entry, list((total - (total % n + n) % n) // n ORDER BY i) AS c FROM sum{r} GROUP BY part, entry) AS m ON b.part = m.part AND b.entry = m.entry)"
            )
    last = f"near{rounds}"
    steps.append(f"coded AS (SELECT kept.vec_id, kept.label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM kept JOIN {last} ON kept.vec_id = {last}.vec_id GROUP BY kept.vec_id, kept.label)")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"
