"""Importance resampling towards a target distribution, and exact selection by weighted medians of medians.

A text's features are its runs of one to three words (A-Z lower-cased, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``), hashed
by CRC-32 into ``BUCKETS`` buckets.  Each bucket's gain is the floored logarithm of how much likelier the target text is to fill
it than the corpus, from counts over all rows of both tables.  A row's weight is the sum of its features' gains, read
from one array; its score adds Gumbel noise from a hash of its id, so the highest scores are a sample without
replacement in proportion to exp(weight).

The cutoff of the highest scores is found exactly.  Every partition sends the median of the keys it still has and how many they
are; the median of these, weighted by the numbers, has at least a quarter of the remaining keys on either side, and one
side is discarded.  Keys are (score descending, doc_id, n_features, row number in the scored table), which no two rows share.  When
``LAST`` keys or fewer remain, the driver orders them.  Rows up to the cutoff are range-partitioned, sorted and numbered.

Null text has no words; a text without words has weight 0.  A null doc_id is hashed as empty and comes last among equal scores;
rows that repeat have the same score and are drawn one after the other; with no row of ``LEAST_WORDS`` words, or an empty
table, nothing is drawn; an empty target gives every bucket the gain of no count.  Other columns are ignored.  A text of any
length is read whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.storage import keep
from panelwright.llm.words import batches

BUCKETS, LONGEST_RUN = 10_000, 3
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
LAST = 1000
#: Words of more bytes are hashed one by one.
SHORT = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _byte_steps() -> np.ndarray:
    """CRC-32 of one byte: the remainder of each byte value by the reversed polynomial 0xEDB88320."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> np.uint32(1)) ^ np.uint32(0xEDB88320), value >> np.uint32(1))
    return value


_STEP = _byte_steps()


def _shifts() -> np.ndarray:
    """[length, place of the byte, byte]: what a checksum becomes when so many bytes follow it."""
    out = np.empty((SHORT + 2, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(1, SHORT + 2):
        out[n] = _STEP[out[n - 1] & 255] ^ (out[n - 1] >> np.uint32(8))
    return out.reshape(-1)


_SHIFT = _shifts()
_SPACE = np.uint32(zlib.crc32(b" "))


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums carried over n (at most ``SHORT`` + 1) following bytes."""
    base = n * 1024
    out = _SHIFT[base + (crc & 255)]
    for k in (1, 2, 3):
        out ^= _SHIFT[base + 256 * k + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
    return out


class Runs:
    """Words of several texts and the checksums of all runs of them."""

    def __init__(self, texts: list[bytes]):
        self.bytes = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        inside = _IN_WORD[self.bytes].astype(np.int8)
        turn = np.diff(np.concatenate([[0], inside]))
        self.starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        self.sizes = ends - self.starts
        first = np.searchsorted(self.starts, edges)
        self.n_words = np.diff(first)
        self.text = np.repeat(np.arange(len(texts)), self.n_words)

    def word(self, i: int) -> bytes:
        return self.bytes[self.starts[i] : self.starts[i] + self.sizes[i]].tobytes()

    def checksums(self) -> np.ndarray:
        """CRC-32 of every word, one byte of all words at a time."""
        order = np.argsort(-self.sizes, kind="stable")
        sizes, at = self.sizes[order], self.starts[order]
        long = int(np.searchsorted(-sizes, -SHORT, side="left"))
        crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
        for k in range(min(SHORT, int(sizes[long]) if long < len(sizes) else 0)):
            n = int(np.searchsorted(-sizes, -k, side="left"))
            crc[long:n] = _STEP[(crc[long:n] ^ self.bytes[at[long:n] + k]) & 255] ^ (crc[long:n] >> np.uint32(8))
        crc ^= np.uint32(0xFFFFFFFF)
        for i in range(long):
            crc[i] = zlib.crc32(self.word(order[i]))
        out = np.empty_like(crc)
        out[order] = crc
        return out

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text number, checksum) of the runs of each length."""
        word = self.checksums()
        short = self.sizes <= SHORT
        after = np.minimum(self.sizes, SHORT)
        spaced = shifted(np.full(len(word), _SPACE), after) ^ word
        crc = word
        yield self.text, crc
        for n in range(1, LONGEST_RUN):
            crc = crc[: len(word) - n]
            joined = shifted(crc, after[n:] + 1) ^ spaced[n:]
            for i in np.flatnonzero(~short[n:]):
                joined[i] = zlib.crc32(b" " + self.word(i + n), int(crc[i]))
            whole = self.text[: len(word) - n] == self.text[n:]
            yield self.text[: len(word) - n][whole], joined[whole]
            crc = joined


def text_runs(column: pa.Array) -> Iterator[Runs]:
    """The texts of a column in their order, in groups of about ``JOIN_BYTES``."""
    for group in batches(column.to_pylist()):
        yield Runs(group)


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """Number of features in each bucket over all rows; a task sends one row a bucket."""

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in frames:
            for runs in text_runs(batch.column(0)):
                for _, crc in runs.runs():
                    total += np.bincount(crc % np.uint32(BUCKETS), minlength=BUCKETS)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(filled.astype(np.int32)), "n": pa.array(total[filled])})

    rows = texts.select(F.col(text).cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold logarithm of the smoothed ratio of target to corpus for each bucket."""
    s_all, t_all = int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: float((t + 1) * (s_all + BUCKETS)) / float((s + 1) * (t_all + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""

    def scored(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            found = []
            for runs in text_runs(batch.column(1)):
                n, weight = np.zeros(len(runs.n_words), np.int64), np.zeros(len(runs.n_words), np.int64)
                for owner, crc in runs.runs():
                    n += np.bincount(owner, minlength=len(n))
                    total = np.concatenate([[0], np.cumsum(gain[crc % np.uint32(BUCKETS)])])
                    edge = np.searchsorted(owner, np.arange(len(n) + 1))
                    weight += total[edge[1:]] - total[edge[:-1]]
                found.append((runs.n_words, n, weight))
            columns = [pa.array(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, n_words long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """Thousandfold Gumbel noise, floored, from the first 32 bits of a digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


#: Ascending order in which rows are drawn.
KEY_PARTS = ("less", "unnamed", "id", "n_features", "row")


def draw_key() -> Column:
    return F.struct(
        (-F.col("score")).alias("less"), F.col("doc_id").isNull().cast("long").alias("unnamed"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"),
        F.col("n_features"), F.col("row"),
    )


def literal(key: tuple[int, ...]) -> Column:
    return F.struct(*[F.lit(v).cast("long").alias(name) for name, v in zip(KEY_PARTS, key, strict=True)])


def side_medians(rows: DataFrame, pivot: tuple[int, ...] | None) -> list:
    """(better, size, key) of every partition: its median among the keys before the pivot and among those after it."""

    def medians(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) for batch in frames if len(batch)]
        keys = np.concatenate(held) if held else np.zeros((0, len(KEY_PARTS)), np.int64)
        keys = keys[np.lexsort(keys.T[::-1])]
        at = len(keys) if pivot is None else 0
        if pivot is not None:
            order = np.zeros(len(keys), np.int64)  # sign of the comparison with the pivot
            for column, value in zip(keys.T, pivot, strict=True):
                order = np.where(order == 0, np.sign(column - value), order)
            at = int((order < 0).sum())
            after = keys[at + int((order == 0).sum()) :]
        else:
            after = keys[:0]
        found = [(better, len(side), *side[(len(side) - 1) // 2].tolist()) for better, side in ((True, keys[:at]), (False, after)) if len(side)]
        yield pa.RecordBatch.from_pylist([dict(zip(("better", "size", *KEY_PARTS), f, strict=True)) for f in found], schema=out)

    out = pa.schema([("better", pa.bool_()), ("size", pa.int64()), *((name, pa.int64()) for name in KEY_PARTS)])
    return rows.select("key.*").mapInArrow(medians, "better boolean, size long, " + ", ".join(f"{k} long" for k in KEY_PARTS)).collect()


def weighted_median(medians: list[tuple[tuple[int, ...], int]]) -> tuple[int, ...]:
    """The least key that, with all before it, stands for half of the rows."""
    half, seen = sum(n for _, n in medians) / 2, 0
    for key, n in sorted(medians):
        seen += n
        if seen >= half:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, nth: int) -> tuple[int, ...]:
    """The nth least of the distinct values of the struct column ``key``; 1 <= nth <= number of rows.

    ``keys`` is read in every round and written anew when a quarter of what was last written remains.
    """
    rows, need, pivot, stored = keys, nth, None, None
    while True:
        found = side_medians(rows, pivot)
        sides = {better: [(tuple(r[k] for k in KEY_PARTS), r["size"]) for r in found if r["better"] == better] for better in (True, False)}
        before = sum(n for _, n in sides[True])
        if pivot is None:
            stored, left, side = before, before, True
        else:
            if before == need - 1:
                return pivot
            side = before >= need
            rows = rows.where(F.col("key") < literal(pivot)) if side else rows.where(F.col("key") > literal(pivot))
            need -= 0 if side else before + 1
            left = sum(n for _, n in sides[side])
        if left <= LAST:
            return sorted(tuple(r) for r in rows.select("key.*").collect())[need - 1]
        if 4 * left < stored:
            rows, stored = keep(rows), left
        pivot = weighted_median(sides[side])


def numbered(rows: DataFrame, key: str = "key", out: str = "rank") -> DataFrame:
    """``rows`` with their place (from 1) in the order of ``key``: sorted ranges, and the number of rows before each."""
    placed = rows.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = keep(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", at))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row a partition
    before = keep(sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before")))
    return placed.join(before, "_part").withColumn(out, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs``; rank is null where a row is not drawn."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weigh(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = keep(scored.withColumn("row", F.monotonically_increasing_id())).withColumn("key", draw_key())
    able = F.col("n_words") >= least_words
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    drawn = percent * scored.where(able).count() // 100
    if not drawn:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    last = literal(cutoff(scored.where(able).select("key"), drawn))
    ranked = numbered(scored.where(able & (F.col("key") <= last)))
    rest = scored.where(~able | (F.col("key") > last)).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*columns, "rank").unionByName(rest.select(*columns, "rank"))


def resample_sql() -> str:
    """The same over tables ``documents`` (unique ids) and ``benchmark``, with the checksum byte by byte."""
    table = "[" + ", ".join(str(int(x)) for x in _STEP) + "]"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    runs = f"list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))"
    return f"""
WITH steps AS MATERIALIZED (SELECT {table}::BIGINT[] AS steps),
dw AS MATERIALIZED (SELECT doc_id, {words} AS w FROM documents), bw AS (SELECT {words} AS w FROM benchmark),
df AS MATERIALIZED (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest({runs}) AS f FROM dw) GROUP BY doc_id, f),
bf AS MATERIALIZED (SELECT f, count(*) AS n FROM (SELECT unnest({runs}) AS f FROM bw) GROUP BY f),
buckets AS MATERIALIZED (SELECT f, {crc} % {BUCKETS} AS bucket FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)), steps),
s AS (SELECT bucket, sum(n) AS s FROM df JOIN buckets USING (f) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS t FROM bf JOIN buckets USING (f) GROUP BY bucket),
sums AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS s_all, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS t_all),
gains AS MATERIALIZED (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (s_all + {BUCKETS})) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + {BUCKETS}))))::BIGINT AS gain FROM (s FULL JOIN t USING (bucket)), sums),
weights AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM df JOIN buckets USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM dw LEFT JOIN weights USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= {LEAST_WORDS}) AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= {PERCENT} * able // 100 THEN place END AS rank FROM placed
"""
