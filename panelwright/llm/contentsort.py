"""Exact duplicates by a sort of whole normalised texts, in DataFrame functions only.

Texts are equal when nothing but white space (``[\\x20\\x09-\\x0D]``) tells them apart.  Rows are range-partitioned by sampled
splitters and sorted within their range, which puts equal texts next to each other; a row begins a group when its whole text
differs from its neighbour's.  The order is by the first ``HEAD`` characters, a hash of the whole text, the whole text and
the row's number in its table.  Splitters hold the first two and the row number: they stay short, texts with a common beginning
are told apart, and copies of one text, however many, are dealt over as many ranges as their bytes need.  Groups that reach
an end of their range are merged by their whole texts, at most two rows a range.

The sample is weighted by bytes, a row counting ``ROW_BYTES`` at least, and holds about ``SAMPLES`` rows a range; there are
``RANGES`` ranges at most, so the driver never sees more than a bounded number of short keys.

Of equal texts the row with the most code points in its original text stays, then the one with the smallest doc_id (null
last), then the first in the table.  Null text counts as empty; empty texts are equal to each other and to texts of white space.
Rows that repeat are copies like any others; an empty table gives no rows; columns of any name can be carried along.  A text of
any length is one value of one row and is compared whole.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.storage import keep

WHITE = r"[\x20\x09-\x0D]+"
HEAD = 32
RANGE_BYTES, ROW_BYTES = 4 << 20, 512
RANGES, SAMPLES = 1 << 16, 16
KEY = "struct<head:string,hash:bigint,row:bigint>"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, "")


def head_of(norm: Column) -> Column:
    return F.substring(norm, 1, HEAD)


def splitters(rows: DataFrame) -> list[tuple[str, int, int]]:
    """Ascending keys at equal steps of the sampled bytes; each begins a range, the first range has none."""
    size = F.greatest(F.octet_length("_text"), F.lit(ROW_BYTES)).cast("long")
    n, total = rows.agg(F.count(F.lit(1)), F.sum(size)).first()
    ranges = min(RANGES, math.ceil((total or 0) / RANGE_BYTES))
    if ranges < 2:
        return []
    part = rows.sample(min(1.0, 2 * SAMPLES * ranges / n), seed=17) if n > SAMPLES * ranges else rows
    norm = normalised(F.col("_text"))
    sample = sorted((r.head, r.hash, r.row, r.size) for r in part.select(head_of(norm).alias("head"), F.xxhash64(norm).alias("hash"), F.col("_row").alias("row"), size.alias("size")).collect())
    step, seen, out = sum(s[3] for s in sample) / ranges, 0.0, []
    for head, value, row, s in sample:
        if seen >= step * (len(out) + 1):
            out.append((head, value, row))
        seen += s
    return out


def range_of(key: Column, bounds: list[tuple[str, int, int]]) -> Column:
    """Number of bounds that are not above the key, found in two levels of about sqrt(len(bounds)) comparisons."""
    if not bounds:
        return F.lit(0)
    width = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    shown = lambda bound: dict(zip(("head", "hash", "row"), bound, strict=True))
    coarse = F.from_json(F.lit(json.dumps([shown(g[0]) for g in groups])), f"array<{KEY}>")
    fine = F.from_json(F.lit(json.dumps([[shown(b) for b in g] for g in groups])), f"array<array<{KEY}>>")
    below = lambda held: F.size(F.filter(held, lambda bound: bound <= key))
    # the keyless first range is group 0
    group = below(coarse)
    return F.when(group == 0, 0).otherwise((group - 1) * width + below(F.element_at(fine, F.greatest(group, F.lit(1)))))


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", carried: list[str] | None = None) -> DataFrame:
    """keep_id, group_size, kept and text_sha256 of every row, with its key as doc_id or, if asked for, the columns ``carried`` in a struct ``row``."""
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in carried]) if carried is not None else F.lit(None).cast("boolean")
    rows = docs.select(
        F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
        F.monotonically_increasing_id().alias("_row"), row.alias("_carried"),
    )
    bounds = splitters(rows.select("_text", "_row"))
    rows = rows.select("_id", "_row", "_carried", F.char_length("_text").alias("_chars"), normalised(F.col("_text")).alias("_norm"))
    rows = rows.withColumn("_hash", F.xxhash64("_norm"))
    rows = rows.withColumn("_range", range_of(F.struct(head_of(F.col("_norm")).alias("head"), F.col("_hash").alias("hash"), F.col("_row").alias("row")), bounds))
    dealt = rows.repartition("_range").withColumn("_head", head_of(F.col("_norm")))

    place = Window.partitionBy("_range").orderBy("_head", "_hash", "_norm", "_row")
    beside = dealt.select(
        "*", F.row_number().over(place).alias("_nth"), F.lag("_norm").over(place).alias("_before"), F.lead("_row").over(place).isNull().alias("_last")
    )
    first = ~F.col("_norm").eqNullSafe(F.col("_before"))
    # from here on a text is carried only by the rows at the two ends of a range
    light = beside.select(
        "_range", "_nth", "_last", first.cast("int").alias("_first"), "_id", "_row", "_carried", F.sha2("_norm", 256).alias("_sha"),
        F.when((F.col("_nth") == 1) | F.col("_last"), F.col("_norm")).alias("_edge"),
        F.struct((-F.col("_chars")).alias("less"), F.col("_id").isNull().alias("unnamed"), F.col("_id").alias("id"), F.col("_row").alias("row")).alias("_rank"),
    )
    run = F.sum("_first").over(Window.partitionBy("_range").orderBy("_nth").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    light = light.withColumn("_run", run)
    whole = Window.partitionBy("_range", "_run")
    held = keep(light.select("*", F.count(F.lit(1)).over(whole).alias("_n"), F.min("_rank").over(whole).alias("_best")).drop("_rank", "_first"))

    edges = held.where((F.col("_nth") == 1) | (F.col("_last") & (F.col("_run") > 1))).select("_range", "_run", "_edge", "_n", "_best")
    joint = edges.groupBy("_edge").agg(F.count(F.lit(1)).alias("_pieces"), F.sum("_n").alias("_all_n"), F.min("_best").alias("_all_best")).where("_pieces > 1")
    joint = keep(edges.select("_range", "_run", "_edge").join(joint, "_edge").select("_range", "_run", "_all_n", "_all_best"))
    out = held.drop("_edge").join(joint, ["_range", "_run"], "left")
    best = F.coalesce("_all_best", "_best")
    named = [F.col("_id").alias("doc_id")] if carried is None else [F.col("_carried").alias("row")]
    return out.select(*named, best["id"].alias("keep_id"), F.coalesce("_all_n", "_n").alias("group_size"), (best["row"] == F.col("_row")).alias("kept"), F.col("_sha").alias("text_sha256"))


def kept_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each distinct normalised text, with all its columns."""
    return grouped(docs, key, text, docs.columns).where("kept").select("row.*")


#: The same over a table ``documents`` of unique ids.
COPIES_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
