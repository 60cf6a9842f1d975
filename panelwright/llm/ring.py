"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points on a ring of 64-bit hashes.  A row belongs to the next point
clockwise of its key's hash.  Loads are bounded: with n rows and s shards a shard takes
floor(n / s) rows, and the first n mod s shards one more.  Rows that find their shard full
continue clockwise to the next point of a shard with room, so counts differ by at most one and
only the overflow leaves its place.

Spark counts rows per arc of the ring; the walk of the overflow runs on those counts, one
number per virtual node, whatever the number of rows.  A row's place follows from its rank in
its arc.  Ranks come from cells of about ``CELL_ROWS`` rows, so that no task orders a whole arc.

A null key is hashed with the other columns; null text has size 0 + 1 and checksum 0;
rows that repeat get a slot each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.llm.storage import keep

VIRTUAL_NODES = 128
CELL_ROWS = 50_000


def ring_points(spark: SparkSession, shards: int, nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node in clockwise order."""
    points = (
        spark.range(shards * nodes)
        .select(F.xxhash64(F.lit("virtual node"), F.expr(f"id div {nodes}"), F.expr(f"id % {nodes}")).alias("position"), F.expr(f"id div {nodes}").cast("int").alias("shard"))
        .collect()
    )
    return sorted((p.position, p.shard) for p in points)


def walk(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, rows, shard) blocks when every arc's rows continue clockwise past full shards.

    Arcs are served in ring order: first every arc fills its own shard, then what is
    left moves on, arc by arc, until it finds room.
    """
    room, blocks = list(capacity), []
    waiting: list[tuple[int, int, int]] = []
    for arc, n in enumerate(counts):
        taken = min(n, room[owners[arc]])
        if taken:
            blocks.append((arc, 0, taken, owners[arc]))
            room[owners[arc]] -= taken
        if n > taken:
            waiting.append((arc, taken, n - taken))
    for arc, first, n in waiting:
        at = arc
        while n:
            at = (at + 1) % len(owners)
            taken = min(n, room[owners[at]])
            if taken:
                blocks.append((arc, first, taken, owners[at]))
                room[owners[at]] -= taken
                first, n = first + taken, n - taken
    return blocks


def assign(rows: DataFrame, key: str, ties: list[str], shards: int, nodes: int = VIRTUAL_NODES) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: within a shard slots run from 0 without gaps.

    ``ties`` are further columns that order rows of one key and spread a frequent key.
    """
    points = ring_points(rows.sparkSession, shards, nodes)
    positions, owners = [p for p, _ in points], [s for _, s in points]

    @F.pandas_udf("int")
    def arc_of(position: pd.Series) -> pd.Series:
        return position.map(lambda p: bisect_left(positions, p) % len(positions)).astype("int32")

    spread = F.when(F.col(key).isNull(), F.xxhash64(*ties)).otherwise(F.xxhash64(key))
    placed = keep(rows.withColumn("arc", arc_of(spread)))
    counts = dict(placed.groupBy("arc").count().collect())
    total = sum(counts.values())
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    blocks = walk([counts.get(a, 0) for a in range(len(owners))], owners, capacity)
    filled, places = [0] * shards, []
    for arc, first, n, shard in sorted(blocks, key=lambda b: (b[3], b[0], b[1])):
        places.append((arc, first, first + n, shard, filled[shard] - first))
        filled[shard] += n
    # ranks in an arc: rows before the cell, and the place in the cell
    cells = max(1, max(counts.values(), default=1) // CELL_ROWS)
    placed = placed.withColumn("cell", F.pmod(F.xxhash64(key, *ties), F.lit(cells)).cast("int"))
    before = (
        placed.groupBy("arc", "cell").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("arc").orderBy("cell")) - F.col("n"))
        .select("arc", "cell", "before")
    )
    rank = F.row_number().over(Window.partitionBy("arc", "cell").orderBy(key, *ties)) - 1
    ranked = placed.withColumn("in_cell", rank).join(before, ["arc", "cell"]).withColumn("rank", F.col("before") + F.col("in_cell"))
    by_arc: dict[int, list[tuple]] = {}
    for arc, *place in places:
        by_arc.setdefault(arc, []).append(tuple(place))

    @F.pandas_udf("shard int, slot long")
    def locate(arc: pd.Series, rank: pd.Series) -> pd.DataFrame:
        found = [next((s, r + shift) for lo, hi, s, shift in by_arc[a] if lo <= r < hi) for a, r in zip(arc, rank, strict=True)]
        return pd.DataFrame(found, columns=["shard", "slot"])

    out = ranked.withColumn("place", locate("arc", "rank"))
    return out.select(*rows.columns, "place.shard", "place.slot")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document; the law is ``rows``."""
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return assign(rows, "doc_id", ["text_crc32", "size"], shards)
