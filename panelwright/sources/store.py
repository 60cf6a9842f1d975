"""Panels kept as bucketed tables, so that later jobs read them without a shuffle.

Rows are bucketed by ``(series_id, blk)``: a block always lies whole in one bucket, a hot series spreads over as many
buckets as it has blocks, and every window or aggregate keyed by ``(series_id, blk)`` runs on the scan as it is.
With a ``reach`` each block also holds the last ``reach`` rows of the block before, so lags up to
that reach need no shuffle either.  The block length and the reach are properties of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.plans.blocks import BLOCK_ROWS_SETTING, block_rows, drop_halo, with_halo

BUCKET = ("series_id", "blk")
ROWS, REACH = "panelwright.blockRows", "panelwright.reach"


def write_panel(panel: DataFrame, table: str, reach: int = 0, buckets: int | None = None, path: str | None = None) -> None:
    """Keep a panel (``series_id``, ``t`` and any other columns) as the bucketed table ``table``.

    Without ``path`` the table lies in the warehouse.  A table of that name must not exist.  Rows are shuffled once, into one file
    a bucket; choose ``buckets`` (default: the shuffle partitions) so that a bucket fits a task.  An empty panel gives an empty table.
    """
    spark = panel.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_halo(panel, reach)
    # the same hash as the buckets: every task writes one bucket
    writer = rows.repartition(count, *BUCKET).write.bucketBy(count, *BUCKET).sortBy(*BUCKET, "t").format("parquet")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{ROWS}' = '{block_rows(panel)}', '{REACH}' = '{reach}')")


def _properties(spark: SparkSession, table: str) -> dict[str, int]:
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    if ROWS not in found or REACH not in found:
        raise ValueError(f"{table} was not written by write_panel")
    return {ROWS: int(found[ROWS]), REACH: int(found[REACH])}


def read_halo(spark: SparkSession, table: str, reach: int) -> DataFrame:
    """Rows with their block number and at least ``reach`` rows of the block before, for ``lags_of_halo`` only."""
    known, rows = _properties(spark, table), spark.table(table)
    if known[ROWS] != block_rows(rows):
        raise ValueError(f"{table} has blocks of {known[ROWS]} rows: set {BLOCK_ROWS_SETTING} to that")
    if known[REACH] < reach:
        raise ValueError(f"{table} reaches back {known[REACH]} rows, {reach} are asked for")
    return rows


def read_panel(spark: SparkSession, table: str) -> DataFrame:
    """Every row of the panel once, with its block number in ``blk``; the partitioning is that of the buckets."""
    return drop_halo(read_halo(spark, table, 0))
