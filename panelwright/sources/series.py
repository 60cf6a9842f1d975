"""Series from files and tables: ``series_id, ts, t, y`` (one row per timestamp)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.plans.blocks import count_up, number_rows


def read_series(
    spark: SparkSession,
    path: str,
    ts: str = "date",
    value: str = "value",
    sep: str = ",",
    series_id: str | Column = "series",
    ts_type: str = "date",
) -> DataFrame:
    """A delimited file with a header, time in the first column and the value in the second."""
    rows = spark.read.csv(path, schema=f"`{ts}` {ts_type}, `{value}` double", header=True, sep=sep)
    key = F.lit(series_id) if isinstance(series_id, str) else series_id
    panel = rows.select(key.alias("series_id"), F.col(ts).alias("ts"), F.col(value).cast("double").alias("y"))
    return number_rows(panel)


def series_key(keys: Sequence[Column]) -> Column:
    """One string per combination of keys; of several, separators are escaped, and null differs from every text."""
    if len(keys) == 1:
        return F.coalesce(keys[0].cast("string"), F.lit("\\N"))
    escaped = [F.replace(F.replace(k.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) for k in keys]
    return F.concat_ws("|", *[F.coalesce(e, F.lit("\\N")) for e in escaped])


def from_table(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ts: str | None = None,
    order_by: str | None = None,
) -> DataFrame:
    """Any table as a panel.

    Without ``ts`` a yearly axis is made: row i of a series, in the order of
    ``order_by``, falls on 1 January of year i.
    """
    key = series_key([F.col(k) for k in keys])
    if ts is not None:
        return number_rows(df.select(key.alias("series_id"), F.col(ts).alias("ts"), F.col(value).cast("double").alias("y")))
    if order_by is None:
        raise ValueError("rows have no order of their own: name the column to order by")
    # a made-up yearly axis ends in year 9999, which bounds the rows of a series: more fail the job
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy("_order"))
    return (
        df.select(key.alias("series_id"), F.col(order_by).alias("_order"), F.col(value).cast("double").alias("y"))
        .withColumn("t", F.when(rank <= 9999, rank).otherwise(F.raise_error(F.lit("a yearly axis ends in year 9999: give dates")).cast("int")).cast("bigint"))
        .select("series_id", F.make_date(F.col("t").cast("int"), F.lit(1), F.lit(1)).alias("ts"), "y", "t")
    )


def panel_from_facts(
    facts: DataFrame,
    keys: Sequence[Column],
    ts: str,
    step: str,
    value: Column,
    fill: bool = False,
) -> DataFrame:
    """Sum fact rows into one value per series and calendar step, then number the steps.

    The sum is pre-aggregated before the shuffle, so a hot key costs one partial
    row per task and step.  ``fill`` adds the missing steps between the first and
    the last one with value 0.
    """
    kind = "timestamp_ntz" if step in ("second", "minute", "hour") else "date"
    bucket = F.date_trunc(step, F.col(ts)).cast(kind)
    panel = facts.groupBy(series_key(keys).alias("series_id"), bucket.alias("ts")).agg(
        value.alias("y")
    )
    if fill:
        panel = fill_calendar(panel, step)
    return number_rows(panel)


def fill_calendar(panel: DataFrame, step: str) -> DataFrame:
    """Add missing steps of a regular axis with value 0."""
    spans = panel.groupBy("series_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    kind = panel.schema["ts"].dataType.simpleString()
    start, inside = count_up(F.expr(f"timestampdiff({step}, lo, hi)"), "_step")
    axis = spans.select("*", start).select("*", inside).select("series_id", F.expr(f"cast(timestampadd({step}, _step, lo) AS {kind})").alias("ts"))
    return axis.join(panel, ["series_id", "ts"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
