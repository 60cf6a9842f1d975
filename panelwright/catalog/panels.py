"""Panels made from the driver tables, and the same panels as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.sources import panel_from_facts

# Units near a round number; a prime keeps sums of cents away from rounding ties.
SUPPLIER_UNIT = 99991.0
MILLION = 999983.0
THOUSAND = 997.0

REVENUE = "sum(l_extendedprice * (1 - l_discount))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_months(spark: SparkSession, sf_dir: str, value: Column | None = None, where: str = "true") -> DataFrame:
    """Monthly revenue of every supplier, in about 100,000; the panel that grows with the data."""
    value = F.expr(REVENUE) / SUPPLIER_UNIT if value is None else value
    return panel_from_facts(table(spark, sf_dir, "lineitem").where(where), [F.col("l_suppkey")], "l_shipdate", "month", value, fill=True)


def paid_months(spark: SparkSession, sf_dir: str, where: str = "true", step: str = "month") -> DataFrame:
    """Price of every supplier's items by the month (or quarter) 45 days after shipping, in about 100,000: a regressor on a later axis."""
    items = table(spark, sf_dir, "lineitem").where(where).select("l_suppkey", "l_extendedprice", F.date_add("l_shipdate", 45).alias("paid"))
    return panel_from_facts(items, [F.col("l_suppkey")], "paid", step, F.sum("l_extendedprice") / SUPPLIER_UNIT, fill=True)


def flag_months(spark: SparkSession, sf_dir: str, value: Column | None = None) -> DataFrame:
    """Monthly revenue by return flag and line status, in about millions."""
    value = F.expr(REVENUE) / MILLION if value is None else value
    return panel_from_facts(table(spark, sf_dir, "lineitem"), [F.col("l_returnflag"), F.col("l_linestatus")], "l_shipdate", "month", value)


def priority_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order value by priority, in about millions; the longest series."""
    return panel_from_facts(table(spark, sf_dir, "orders"), [F.col("o_orderpriority")], "o_orderdate", "day", F.sum("o_totalprice") / MILLION, fill=True)


def nation_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order value by nation, in about millions."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    facts = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return panel_from_facts(facts, [F.col("c_nationkey")], "o_orderdate", "month", F.sum("o_totalprice") / MILLION, fill=True)


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily event value by type, in about thousands."""
    return panel_from_facts(table(spark, sf_dir, "events"), [F.col("event_type")], "ts", "day", F.sum("value") / THOUSAND)


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly event counts by type."""
    count = F.count(F.lit(1)).cast("double")
    return panel_from_facts(table(spark, sf_dir, "events"), [F.col("event_type")], "ts", "hour", count, fill=True)


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily event value by user; days without events are missing."""
    return panel_from_facts(table(spark, sf_dir, "events"), [F.col("user_id")], "ts", "day", F.sum("value"))


# --- the same panels as SQL: common table expressions that end in p(series_id, ts, t, n, y) ----------

NUMBERED = "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS t, count(*) OVER (PARTITION BY series_id) AS n FROM {}"


def _cte(source: str, name: str = "p", fill: str | None = None, kind: str = "DATE") -> str:
    raw = f"{name}_raw AS ({source})"
    if fill is None:
        return f"{raw}, {name} AS ({NUMBERED.format(name + '_raw')})"
    axis = (
        f"{name}_axis AS (SELECT series_id, CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 {fill})) AS {kind}) AS ts "
        f"FROM {name}_raw GROUP BY series_id)"
    )
    full = f"{name}_full AS (SELECT a.series_id, a.ts, coalesce(r.y, 0.0::DOUBLE) AS y FROM {name}_axis a LEFT JOIN {name}_raw r USING (series_id, ts))"
    return f"{raw}, {axis}, {full}, {name} AS ({NUMBERED.format(name + '_full')})"


SQL_REVENUE = REVENUE


def supplier_months_sql(name: str = "p", value: str = f"{SQL_REVENUE} / {SUPPLIER_UNIT}::DOUBLE", where: str = "true") -> str:
    return _cte(
        f"SELECT CAST(l_suppkey AS VARCHAR) AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, {value} AS y "
        f"FROM lineitem WHERE {where} GROUP BY 1, 2",
        name,
        "MONTH",
    )


def paid_months_sql(name: str = "p", quarterly: str = "false") -> str:
    """``quarterly`` says which suppliers have a quarterly axis."""
    paid = "CAST(l_shipdate AS DATE) + 45"
    return f"""{name}_raw AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id, CAST(CASE WHEN {quarterly} THEN date_trunc('quarter', {paid}) ELSE date_trunc('month', {paid}) END AS DATE) AS ts,
   CASE WHEN {quarterly} THEN 3 ELSE 1 END AS months, sum(l_extendedprice) / {SUPPLIER_UNIT}::DOUBLE AS y FROM lineitem GROUP BY 1, 2, 3),
 {name}_axis AS (SELECT series_id, CAST(lo + to_months(CAST(months * i AS INTEGER)) AS DATE) AS ts FROM (SELECT series_id, months, min(ts) AS lo, unnest(range(0, datediff('month', min(ts), max(ts)) // months + 1)) AS i FROM {name}_raw GROUP BY 1, 2)),
 {name}_full AS (SELECT a.series_id, a.ts, coalesce(r.y, 0.0::DOUBLE) AS y FROM {name}_axis a LEFT JOIN {name}_raw r USING (series_id, ts)), {name} AS ({NUMBERED.format(name + "_full")})"""


def flag_months_sql(name: str = "p", value: str = f"{SQL_REVENUE} / {MILLION}::DOUBLE") -> str:
    return _cte(
        f"SELECT l_returnflag || '|' || l_linestatus AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, {value} AS y FROM lineitem GROUP BY 1, 2",
        name,
    )


def priority_days_sql(name: str = "p") -> str:
    return _cte(
        f"SELECT o_orderpriority AS series_id, CAST(date_trunc('day', o_orderdate) AS DATE) AS ts, sum(o_totalprice) / {MILLION}::DOUBLE AS y FROM orders GROUP BY 1, 2",
        name,
        "DAY",
    )


def nation_months_sql(name: str = "p") -> str:
    return _cte(
        f"SELECT CAST(c_nationkey AS VARCHAR) AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ts, sum(o_totalprice) / {MILLION}::DOUBLE AS y "
        "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
        name,
        "MONTH",
    )


def event_days_sql(name: str = "p") -> str:
    return _cte(
        f"SELECT event_type AS series_id, CAST(date_trunc('day', ts) AS DATE) AS ts, sum(value) / {THOUSAND}::DOUBLE AS y FROM events GROUP BY 1, 2", name
    )


def event_hours_sql(name: str = "p") -> str:
    return _cte(
        "SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, CAST(count(*) AS DOUBLE) AS y FROM events GROUP BY 1, 2", name, "HOUR", "TIMESTAMP"
    )


def user_days_sql(name: str = "p") -> str:
    return _cte("SELECT CAST(user_id AS VARCHAR) AS series_id, CAST(date_trunc('day', ts) AS DATE) AS ts, sum(value) AS y FROM events GROUP BY 1, 2", name)
