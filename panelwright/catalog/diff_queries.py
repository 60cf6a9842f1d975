"""Differencing and its inverse."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.catalog import panels as P
from panelwright.catalog.axis_queries import PART_SPECS, part_specs
from panelwright.catalog.registry import query, r, rounded
from panelwright.functions.polynomials import diff_coefficients, diff_coefficients_column
from panelwright.operators import differencing as D
from panelwright.operators.axis import align
from panelwright.operators.unitroot import auto_difference
from panelwright.plans.session import working_folder
from panelwright.sources.store import read_panel, write_panel

SUP = P.supplier_months_sql()


def lag_sum(coefficients: list[float], value: str = "y", skip: int = 0) -> str:
    terms = [f"({c}::DOUBLE) * lag({value}, {k}) OVER w" for k, c in enumerate(coefficients) if c and k >= skip]
    return " + ".join(terms)


def difference_sql(d: int, D_: int, s: int, source: str = "p", name: str = "dif") -> str:
    """name(series_id, ts, t, n, y, w) with the first rows dropped."""
    return (
        f"{name} AS (SELECT * FROM (SELECT series_id, ts, t, n, y, {lag_sum(diff_coefficients(d, D_, s))} AS w FROM {source} "
        f"WINDOW w AS (PARTITION BY series_id ORDER BY t)) WHERE t > {d + D_ * s})"
    )


COEFFICIENTS = " UNION ALL ".join(
    f"SELECT {d} AS d, {D_} AS sd, {k} AS lag, {c}::DOUBLE AS coefficient" for d in range(3) for D_ in range(2) for k, c in enumerate(diff_coefficients(d, D_, 4))
)


@query("diff_coefficients", f"WITH {PART_SPECS}, known AS ({COEFFICIENTS}) SELECT series_id, CAST(lag AS BIGINT) AS lag, coefficient FROM specs JOIN known USING (d, sd)")
def diff_coefficients_query(spark: SparkSession, sf: str) -> DataFrame:
    specs = part_specs(spark, sf)
    rows = specs.select("series_id", F.posexplode(diff_coefficients_column(F.col("d"), F.col("sd"), 4)).alias("lag", "coefficient"))
    return rows.select("series_id", F.col("lag").cast("bigint").alias("lag"), (F.col("coefficient") + 0.0).alias("coefficient"))


def _difference(d: int, D_: int, s: int):
    return lambda spark, sf: rounded(D.difference(P.supplier_months(spark, sf), d, D_, s), "w").select("series_id", "ts", "t", "w")


for _d, _D in ((1, 0), (0, 1), (1, 1), (2, 1)):
    query(f"difference_{_d}_{_D}", f"WITH {SUP}, {difference_sql(_d, _D, 12)} SELECT series_id, ts, t, {r('w')} AS w FROM dif")(_difference(_d, _D, 12))


@query("difference_daily", f"WITH {P.priority_days_sql()}, {difference_sql(1, 1, 7)} SELECT series_id, ts, t, {r('w')} AS w FROM dif")
def difference_daily(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.difference(P.priority_days(spark, sf), 1, 1, 7), "w").select("series_id", "ts", "t", "w")


def _stored(panel: DataFrame, reach: int) -> str:
    """Keep a panel in the working folder under a new name."""
    name = f"panel_{uuid.uuid4().hex}"
    write_panel(panel, name, reach, path=f"{working_folder(panel.sparkSession).rstrip('/')}/{name}")
    return name


@query("stored_panel", f"WITH {SUP} SELECT series_id, ts, t, {r('y')} AS y FROM p")
def stored_panel(spark: SparkSession, sf: str) -> DataFrame:
    name = _stored(P.supplier_months(spark, sf), 13)
    return rounded(read_panel(spark, name), "y").select("series_id", "ts", "t", "y")


@query("stored_difference", f"WITH {P.priority_days_sql()}, {difference_sql(1, 1, 7)} SELECT series_id, ts, t, {r('w')} AS w FROM dif")
def stored_difference(spark: SparkSession, sf: str) -> DataFrame:
    name = _stored(P.priority_days(spark, sf), 8)
    return rounded(D.difference_stored(spark, name, 1, 1, 7), "w").select("series_id", "ts", "t", "w")


@query("stored_totals", f"WITH {SUP} SELECT series_id, count(*) AS n, {r('avg(y)')} AS mean, {r('stddev_samp(y)')} AS spread FROM p GROUP BY 1")
def stored_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_panel(spark, _stored(P.supplier_months(spark, sf), 0))
    return rounded(rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("spread")), "mean", "spread")


@query("integrate", f"WITH {SUP} SELECT series_id, t, {r('y', 5)} AS y FROM p")
def integrate_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    diffs = D.difference(panel, 1, 1, 12)
    return rounded(D.integrate(panel.where("t <= 13"), diffs, 1, 1, 12), "y", digits=5)


@query("undo_difference_one_step", f"WITH {SUP}, {difference_sql(1, 1, 12)}, h AS (SELECT series_id, t, 0.5::DOUBLE * w AS w_hat FROM dif), "
       f"u AS (SELECT series_id, ts, t, {lag_sum(diff_coefficients(1, 1, 12), skip=1)} AS past FROM p WINDOW w AS (PARTITION BY series_id ORDER BY t)) "
       f"SELECT series_id, ts, t, {r('w_hat - past')} AS y_hat FROM u JOIN h USING (series_id, t)")  # fmt: skip
def undo_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    fitted = D.difference(panel, 1, 1, 12).select("series_id", "t", (0.5 * F.col("w")).alias("w_hat"))
    both = panel.join(fitted, ["series_id", "t"], "left")
    return rounded(D.undo_difference_one_step(both, 1, 1, 12).where("t > 13"), "y_hat").select("series_id", "ts", "t", "y_hat")


@query("auto_difference")
def auto_difference_query(spark: SparkSession, sf: str) -> DataFrame:
    revenue = P.flag_months(spark, sf)
    quantity = P.flag_months(spark, sf, F.sum("l_quantity") / 1000.0)
    wide = align([revenue.select("series_id", "ts", F.col("y").alias("revenue")), quantity.select("series_id", "ts", F.col("y").alias("quantity"))])
    wide = wide.join(revenue.select("series_id", "ts", "t"), ["series_id", "ts"])
    differenced, orders = auto_difference(wide, ["revenue", "quantity"], 12, "seas")
    long = differenced.unpivot(["series_id", "ts", "t"], ["revenue", "quantity"], "variable", "w")
    return rounded(long.join(orders, ["series_id", "variable"]), "w")
