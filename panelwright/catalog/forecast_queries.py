"""Forecasts, intervals, scenario paths, accuracy and outliers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.catalog import panels as P
from panelwright.catalog.diff_queries import difference_sql
from panelwright.catalog.fit_queries import AR1, ar1_spec, given, linear_fits
from panelwright.catalog.registry import query, r, rounded
from panelwright.functions import criteria as C
from panelwright.operators import estimate as E
from panelwright.operators import forecast as FC
from panelwright.operators import outliers as O
from panelwright.operators.axis import identify_granularity
from panelwright.operators.panel import lengths, split_train_test, time_range
from panelwright.plans.session import checkpoint

SUP = P.supplier_months_sql()
Z95 = C.normal_quantile(0.95)


def ar1_fits(panel: DataFrame) -> DataFrame:
    fits = linear_fits(panel, ar1_spec(panel), 1)
    return fits.withColumn("sigma2", C.residual_variance(F.col("sse"), F.col("n_resid"), F.col("k_var")))


# forecast of an AR(1) with mean on first differences, step by step
AR1_PARAMETERS = f"""{AR1}, ends AS (SELECT series_id, arg_max(y, t) AS y0, arg_max(w, t) AS w0, max(ts) AS last FROM dif GROUP BY 1),
 par AS (SELECT series_id, c, phi, y0, w0, last, sse / (m - 2) AS sigma2 FROM ar1 JOIN ends USING (series_id))"""
AR1_PATH = f"""{AR1_PARAMETERS},
 path AS (SELECT series_id, 0::BIGINT AS h, w0 AS w, y0 AS y, 0.0::DOUBLE AS v, 1.0::DOUBLE AS psi FROM par
   UNION ALL SELECT q.series_id, h + 1, c + phi * w, y + c + phi * w, v + sigma2 * psi * psi, psi * phi FROM path q JOIN par USING (series_id) WHERE h < 8)"""


@query("forecast_ar1", f"WITH RECURSIVE {AR1_PATH} SELECT series_id, CAST(h AS INTEGER) AS h, CAST(last + to_months(CAST(h AS INTEGER)) AS DATE) AS ts, {r('y')} AS mean FROM path JOIN par USING (series_id) WHERE h > 0")
def forecast_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    out = FC.forecast(ar1_fits(panel), panel, identify_granularity(panel), 8)
    return rounded(out.select("series_id", "h", "ts", "mean"), "mean")


@query("prediction_intervals", f"""WITH RECURSIVE {AR1_PATH} SELECT series_id, CAST(h AS INTEGER) AS h, {r('y')} AS mean, {r('v')} AS variance,
 {r(f'y - {Z95!r}::DOUBLE * sqrt(v)')} AS lower, {r(f'y + {Z95!r}::DOUBLE * sqrt(v)')} AS upper FROM path WHERE h > 0""")  # fmt: skip
def interval_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    out = FC.forecast(ar1_fits(panel), panel, identify_granularity(panel), 8, level=0.95)
    return rounded(out.select("series_id", "h", "mean", "variance", "lower", "upper"), "mean", "variance", "lower", "upper")


# on the original scale shock weights of ARIMA(1,1,0) are running sums of powers of phi
@query("prediction_variance_integrated", f"""WITH {AR1}, v AS (SELECT series_id, phi, sse / (m - 2) AS sigma2 FROM ar1)
 SELECT series_id, CAST(h AS INTEGER) AS h, {r('any_value(sigma2) * sum(pow((1 - pow(phi, j + 1)) / (1 - phi), 2))')} AS variance
 FROM v, range(1, 7) x(h), range(0, 6) z(j) WHERE j < h GROUP BY 1, 2""")  # fmt: skip
def integrated_variance_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    out = FC.forecast(ar1_fits(panel), panel, identify_granularity(panel), 6, level=0.95, integrated=True)
    return rounded(out.select("series_id", "h", "variance"), "variance")


SEASONAL = f"{SUP}, {difference_sql(0, 1, 12)}"


@query("forecast_seasonal_given", f"""WITH RECURSIVE {SEASONAL}, f AS (
 SELECT series_id, max(t) AS t, 0 AS h, list(w ORDER BY t DESC)[1:12] AS w, list(y ORDER BY t DESC)[1:12] AS y FROM dif GROUP BY 1
 UNION ALL SELECT series_id, t, h + 1, list_prepend(0.02::DOUBLE + 0.4::DOUBLE * w[1] - 0.2::DOUBLE * w[12], w[1:11]),
   list_prepend(0.02::DOUBLE + 0.4::DOUBLE * w[1] - 0.2::DOUBLE * w[12] + y[12], y[1:11]) FROM f WHERE h < 15)
 SELECT series_id, h, {r('y[1]')} AS mean FROM f WHERE h > 0""")  # fmt: skip
def seasonal_forecast_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    fits = given(E.specify(panel, p=1, sp=1, sd=1, s=12), c=0.02, ar=[0.4], sar=[-0.2]).withColumn("recent", F.lit(None).cast("array<double>"))
    return rounded(FC.forecast(fits, panel, identify_granularity(panel), 15, 12).select("series_id", "h", "mean"), "mean")


@query("forecast_with_regressor", f"""WITH {SUP}, {P.supplier_months_sql('q', 'sum(l_quantity) / 100.0::DOUBLE')},
 j AS (SELECT series_id, p.y, q.y AS x FROM p JOIN q USING (series_id, ts) WHERE ts <= DATE '1999-12-01'),
 b AS (SELECT series_id, regr_intercept(y, x) AS c, regr_slope(y, x) AS beta FROM j GROUP BY 1)
 SELECT series_id, ts, {r('c + beta * y')} AS mean FROM q JOIN b USING (series_id) WHERE ts > DATE '1999-12-01' AND ts <= DATE '2000-12-01'""")  # fmt: skip
def regressor_forecast_query(spark: SparkSession, sf: str) -> DataFrame:
    exog = P.supplier_months(spark, sf, F.sum("l_quantity") / 100.0).select("series_id", "ts", F.col("y").alias("x1"))
    panel = time_range(P.supplier_months(spark, sf), end=dt.date(1999, 12, 1))
    fits = E.fit_models(panel, E.specify(panel), 1, exog, ["x1"], pairs=[(0, 0)])
    axis = identify_granularity(panel)
    xb = FC.exog_contributions(fits, axis, exog, ["x1"], 12)
    return rounded(FC.forecast(fits, panel, axis, 12, xb=xb).select("series_id", "ts", "mean"), "mean")


@query("forecast_outlier_regressor", f"""WITH {SUP}, top AS (SELECT series_id, arg_max(t, struct_pack(a := y, b := -t)) AS at, max(n) AS n, max(y) AS peak, sum(y) AS total FROM p GROUP BY 1)
 SELECT series_id, CAST(h AS INTEGER) AS h, {r('(total - peak) / (n - 1)')} AS mean FROM top, range(1, 4) x(h)""")  # fmt: skip
def outlier_forecast_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = checkpoint(P.supplier_months(spark, sf))
    peak = panel.groupBy("series_id").agg(F.max(F.struct("y", -F.col("t"))).alias("top"), F.max("ts").alias("last"))
    peak = peak.select("series_id", (-F.col("top.col2")).alias("at"))
    exog = panel.join(peak, "series_id").select("series_id", "ts", (F.col("t") == F.col("at")).cast("double").alias("outlier_peak"))
    fits = checkpoint(E.fit_models(panel, E.specify(panel), 1, exog, ["outlier_peak"], pairs=[(0, 0)]))
    axis = identify_granularity(panel)
    xb = FC.exog_contributions(fits, axis, exog, ["outlier_peak"], 3)
    return rounded(FC.forecast(fits, panel, axis, 3, xb=xb).select("series_id", "h", "mean"), "mean")


def uniform_sql(at: int) -> str:
    digest = "md5('7|' || series_id || '|' || scenario || '|' || (h + 1))"
    return f"((('0x' || substr({digest}, {at}, 8))::UBIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


SHOCK = f"sqrt(-2 * ln({uniform_sql(1)})) * cos(2 * pi() * {uniform_sql(9)})"


@query("scenario_paths", f"""WITH RECURSIVE {AR1_PARAMETERS},
 sim AS (SELECT series_id, CAST(scenario AS BIGINT) AS scenario, 0::BIGINT AS h, w0 AS w, y0 AS y FROM par, range(1, 201) x(scenario)
   UNION ALL SELECT series_id, scenario, h + 1, c + phi * w + sqrt(sigma2) * {SHOCK}, y + c + phi * w + sqrt(sigma2) * {SHOCK} FROM sim JOIN par USING (series_id) WHERE h < 6)
 SELECT series_id, CAST(scenario AS INTEGER) AS scenario, CAST(h AS INTEGER) AS h, {r('y', 5)} AS value FROM sim WHERE h > 0""")  # fmt: skip
def scenario_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = checkpoint(P.supplier_months(spark, sf))
    paths = FC.scenario_paths(ar1_fits(panel), panel, identify_granularity(panel), 6, scenarios=200, seed=7)
    return rounded(paths.select("series_id", "scenario", "h", "value"), "value", digits=5)


@query("accuracy", f"""WITH {SUP}, f AS (SELECT series_id, avg(y) AS mean FROM p WHERE t <= floor(n * 0.8::DOUBLE) GROUP BY 1)
 SELECT series_id, {r('avg(abs(y - mean))')} AS mae, {r('100 * avg(abs((y - mean) / nullif(y, 0)))')} AS mape FROM p JOIN f USING (series_id)
 WHERE t > floor(n * 0.8::DOUBLE) GROUP BY 1""")  # fmt: skip
def accuracy_query(spark: SparkSession, sf: str) -> DataFrame:
    split = split_train_test(P.supplier_months(spark, sf))
    test = split.where("NOT is_train")
    mean = split.where("is_train").groupBy("series_id").agg(F.avg("y").alias("mean"))
    return rounded(FC.accuracy(test, test.select("series_id", "ts").join(mean, "series_id")), "mae", "mape")


# --- outliers ---------------------------------------------------------------------------------------

QUARTILES = "q AS (SELECT series_id, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY 1)"
FLAGS = "x < q1 - 1.5::DOUBLE * (q3 - q1) OR x > q3 + 1.5::DOUBLE * (q3 - q1)"


@query("exact_quantiles", f"WITH {P.event_hours_sql()}, v AS (SELECT series_id, y AS x FROM p), {QUARTILES}" + f" SELECT series_id, {r('q1')} AS q1, {r('q3')} AS q3 FROM q")
def quantile_query(spark: SparkSession, sf: str) -> DataFrame:
    quartiles = O.exact_quantiles(P.event_hours(spark, sf).withColumnRenamed("y", "x"), [0.25, 0.75])
    return rounded(quartiles.groupBy("series_id").pivot("prob", [0.25, 0.75]).agg(F.first("quantile")).toDF("series_id", "q1", "q3"), "q1", "q3")


@query("iqr_outliers", f"WITH {SUP}, v AS (SELECT series_id, t, y AS x FROM p), {QUARTILES} SELECT series_id, t, {r('x')} AS x, {FLAGS} AS is_outlier FROM v JOIN q USING (series_id)")
def iqr_query(spark: SparkSession, sf: str) -> DataFrame:
    flags = O.iqr_outliers(P.supplier_months(spark, sf).withColumnRenamed("y", "x"))
    return rounded(flags.select("series_id", "t", "x", "is_outlier"), "x")


@query("outlier_dummies", f"WITH {SUP}, v AS (SELECT series_id, t, y AS x FROM p), {QUARTILES} SELECT series_id, 'outlier_' || t AS name, t + 2 AS dummy_t FROM v JOIN q USING (series_id) WHERE {FLAGS}")
def dummies_query(spark: SparkSession, sf: str) -> DataFrame:
    return O.outlier_dummies(O.iqr_outliers(P.supplier_months(spark, sf).withColumnRenamed("y", "x")), lead=2)


@query("dense_dummies", f"WITH {P.event_days_sql()} SELECT series_id, t, CAST(t = 3 AND y > 10 AS INTEGER)::DOUBLE AS outlier_3, CAST(t = 7 AND y > 10 AS INTEGER)::DOUBLE AS outlier_7 FROM p")
def dense_dummies_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.event_days(spark, sf)
    dummies = O.outlier_dummies(panel.withColumn("is_outlier", F.col("t").isin(3, 7) & (F.col("y") > 10)))
    return O.dense_dummies(dummies, lengths(panel), ["outlier_3", "outlier_7"])


@query("detect_outliers", f"""WITH {SUP}, {difference_sql(1, 0, 1)}, v0 AS (SELECT series_id, ts, t, w - avg(w) OVER (PARTITION BY series_id) AS x FROM dif),
 v AS (SELECT series_id, ts, t, CASE WHEN abs(x) < 1e-10 THEN 0 ELSE x END AS x FROM v0), {QUARTILES}
 SELECT series_id, ts, 'outlier_' || (t - 1) AS name, t AS dummy_t FROM v JOIN q USING (series_id) WHERE {FLAGS}""")  # fmt: skip
def detect_query(spark: SparkSession, sf: str) -> DataFrame:
    return O.detect_outliers(P.supplier_months(spark, sf), 1)


@query("detect_outliers_with_regressor", f"""WITH {SUP}, {P.supplier_months_sql('z', 'sum(l_quantity) / 100.0::DOUBLE')}, j AS (SELECT p.series_id, ts, p.t, p.y, z.y AS u FROM p JOIN z USING (series_id, ts)),
 b AS (SELECT series_id, regr_intercept(y, u) AS c, regr_slope(y, u) AS s FROM j GROUP BY 1),
 v AS (SELECT series_id, ts, t, y - c - s * u AS x FROM j JOIN b USING (series_id)), {QUARTILES}
 SELECT series_id, ts, 'outlier_' || t AS name, t AS dummy_t FROM v JOIN q USING (series_id) WHERE {FLAGS}""")  # fmt: skip
def detect_regressor_query(spark: SparkSession, sf: str) -> DataFrame:
    exog = P.supplier_months(spark, sf, F.sum("l_quantity") / 100.0).select("series_id", "ts", F.col("y").alias("x1"))
    return O.detect_outliers(P.supplier_months(spark, sf), exog=exog, exog_columns=["x1"])
