"""Estimation, criteria and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.catalog import panels as P
from panelwright.catalog.axis_queries import PART_SPECS, part_specs
from panelwright.catalog.diff_queries import difference_sql
from panelwright.catalog.registry import query, r, rounded
from panelwright.functions import criteria as C
from panelwright.functions.polynomials import full_polynomial, invertible, psi_weights, stationary
from panelwright.operators import estimate as E
from panelwright.operators.panel import fit_status
from panelwright.operators.penalty import lasso_path
from panelwright.operators.residuals import fitted_residuals

SUP = P.supplier_months_sql()
DIF = f"{SUP}, {difference_sql(1, 0, 1)}"

# AR(1) with mean of the first difference, in closed form
AR1 = f"""{DIF}, lagged AS (SELECT series_id, t, n, w, lag(w) OVER (PARTITION BY series_id ORDER BY t) AS w1 FROM dif),
 ar1 AS (SELECT series_id, any_value(n) AS n, regr_slope(w, w1) AS phi, regr_intercept(w, w1) AS c, count(w1) AS m,
   regr_syy(w, w1) - regr_slope(w, w1) * regr_sxy(w, w1) AS sse FROM lagged GROUP BY 1)"""


def ar1_spec(panel: DataFrame, **options) -> DataFrame:
    return E.specify(panel, p=1, d=1, **options)


def design_rows(panel: DataFrame, spec: DataFrame, p: int) -> DataFrame:
    return E.design(E.differenced(panel, spec, 1, pairs=[(1, 0)]).where("w IS NOT NULL"), p)


def linear_fits(panel: DataFrame, spec: DataFrame, p: int) -> DataFrame:
    return E.fit_linear(E.linear_moments(design_rows(panel, spec, p), p), spec, p)


@query("design", f"WITH {DIF} SELECT * FROM (SELECT series_id, t, t - 1 AS tw, {r('w')} AS w, {r('lag(w, 1) OVER g')} AS ar_1, {r('lag(w, 2) OVER g')} AS ar_2 "
       "FROM dif WINDOW g AS (PARTITION BY series_id ORDER BY t)) WHERE tw > 2")  # fmt: skip
def design_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    return rounded(design_rows(panel, E.specify(panel, p=2, d=1), 2).where("tw > 2"), "w", "ar_1", "ar_2")


AR1_OUT = f"SELECT series_id, {r('c')} AS c, {r('phi')} AS phi, {r('sse')} AS sse, m AS n_resid FROM ar1"


def ar1_view(fits: DataFrame) -> DataFrame:
    out = fits.select("series_id", "c", F.col("ar")[0].alias("phi"), "sse", F.col("n_resid").cast("bigint").alias("n_resid"))
    return rounded(out, "c", "phi", "sse")


@query("fit_linear_ar1", f"WITH {AR1} {AR1_OUT}")
def fit_linear_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    return ar1_view(linear_fits(panel, ar1_spec(panel), 1))


AR2 = f"""{DIF}, lagged AS (SELECT series_id, w, lag(w, 1) OVER g AS a, lag(w, 2) OVER g AS b FROM dif WINDOW g AS (PARTITION BY series_id ORDER BY t)),
 mom AS (SELECT series_id, var_pop(a) AS saa, var_pop(b) AS sbb, covar_pop(a, b) AS sab, covar_pop(w, a) AS swa, covar_pop(w, b) AS swb,
   avg(w) AS mw, avg(a) AS ma, avg(b) AS mb FROM lagged WHERE b IS NOT NULL GROUP BY 1),
 sol AS (SELECT *, (swa * sbb - swb * sab) / (saa * sbb - sab * sab) AS p1, (swb * saa - swa * sab) / (saa * sbb - sab * sab) AS p2 FROM mom)"""


@query("fit_linear_ar2", f"WITH {AR2} SELECT series_id, {r('mw - p1 * ma - p2 * mb')} AS c, {r('p1')} AS ar_1, {r('p2')} AS ar_2 FROM sol")
def fit_linear_ar2(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    fits = linear_fits(panel, E.specify(panel, p=2, d=1), 2)
    return rounded(fits.select("series_id", "c", F.col("ar")[0].alias("ar_1"), F.col("ar")[1].alias("ar_2")), "c", "ar_1", "ar_2")


@query("fit_models_ar1", f"WITH {AR1} {AR1_OUT}")
def fit_models_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    return ar1_view(E.fit_models(panel, ar1_spec(panel), pairs=[(1, 0)]))


@query("fit_maximum_likelihood_ar1", f"WITH {AR1} SELECT series_id, {r('phi')} AS phi, {r('sse / (n - 1)')} AS sigma2 FROM ar1")
def fit_ml_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    fits = E.fit_models(panel, ar1_spec(panel, objective="ml"), pairs=[(1, 0)])
    return rounded(fits.select("series_id", F.col("ar")[0].alias("phi"), "sigma2"), "phi", "sigma2")


@query("fit_bilevel_ar1", f"WITH {AR1} {AR1_OUT}")
def fit_bilevel_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    return ar1_view(E.fit_models(panel, ar1_spec(panel, objective="bilevel"), pairs=[(1, 0)]))


def _ma1_zoom() -> str:
    """zoom(series_id, theta, sse): least squared residuals of an MA(1) by a recursion over time for a grid of coefficients, zoomed tenfold eight times."""
    parts = ["z0 AS (SELECT DISTINCT series_id, 0.0::DOUBLE AS theta FROM dif)"]
    for i in range(8):
        reach, steps = (1.0, 40) if i == 0 else (0.05 / 10 ** (i - 1), 20)
        parts += [
            f"c{i} AS (SELECT DISTINCT series_id, greatest(least(theta + {reach!r}::DOUBLE * (j / {steps}.0::DOUBLE), 1), -1) AS theta FROM z{i}, (SELECT unnest(range(-{steps}, {steps + 1})) AS j))",
            f"r{i} AS (SELECT series_id, theta, 1 AS i, 0.0::DOUBLE AS e, 0.0::DOUBLE AS sse FROM c{i} UNION ALL "
            f"SELECT a.series_id, a.theta, a.i + 1, x.w - a.theta * a.e, a.sse + (x.w - a.theta * a.e) ** 2 FROM r{i} a JOIN x ON x.series_id = a.series_id AND x.i = a.i + 1)",
            f"z{i + 1} AS (SELECT series_id, arg_min(theta, sse) AS theta, min(sse) AS sse FROM (SELECT series_id, theta, max_by(sse, i) AS sse FROM r{i} GROUP BY 1, 2) GROUP BY 1)",
        ]
    return "x AS (SELECT series_id, w, row_number() OVER (PARTITION BY series_id ORDER BY t) AS i FROM dif), " + ", ".join(parts)


# of an MA term the whole range is searched; the residual before the first counted one is 0
@query("fit_bilevel_global_ma1", f"WITH RECURSIVE {DIF}, {_ma1_zoom()} SELECT series_id, {r('theta', 4)} AS theta, {r('sse', 4)} AS sse, true AS converged FROM z8")
def fit_bilevel_ma1_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    fits = E.fit_models(panel, E.specify(panel, d=1, q=1, mean=False, objective="bilevel_global"), pairs=[(1, 0)])
    out = rounded(fits.select("series_id", F.col("ma")[0].alias("theta"), "sse", "converged"), "theta", digits=4)
    return rounded(out, "sse", digits=4)


# without lags the fits are the mean and the median
@query("fit_location_models", f"""WITH {SUP}, c AS (SELECT series_id, avg(y) AS mean, median(y) AS mid FROM p GROUP BY 1)
 SELECT series_id, {r('var_pop(y) * count(*)', 4)} AS least_squares, {r('sum(abs(y - mid))', 4)} AS least_absolute FROM p JOIN c USING (series_id) GROUP BY 1""")  # fmt: skip
def fit_location_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    spec = E.specify(panel).drop("objective").withColumn("objective", F.explode(F.array(F.lit("mse"), F.lit("mae"))))
    fits = E.fit_models(panel, spec.withColumn("model_id", F.col("objective")).select(*E.SPEC_COLUMNS), pairs=[(0, 0)])
    of = lambda name, column: F.max(F.when(F.col("objective") == name, F.col(column)))
    out = fits.groupBy("series_id").agg(of("mse", "sse").alias("least_squares"), of("mae", "sae").alias("least_absolute"))
    return rounded(out, "least_squares", "least_absolute", digits=4)


# the least largest residual: half the range without lags; with one lag, where two residuals are equal in size
@query("fit_stable_location", f"""WITH {SUP} SELECT series_id, {r('(max(y) + min(y)) / 2')} AS c, {r('(max(y) - min(y)) / 2')} AS worst, {r('(max(y) - min(y)) / 2')} AS bound, true AS converged FROM p GROUP BY 1""")
def fit_stable_location_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    fits = E.fit_models(panel, E.specify(panel, objective="stable"), pairs=[(0, 0)])
    return rounded(fits.select("series_id", "c", "worst", "bound", "converged"), "c", "worst", "bound")


@query("fit_stable_ar1", f"""WITH {DIF}, lagged AS (SELECT series_id, t, w, lag(w) OVER (PARTITION BY series_id ORDER BY t) AS a FROM dif), l AS (SELECT * FROM lagged WHERE a IS NOT NULL),
 meet AS (SELECT DISTINCT i.series_id, least(greatest((i.w + s * j.w) / nullif(i.a + s * j.a, 0), -1), 1) AS phi FROM l i JOIN l j ON i.series_id = j.series_id AND i.t <= j.t, (VALUES (1), (-1)) x(s)),
 tried AS (SELECT m.series_id, phi, max(abs(w - phi * a)) AS worst FROM (SELECT * FROM meet WHERE phi IS NOT NULL UNION SELECT series_id, unnest([-1.0::DOUBLE, 1.0::DOUBLE]) FROM l) m JOIN l ON l.series_id = m.series_id GROUP BY 1, 2)
 SELECT series_id, {r('arg_min(phi, worst)')} AS phi, {r('min(worst)')} AS worst, {r('min(worst)')} AS bound FROM tried GROUP BY 1""")  # fmt: skip
def fit_stable_ar1_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    fits = E.fit_models(panel, ar1_spec(panel, mean=False, objective="stable"), pairs=[(1, 0)])
    return rounded(fits.select("series_id", F.col("ar")[0].alias("phi"), "worst", "bound"), "phi", "worst", "bound")


CROSS = f"{DIF}, lagged AS (SELECT series_id, w, lag(w) OVER (PARTITION BY series_id ORDER BY t) AS w1 FROM dif), m AS (SELECT series_id, sum(w * w1) AS xy, sum(w1 * w1) AS xx FROM lagged WHERE w1 IS NOT NULL GROUP BY 1)"


def _penalised(lam: float, alpha: float):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        panel = P.supplier_months(spark, sf)
        spec = ar1_spec(panel, mean=False, objective="elastic_net", lam=lam, alpha=alpha)
        return rounded(linear_fits(panel, spec, 1).select("series_id", F.col("ar")[0].alias("phi")), "phi")

    return run


query("fit_ridge_ar1", f"WITH {CROSS} SELECT series_id, {r('xy / (xx + 2.0::DOUBLE)')} AS phi FROM m")(_penalised(2.0, 0.0))
query("fit_lasso_ar1", f"WITH {CROSS} SELECT series_id, {r('sign(xy) * greatest(abs(xy) - 15.0::DOUBLE, 0) / xx')} AS phi FROM m")(_penalised(30.0, 1.0))
query("fit_elastic_net_ar1", f"WITH {CROSS} SELECT series_id, {r('sign(xy) * greatest(abs(xy) - 1.25::DOUBLE, 0) / (xx + 2.5::DOUBLE)')} AS phi FROM m")(
    _penalised(5.0, 0.5)
)


def _objective(name: str, **options):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        panel = P.flag_months(spark, sf)
        spec = E.specify(panel, p=1, d=0, q=1, sp=0, sd=1, sq=1, s=12, objective=name, **options)
        fits = E.fit_models(panel, spec, 12, pairs=[(0, 1)])
        return rounded(fits.select("series_id", "objective", "lambda", "c", "ar", "ma", "sma", "sse", "sae", "worst", "sigma2", "aicc"), "sse", "sae", digits=4)

    return run


for _name, _options in (("mse", {}), ("ml", {}), ("mae", {}), ("bilevel", {}), ("stable", {})):
    query(f"fit_seasonal_arma_{_name}")(_objective(_name, **_options))
query("fit_seasonal_arma_ridge_path")(_objective("elastic_net", alpha=0.0))
query("fit_seasonal_arma_lasso")(_objective("elastic_net", alpha=1.0, lam=0.05))


@query("lambda_path", f"""WITH {SUP}, cent AS (SELECT series_id, t, n, y - avg(y) OVER (PARTITION BY series_id) AS v FROM p),
 prods AS (SELECT series_id, any_value(n) AS n, {', '.join(f'abs(sum(v * v{i})) AS x{i}' for i in range(1, 5))} FROM
   (SELECT *, {', '.join(f'lag(v, {i}) OVER g AS v{i}' for i in range(1, 5))} FROM cent WINDOW g AS (PARTITION BY series_id ORDER BY t)) WHERE t > 4 GROUP BY 1)
 SELECT series_id, CAST(step AS INTEGER) AS step, {r('exp(ln(greatest(x1, x2, x3, x4) / n) + ln(1e-4) * step / 9.0::DOUBLE)', 8)} AS "lambda" FROM prods, range(0, 10) x(step)""")  # fmt: skip
def lambda_path_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.lambda_path_panel(P.supplier_months(spark, sf), 4), "lambda", digits=8)


PENALTY = f"""lagged AS (SELECT series_id, w, lag(w) OVER (PARTITION BY series_id ORDER BY t) AS a, count(w) OVER (PARTITION BY series_id) AS n_w FROM dif),
 m AS (SELECT series_id, any_value(n_w) AS n_w, count(*) AS n, sum(a * a) AS xx, sum(w * a) AS xy, sum(w * w) AS yy FROM lagged WHERE a IS NOT NULL GROUP BY 1),
 cent AS (SELECT series_id, t, n, y - avg(y) OVER (PARTITION BY series_id) AS v FROM p),
 tops AS (SELECT series_id, greatest(abs(sum(v * v1)), abs(sum(v * v2))) / any_value(n) AS top FROM
   (SELECT *, lag(v, 1) OVER g AS v1, lag(v, 2) OVER g AS v2 FROM cent WINDOW g AS (PARTITION BY series_id ORDER BY t)) WHERE t > 2 GROUP BY 1),
 path AS (SELECT series_id, step, exp(ln(top) + ln(1e-4) * step / 9.0::DOUBLE) AS l FROM tops, range(0, 10) x(step)),
 tried AS (SELECT *, least(greatest(sign(xy) * greatest(abs(xy) - l / 2, 0) / xx, -1), 1) AS phi FROM m JOIN path USING (series_id)),
 scored AS (SELECT *, yy - 2 * phi * xy + phi * phi * xx AS sse, n_w * ln((yy - 2 * phi * xy + phi * phi * xx) / (n_w - 1)) + ln(n_w) * n AS bic FROM tried)"""


# both regressors zero down to lambda_1, one of them down to lambda_2, least squares at 0
@query("lasso_path_ar2", f"""WITH {DIF}, lagged AS (SELECT series_id, w, lag(w, 1) OVER g AS a, lag(w, 2) OVER g AS b FROM dif WINDOW g AS (PARTITION BY series_id ORDER BY t)),
 m AS (SELECT series_id, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(w * a) AS wa, sum(w * b) AS wb FROM lagged WHERE b IS NOT NULL GROUP BY 1),
 o AS (SELECT *, abs(wa) >= abs(wb) AS front, CASE WHEN abs(wa) >= abs(wb) THEN wa ELSE wb END AS r, CASE WHEN abs(wa) >= abs(wb) THEN wb ELSE wa END AS o,
   CASE WHEN abs(wa) >= abs(wb) THEN aa ELSE bb END AS g FROM m),
 j AS (SELECT *, greatest(2 * (o - ab / g * r) / (1 - ab / g * sign(r)), 2 * (o - ab / g * r) / (-1 - ab / g * sign(r))) AS l2 FROM o),
 s AS (SELECT series_id, 0 AS step, 2 * abs(r) AS l, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, front FROM j
   UNION ALL SELECT series_id, 1, l2, (r - l2 * sign(r) / 2) / g, 0, front FROM j
   UNION ALL SELECT series_id, 2, 0, CASE WHEN front THEN wa * bb - wb * ab ELSE wb * aa - wa * ab END / (aa * bb - ab * ab),
     CASE WHEN front THEN wb * aa - wa * ab ELSE wa * bb - wb * ab END / (aa * bb - ab * ab), front FROM j)
 SELECT series_id, step, {r('l')} AS "lambda", {r('CASE WHEN front THEN x ELSE y END')} AS phi_1, {r('CASE WHEN front THEN y ELSE x END')} AS phi_2 FROM s""")  # fmt: skip
def lasso_path_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    spec = E.specify(panel, p=2, d=1, mean=False, objective="elastic_net", alpha=1.0)
    path = lasso_path(E.linear_moments(design_rows(panel, spec, 2), 2), spec, 2)
    return rounded(path.select("series_id", "step", "lambda", F.col("ar")[0].alias("phi_1"), F.col("ar")[1].alias("phi_2")), "lambda", "phi_1", "phi_2")


# the penalty a path settles on, with the closed form of one regressor
@query("select_penalty_ar1", f"""WITH {DIF}, {PENALTY}
 SELECT series_id, {r('arg_min(l, (bic, step))', 8)} AS "lambda", {r('arg_min(phi, (bic, step))')} AS phi, {r('arg_min(sse, (bic, step))')} AS sse FROM scored GROUP BY 1""")  # fmt: skip
def select_penalty_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    fits = E.fit_models(panel, ar1_spec(panel, mean=False, objective="elastic_net", alpha=1.0), pairs=[(1, 0)])
    return rounded(rounded(fits.select("series_id", "lambda", F.col("ar")[0].alias("phi"), "sse"), "lambda", digits=8), "phi", "sse")


@query("fit_given_coefficients", f"WITH {DIF}, lagged AS (SELECT series_id, w, lag(w) OVER (PARTITION BY series_id ORDER BY t) AS w1 FROM dif) "
       f"SELECT series_id, {r('avg(w - 0.5::DOUBLE * w1)')} AS c, 0.5::DOUBLE AS phi, {r('var_pop(w - 0.5::DOUBLE * w1) * count(*)')} AS sse "
       "FROM lagged WHERE w1 IS NOT NULL GROUP BY 1")  # fmt: skip
def fit_given_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    spec = given(ar1_spec(panel), ar=[0.5])
    fits = E.fit_models(panel, spec, given=True, pairs=[(1, 0)])
    return rounded(fits.select("series_id", "c", F.col("ar")[0].alias("phi"), "sse"), "c", "phi", "sse")


def given(spec: DataFrame, c: float | None = None, trend: float | None = None, **vectors) -> DataFrame:
    """Add given coefficients to every specification row; absent ones are estimated."""
    columns = {"c": F.lit(c).cast("double"), "trend": F.lit(trend).cast("double")}
    for name in ("ar", "ma", "sar", "sma", "beta"):
        values = vectors.get(name)
        array = F.lit(None) if values is None else F.array(*[F.lit(float(v)) for v in values])
        columns[name] = array.cast("array<double>")
    return spec.withColumns(columns)


ARMA_RESIDUALS = f"""WITH RECURSIVE {DIF}, rec AS (
 SELECT series_id, 1::BIGINT AS tw, 0.0::DOUBLE AS e, (SELECT w FROM dif d WHERE d.series_id = s.series_id AND d.t = 2) AS w FROM (SELECT DISTINCT series_id FROM dif) s
 UNION ALL SELECT d.series_id, r.tw + 1, d.w - 0.01::DOUBLE - 0.3::DOUBLE * r.w + 0.6::DOUBLE * r.e, d.w
 FROM rec r JOIN dif d ON d.series_id = r.series_id AND d.t = r.tw + 2)
 SELECT series_id, rec.tw + 1 AS t, {r('y')} AS y, {r('y - e')} AS y_hat, {r('e')} AS resid FROM rec JOIN p USING (series_id) WHERE rec.tw > 1 AND p.t = rec.tw + 1"""


@query("fitted_residuals_arma", ARMA_RESIDUALS)
def residuals_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    fits = given(E.specify(panel, p=1, d=1, q=1), c=0.01, ar=[0.3], ma=[-0.6])
    return rounded(fitted_residuals(panel, fits, max_p=1, pairs=[(1, 0)]).select("series_id", "t", "y", "y_hat", "resid"), "y", "y_hat", "resid")


@query("fitted_residuals_ar", f"WITH {DIF}, lagged AS (SELECT series_id, t, y, w, lag(w) OVER (PARTITION BY series_id ORDER BY t) AS w1 FROM dif) "
       f"SELECT series_id, t, {r('y')} AS y, {r('y - (w - 0.01::DOUBLE - 0.3::DOUBLE * w1)')} AS y_hat, {r('w - 0.01::DOUBLE - 0.3::DOUBLE * w1')} AS resid FROM lagged WHERE w1 IS NOT NULL")  # fmt: skip
def residuals_ar_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    fits = given(E.specify(panel, p=1, d=1), c=0.01, ar=[0.3])
    out = fitted_residuals(panel, fits, max_p=1, ma=False, pairs=[(1, 0)])
    return rounded(out.select("series_id", "t", "y", "y_hat", "resid"), "y", "y_hat", "resid")


@query("residual_variance", f"WITH {AR1} SELECT series_id, {r('sse / (m - 3 + 1)')} AS sigma2 FROM ar1")
def variance_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    fits = linear_fits(panel, ar1_spec(panel), 1)
    return rounded(fits.select("series_id", C.residual_variance(F.col("sse"), F.col("n_resid"), F.col("k_var")).alias("sigma2")), "sigma2")


@query("param_count", f"WITH {PART_SPECS} SELECT series_id, CAST(p + q + sp + sq + CAST(mean AS INTEGER) + CAST(drift AS INTEGER) + 1 AS INTEGER) AS k FROM specs")
def param_count_query(spark: SparkSession, sf: str) -> DataFrame:
    return part_specs(spark, sf).select("series_id", E.param_count().alias("k"))


@query("fit_status", f"WITH {AR1} SELECT series_id, CASE WHEN phi > -0.5::DOUBLE THEN 'fitted' ELSE 'not fitted' END AS status FROM ar1")
def fit_status_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    spec = ar1_spec(panel)
    fits = linear_fits(panel, spec, 1)
    coef = fits.where(F.col("ar")[0] > -0.5).select(*E.MODEL, *E.GIVEN_COLUMNS)
    return fit_status(spec, coef, fits).select("series_id", "status")


@query("fit_with_differenced_regressor")
def exog_difference_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.flag_months(spark, sf)
    exog = P.flag_months(spark, sf, F.sum("l_quantity") / 1000.0).select("series_id", "ts", F.col("y").alias("x1"))
    spec = E.specify(panel, p=1, d=1)
    fits = E.fit_models(panel, spec, 1, exog, ["x1"], auto_exog_difference=True, pairs=[(1, 0)])
    return fits.select("series_id", "c", "ar", "beta", "sse", "k", "k_var")


@query("fit_with_regressor", f"""WITH {SUP}, {P.supplier_months_sql('q', 'sum(l_quantity) / 100.0::DOUBLE')}, j AS (SELECT series_id, p.y, q.y AS x FROM p JOIN q USING (series_id, ts))
 SELECT series_id, {r('regr_intercept(y, x)')} AS c, {r('regr_slope(y, x)')} AS beta FROM j GROUP BY 1""")  # fmt: skip
def exog_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    exog = P.supplier_months(spark, sf, F.sum("l_quantity") / 100.0).select("series_id", "ts", F.col("y").alias("x1"))
    fits = E.fit_models(panel, E.specify(panel), 1, exog, ["x1"], pairs=[(0, 0)])
    return rounded(fits.select("series_id", "c", F.col("beta")[0].alias("beta")), "c", "beta")


# --- criteria ---------------------------------------------------------------------------------------

NUMBERS = "(o_orderkey % 7 + 1)"
LOGLIK = "(o_totalprice / 9973.0::DOUBLE - 20)"


@query("information_criteria", f"""SELECT o_orderkey, {r(f'2.0::DOUBLE * {NUMBERS} - 2.0::DOUBLE * {LOGLIK}')} AS aic,
 {r(f'2.0::DOUBLE * {NUMBERS} - 2.0::DOUBLE * {LOGLIK} + (2.0::DOUBLE * {NUMBERS} * {NUMBERS} + 2 * {NUMBERS}) / (20 - {NUMBERS} - 1)')} AS aicc,
 {r(f'{NUMBERS} * ln(20.0::DOUBLE) - 2.0::DOUBLE * {LOGLIK}')} AS bic FROM orders""")  # fmt: skip
def criteria_query(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("o_orderkey") % 7 + 1).cast("double")
    ll = F.col("o_totalprice") / 9973.0 - 20
    n = F.lit(20)
    out = P.table(spark, sf, "orders").select("o_orderkey", C.aic(k, ll).alias("aic"), C.aicc(n, k, ll).alias("aicc"), C.bic(n, k, ll).alias("bic"))
    return rounded(out, "aic", "aicc", "bic")


@query("model_criteria", f"""WITH {AR1}, v AS (SELECT series_id, n - 1 AS nt, m, sse, 3 AS k, sse / (m - 2) AS s2 FROM ar1)
 SELECT series_id, {r('2 * k + nt * ln(s2)')} AS aic, {r('2 * k + nt * ln(s2) + 24.0::DOUBLE / (nt - k - 1)')} AS aicc,
 {r('2 * k + nt * ln(s2) + k * (ln(nt) - 2)')} AS bic, {r('-0.5::DOUBLE * (m * ln(2 * pi()) + m * ln(s2) + sse / s2)')} AS loglik FROM v""")  # fmt: skip
def model_criteria_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    fits = linear_fits(panel, ar1_spec(panel), 1).withColumn("n_t", F.col("n_w"))
    scored = E.with_criteria(fits.withColumn("lambda", F.lit(None).cast("double")), 1)
    return rounded(scored.select("series_id", "aic", "aicc", "bic", "loglik"), "aic", "aicc", "bic", "loglik")


@query("ic_offset", f"""WITH {DIF}, v AS (SELECT series_id, any_value(n) AS n, count(*) AS m, var_pop(w) * count(*) AS sse FROM dif GROUP BY 1),
 u AS (SELECT *, sse / (m - 1) AS s2 FROM v) SELECT series_id, {r('m * ln(2 * pi()) + m * ln(s2) + sse / s2 - n * ln(s2)')} AS "offset" FROM u""")  # fmt: skip
def ic_offset_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.ic_offset(P.supplier_months(spark, sf), 1), "offset")


# coefficients between -1 and 1 derived from order lines
COEF = "l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount * 20 - 1 AS a, l_tax * 24 - 0.97::DOUBLE AS b FROM lineitem"
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def coefficient_rows(spark: SparkSession, sf: str) -> DataFrame:
    lines = P.table(spark, sf, "lineitem")
    return lines.select(*LINE, (F.col("l_discount") * 20 - 1).alias("a"), (F.col("l_tax") * 24 - 0.97).alias("b"))


@query("full_polynomials", f"""WITH z AS (SELECT {COEF}) SELECT {', '.join(LINE)}, CAST(i AS BIGINT) AS lag,
 {r("CASE WHEN i = 1 THEN a WHEN i = 2 THEN b WHEN i = 4 THEN a * b WHEN i = 8 THEN 0.25::DOUBLE ELSE 0 END")} AS coefficient FROM z, range(1, 9) x(i)""")  # fmt: skip
def full_polynomials_query(spark: SparkSession, sf: str) -> DataFrame:
    z = coefficient_rows(spark, sf)
    full = full_polynomial(F.array("a", "b"), F.array(F.col("a") * F.col("b"), F.lit(0.25)), 4)
    rows = z.select(*LINE, F.posexplode(full).alias("at", "coefficient"))
    return rounded(rows.select(*LINE, (F.col("at") + 1).cast("bigint").alias("lag"), "coefficient"), "coefficient")


@query("psi_weights", f"""WITH z AS (SELECT {COEF}), w1 AS (SELECT *, b + a AS p1 FROM z), w2 AS (SELECT *, a * p1 + 0.3::DOUBLE AS p2 FROM w1),
 w3 AS (SELECT *, a * p2 + 0.3::DOUBLE * p1 AS p3 FROM w2), w4 AS (SELECT *, a * p3 + 0.3::DOUBLE * p2 AS p4 FROM w3)
 SELECT {', '.join(LINE)}, {r('p1')} AS psi_1, {r('p2')} AS psi_2, {r('p3')} AS psi_3, {r('p4')} AS psi_4 FROM w4""")  # fmt: skip
def psi_query(spark: SparkSession, sf: str) -> DataFrame:
    z = coefficient_rows(spark, sf).withColumn("psi", psi_weights(F.array(F.col("a"), F.lit(0.3)), F.array("b"), 4))
    names = [f"psi_{i}" for i in range(1, 5)]
    return rounded(z.select(*LINE, *[F.col("psi")[i].alias(n) for i, n in enumerate(names)]), *names)


@query("stationary_and_invertible", f"""WITH z AS (SELECT {COEF}) SELECT {', '.join(LINE)}, a + b < 1 AND b - a < 1 AND abs(b) < 1 AS stationary,
 -a - b < 1 AND -b + a < 1 AND abs(b) < 1 AS invertible FROM z""")  # fmt: skip
def stationary_query(spark: SparkSession, sf: str) -> DataFrame:
    z = coefficient_rows(spark, sf)
    return z.select(*LINE, stationary(F.array("a", "b")).alias("stationary"), invertible(F.array("a", "b")).alias("invertible"))


