"""Unit-root and seasonality tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.catalog import panels as P
from panelwright.catalog.diff_queries import difference_sql
from panelwright.catalog.registry import query, r, rounded
from panelwright.functions.critical import KPSS_CRITICAL, P_VALUES, canova_hansen_critical, ocsb_critical
from panelwright.functions.critical import kpss_p_value
from panelwright.operators import unitroot as U

SUP = P.supplier_months_sql()
FLAG = P.flag_months_sql()
DAYS = P.event_days_sql()


def p_value_sql(stat: str, regression: str = "c") -> str:
    crit = KPSS_CRITICAL[regression]
    text = f"CASE WHEN {stat} <= {crit[0]}::DOUBLE THEN 0.1::DOUBLE WHEN {stat} >= {crit[3]}::DOUBLE THEN 0.01::DOUBLE "
    for i in range(3):
        slope = (P_VALUES[i + 1] - P_VALUES[i]) / (crit[i + 1] - crit[i])
        text += f"WHEN {stat} <= {crit[i + 1]}::DOUBLE THEN {P_VALUES[i]}::DOUBLE + ({slope!r}::DOUBLE) * ({stat} - {crit[i]}::DOUBLE) "
    return text + "END"


def kpss_sql(source: str, value: str, keys: str = "series_id", lags: str | int = "auto", regression: str = "c") -> str:
    """Common table expressions ending in kpss(keys..., stat, lags, p_value), with products by explicit lag."""
    residual = (
        f"{value} - avg({value}) OVER g" if regression == "c" else f"{value} - (regr_intercept({value}, t) OVER g + regr_slope({value}, t) OVER g * t)"
    )
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    used = {
        "auto": "greatest(CAST(floor(1.1447::DOUBLE * pow((s1 / s0) * (s1 / s0), 1::DOUBLE / 3) * pow(m, 1::DOUBLE / 3)) AS BIGINT), 1)",
        "legacy": "least(CAST(ceil(12.0::DOUBLE * pow(m / 100.0::DOUBLE, 0.25::DOUBLE)) AS BIGINT), m - 1)",
    }.get(lags, str(lags))
    a_keys = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""k_e AS (SELECT {keys}, t, count(*) OVER g AS m, {residual} AS e FROM {source} WINDOW g AS (PARTITION BY {keys})),
 k_c AS (SELECT *, sum(e) OVER (PARTITION BY {keys} ORDER BY t) AS c FROM k_e),
 k_base AS (SELECT {keys}, max(m) AS m, sum(e * e) AS ss, sum(c * c) AS cc FROM k_c GROUP BY {keys}),
 k_prod AS (SELECT {a_keys}, a.t - b.t AS l, sum(a.e * b.e) AS g FROM k_e a JOIN k_e b ON {on} AND b.t < a.t GROUP BY ALL),
 k_s AS (SELECT {keys}, any_value(m) AS m, any_value(ss) AS ss, any_value(cc) AS cc,
   CASE WHEN any_value(ss) > 0 THEN any_value(ss) / any_value(m) ELSE 1e-5 END + coalesce(sum(g / (m / 2.0::DOUBLE)) FILTER (WHERE l <= floor(pow(m, 2::DOUBLE / 9))), 0) AS s0,
   coalesce(sum(l * g / (m / 2.0::DOUBLE)) FILTER (WHERE l <= floor(pow(m, 2::DOUBLE / 9))), 0) AS s1 FROM k_base LEFT JOIN k_prod USING ({keys}) GROUP BY {keys}),
 k_l AS (SELECT *, CAST({used} AS BIGINT) AS lags FROM k_s),
 k_v AS (SELECT {keys}, any_value(m) AS m, any_value(cc) AS cc, any_value(lags) AS lags,
   (any_value(ss) + 2 * coalesce(sum((1 - l / (lags + 1.0::DOUBLE)) * g) FILTER (WHERE l <= lags), 0)) / any_value(m) AS s2 FROM k_l LEFT JOIN k_prod USING ({keys}) GROUP BY {keys}),
 k_stat AS (SELECT {keys}, lags, cc / (m * m) / s2 AS stat FROM k_v),
 kpss AS (SELECT *, {p_value_sql('stat', regression)} AS p_value FROM k_stat)"""


KPSS_OUT = f"series_id, {r('stat')} AS stat, lags, {r('p_value')} AS p_value FROM kpss"


def _kpss(panel, regression="c", lags="auto"):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(U.kpss(panel(spark, sf), regression, lags), "stat", "p_value").select("series_id", "stat", "lags", "p_value")

    return run


for _name, _panel, _sql, _regression, _lags in (
    ("kpss_level_auto", P.supplier_months, SUP, "c", "auto"),
    ("kpss_level_legacy", P.supplier_months, SUP, "c", "legacy"),
    ("kpss_level_fixed", P.flag_months, FLAG, "c", 5),
    ("kpss_trend_auto", P.supplier_months, SUP, "ct", "auto"),
    ("kpss_trend_legacy", P.event_hours, P.event_hours_sql(), "ct", "legacy"),
):
    query(_name, f"WITH {_sql}, {kpss_sql('p', 'y', lags=_lags, regression=_regression)} SELECT {KPSS_OUT}")(_kpss(_panel, _regression, _lags))


@query("kpss_p_value", f"SELECT l_orderkey, l_linenumber, l_partkey, {r(p_value_sql('l_discount * 8'))} AS level, {r(p_value_sql('l_tax * 3', 'ct'))} AS trend FROM lineitem")
def p_value_query(spark: SparkSession, sf: str) -> DataFrame:
    lines = P.table(spark, sf, "lineitem")
    level, trend = kpss_p_value(F.col("l_discount") * 8), kpss_p_value(F.col("l_tax") * 3, "ct")
    return rounded(lines.select("l_orderkey", "l_linenumber", "l_partkey", level.alias("level"), trend.alias("trend")), "level", "trend")


def ndiffs_sql(D_: int, s: int, panel: str) -> str:
    parts = ", ".join(difference_sql(d, D_, s, "p", f"d{d}") for d in range(3))
    union = " UNION ALL ".join(f"SELECT series_id, {d} AS i, t, w FROM d{d}" for d in range(3))
    return (
        f"WITH {panel}, {parts}, tried AS ({union}), {kpss_sql('tried', 'w', 'series_id, i')} "
        "SELECT series_id, CAST(coalesce(min(i) FILTER (WHERE p_value > 0.05::DOUBLE), 2) AS INTEGER) AS d FROM kpss GROUP BY 1"
    )


@query("ndiffs", ndiffs_sql(0, 12, SUP))
def ndiffs_query(spark: SparkSession, sf: str) -> DataFrame:
    return U.ndiffs(P.supplier_months(spark, sf), 2, 0, 12)


@query("ndiffs_after_season", ndiffs_sql(1, 7, DAYS))
def ndiffs_season_query(spark: SparkSession, sf: str) -> DataFrame:
    return U.ndiffs(P.event_days(spark, sf), 2, 1, 7)


@query("lag_matrix", f"WITH {SUP} SELECT * FROM (SELECT series_id, t, {r('y')} AS lag_0, {r('lag(y, 1) OVER w')} AS lag_1, {r('lag(y, 2) OVER w')} AS lag_2, "
       f"{r('lag(y, 3) OVER w')} AS lag_3 FROM p WINDOW w AS (PARTITION BY series_id ORDER BY t)) WHERE t >= 4")  # fmt: skip
def lag_matrix_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(U.lag_matrix(P.supplier_months(spark, sf), 4), "lag_0", "lag_1", "lag_2", "lag_3")


def ocsb_lag1_sql(m: int) -> str:
    """OCSB with one fixed lag: two regressions in closed form."""
    w = "WINDOW w AS (PARTITION BY series_id ORDER BY t)"
    x = lambda k: f"lag(y, {k}) OVER w" if k else "y"
    double = lambda k: f"(({x(k)}) - ({x(k + 1)})) - (({x(k + m)}) - ({x(k + m + 1)}))"
    names = ["x1", "x2", "x3"]
    g = {f"{a}{b}": f"sum({a} * {b})" for i, a in enumerate(names) for b in names[i:]}
    sums = ", ".join(f"{v} AS s{k}" for k, v in g.items()) + ", " + ", ".join(f"sum({a} * yy) AS sy{a}" for a in names) + ", sum(yy * yy) AS syy, count(*) AS m"
    a11, a12, a13, a22, a23, a33 = "sx1x1", "sx1x2", "sx1x3", "sx2x2", "sx2x3", "sx3x3"
    det = f"({a11} * ({a22} * {a33} - {a23} * {a23}) - {a12} * ({a12} * {a33} - {a23} * {a13}) + {a13} * ({a12} * {a23} - {a22} * {a13}))"
    inv = {
        (1, 1): f"({a22} * {a33} - {a23} * {a23})", (1, 2): f"({a13} * {a23} - {a12} * {a33})", (1, 3): f"({a12} * {a23} - {a13} * {a22})",
        (2, 2): f"({a11} * {a33} - {a13} * {a13})", (2, 3): f"({a12} * {a13} - {a11} * {a23})", (3, 3): f"({a11} * {a22} - {a12} * {a12})",
    }
    beta = [" + ".join(f"{inv[min(i, j), max(i, j)]} * syx{j}" for j in (1, 2, 3)) for i in (1, 2, 3)]
    return f"""o1 AS (SELECT series_id, t, {double(0)} AS yy, {double(1)} AS x1, ({x(1)}) - ({x(1 + m)}) AS s1, ({x(2)}) - ({x(2 + m)}) AS s2,
   ({x(m)}) - ({x(m + 1)}) AS d1, ({x(m + 1)}) - ({x(m + 2)}) AS d2 FROM p {w}),
 o2 AS (SELECT * FROM o1 WHERE t >= {m + 3}),
 o3 AS (SELECT series_id, regr_slope(yy, x1) AS b, regr_intercept(yy, x1) AS a FROM o2 GROUP BY 1),
 o4 AS (SELECT series_id, yy, x1, s1 - a - b * s2 AS x2, d1 - a - b * d2 AS x3 FROM o2 JOIN o3 USING (series_id)),
 o5 AS (SELECT series_id, {sums} FROM o4 GROUP BY 1),
 o6 AS (SELECT *, {det} AS det, ({beta[0]}) / {det} AS b1, ({beta[1]}) / {det} AS b2, ({beta[2]}) / {det} AS b3, {inv[3, 3]} / {det} AS i33 FROM o5),
 ocsb AS (SELECT series_id, b3 / sqrt((syy - b1 * syx1 - b2 * syx2 - b3 * syx3) / (m - 3) * i33) AS stat FROM o6)"""


@query("ocsb_one_lag", f"WITH {SUP}, {ocsb_lag1_sql(12)} SELECT series_id, {r('stat', 5)} AS stat, {r(repr(ocsb_critical(12)) + '::DOUBLE')} AS critical, "
       f"CASE WHEN stat > {ocsb_critical(12)!r}::DOUBLE THEN 1 ELSE 0 END AS sd FROM ocsb")  # fmt: skip
def ocsb_one_lag(spark: SparkSession, sf: str) -> DataFrame:
    out = U.ocsb(P.supplier_months(spark, sf), 12, "fixed", 1).select("series_id", F.round("stat", 5).alias("stat"), "critical", "sd")
    return rounded(out, "critical")


@query("ocsb_lag_choice")
def ocsb_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(U.ocsb(P.supplier_months(spark, sf), 12).select("series_id", "stat", "lag", "critical", "sd"), "stat")


@query("ocsb_textbook_criterion")
def ocsb_textbook(spark: SparkSession, sf: str) -> DataFrame:
    out = U.ocsb(P.supplier_months(spark, sf), 12, "bic", argument_order="textbook")
    return rounded(out.select("series_id", "stat", "lag", "critical", "sd"), "stat")


def strength_sql(s: int) -> str:
    half = s // 2
    if s % 2 == 0:
        trend = f"(avg(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {half} PRECEDING AND {half - 1} FOLLOWING) + avg(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {half - 1} PRECEDING AND {half} FOLLOWING)) / 2"
    else:
        trend = f"avg(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    return f"""s1 AS (SELECT series_id, t, n, t % {s} AS phase, y - ({trend}) AS x FROM p), s2 AS (SELECT * FROM s1 WHERE t > {half} AND t <= n - {half}),
 s3 AS (SELECT series_id, phase, avg(x) AS season FROM s2 GROUP BY ALL), s4 AS (SELECT series_id, phase, season - avg(season) OVER (PARTITION BY series_id) AS season FROM s3),
 strength AS (SELECT series_id, greatest(0.0::DOUBLE, 1 - var_samp(x - season) / var_samp(x)) AS strength FROM s2 JOIN s4 USING (series_id, phase) GROUP BY 1)"""


STRENGTH_OUT = f"series_id, {r('strength')} AS strength, CASE WHEN strength > 0.64::DOUBLE THEN 1 ELSE 0 END AS sd FROM strength"


@query("seasonal_strength_months", f"WITH {SUP}, {strength_sql(12)} SELECT {STRENGTH_OUT}")
def strength_months(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(U.seasonal_strength(P.supplier_months(spark, sf), 12), "strength")


@query("seasonal_strength_week", f"WITH {DAYS}, {strength_sql(7)} SELECT {STRENGTH_OUT}")
def strength_week(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(U.seasonal_strength(P.event_days(spark, sf), 7), "strength")


def canova_hansen_two_sql() -> str:
    """Period 2: one wave (-1)^t, so the statistic is a ratio of two sums."""
    return f"""c1 AS (SELECT series_id, t, n, y, CASE WHEN t % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS f FROM p),
 c2 AS (SELECT series_id, regr_slope(y, f) AS b, regr_intercept(y, f) AS a FROM c1 GROUP BY 1),
 c3 AS (SELECT series_id, t, n, f * (y - a - b * f) AS g, CAST(round_even(2.0::DOUBLE * pow(n / 100.0::DOUBLE, 0.25::DOUBLE), 0) AS BIGINT) AS lags FROM c1 JOIN c2 USING (series_id)),
 c4 AS (SELECT *, sum(g) OVER (PARTITION BY series_id ORDER BY t) AS c FROM c3),
 c5 AS (SELECT a.series_id, sum(a.g * b.g * (1 - (a.t - b.t) / (a.lags + 1.0::DOUBLE)) * CASE WHEN a.t = b.t THEN 1 ELSE 2 END) / any_value(a.n) AS s2
   FROM c3 a JOIN c3 b ON a.series_id = b.series_id AND b.t BETWEEN a.t - a.lags AND a.t GROUP BY 1),
 ch AS (SELECT series_id, any_value(lags) AS lags, sum(c * c) / any_value(s2) / (any_value(n) * any_value(n)) AS stat FROM c4 JOIN c5 USING (series_id) GROUP BY 1)"""


@query("canova_hansen_two_seasons", f"WITH {SUP}, {canova_hansen_two_sql()} SELECT series_id, {r('stat')} AS stat, lags, "
       f"CASE WHEN stat > {canova_hansen_critical(2)!r}::DOUBLE THEN 1 ELSE 0 END AS sd FROM ch")  # fmt: skip
def canova_hansen_two(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(U.canova_hansen(P.supplier_months(spark, sf), 2), "stat")


@query("canova_hansen_months")
def canova_hansen_months(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(U.canova_hansen(P.supplier_months(spark, sf), 12), "stat")


@query("nsdiffs_by_strength", f"WITH {SUP}, {strength_sql(12)} SELECT series_id, CASE WHEN strength > 0.64::DOUBLE THEN 1 ELSE 0 END AS sd FROM strength")
def nsdiffs_strength(spark: SparkSession, sf: str) -> DataFrame:
    return U.nsdiffs(P.supplier_months(spark, sf), 12, "seas")


@query("nsdiffs_by_ocsb")
def nsdiffs_ocsb(spark: SparkSession, sf: str) -> DataFrame:
    return U.nsdiffs(P.event_hours(spark, sf), 24, "ocsb")


