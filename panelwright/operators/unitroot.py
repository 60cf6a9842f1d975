"""Stationarity and seasonality tests, and the differencing orders they choose."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.critical import (
    SEASONAL_STRENGTH_LIMIT,
    canova_hansen_critical,
    kpss_critical,
    kpss_p_value,
    ocsb_critical,
)
from panelwright.operators.differencing import difference_by_orders
from panelwright.operators.moments import full_matrix, moment_array, solve_normal
from panelwright.operators.panel import SEASONAL_TESTS
from panelwright.plans.blocks import KEYS, attach, block_window, drop_halo, running_sums, with_earlier, with_halo, with_lags
from panelwright.plans.session import checkpoint

def _block_summaries(rows: DataFrame, value: str, lags: int, keys: Sequence[str]) -> DataFrame:
    """Per block: rows, mean, and lag products around the block mean.

    Everything a series needs (mean, autocovariances, totals of earlier blocks)
    follows from these few numbers, so the panel is not read again for them.
    """
    inside = Window.partitionBy(*keys, "blk")
    local = rows.withColumn("_mean", F.avg(value).over(inside)).withColumn("_e", F.col(value) - F.col("_mean"))
    sums = [F.count(F.lit(1)).alias("rows"), F.first("_mean").alias("mean"), F.max("t").alias("last"), F.sum(F.col("_e") * F.col("_e")).alias("ss")]
    for i in range(1, lags + 1):
        back = F.col(f"_lag{i}") - F.col("_mean")
        both = F.when(F.col(f"_lag{i}").isNotNull(), F.col("_e"))
        sums += [
            F.coalesce(F.sum(both * back), F.lit(0.0)).alias(f"prod{i}"),
            F.coalesce(F.sum(both) + F.sum(back), F.lit(0.0)).alias(f"lin{i}"),
            F.count(f"_lag{i}").alias(f"cnt{i}"),
        ]
    return local.groupBy(*keys, "blk").agg(*sums)


def longest_series(panel: DataFrame) -> int:
    """The largest position of any series."""
    return panel.agg(F.max("t")).first()[0] or 1


def kpss(
    panel: DataFrame,
    regression: str = "c",
    lags: str | int = "auto",
    value: str = "y",
    keys: Sequence[str] = KEYS,
    longest: int | None = None,
) -> DataFrame:
    """KPSS statistic, lags used, p-value and critical values, one row per series.

    The automatic lag rule needs as many lag columns as its longest series asks
    for; ``longest`` is measured unless it is given.

    With bandwidth L the Bartlett sum equals the squared moving sums over L + 1
    residuals, divided by L + 1.  A moving sum is the running sum minus itself
    L + 1 rows earlier, so any bandwidth costs one shuffle.
    """
    keys = list(keys)
    critical = kpss_critical(regression)
    if isinstance(lags, str) and lags not in ("auto", "legacy"):
        raise ValueError("lags must be 'auto', 'legacy' or an integer")
    if lags == "auto" and longest is None:
        longest = longest_series(panel)
    panel = panel.select(*keys, "t", F.col(value).alias("y"))
    if regression == "ct":
        time = F.col("t").cast("double")
        line = panel.groupBy(*keys).agg(
            F.max("t").alias("n"), F.regr_slope("y", time).alias("_slope"), F.regr_intercept("y", time).alias("_level")
        )
        detrended = F.col("y") - F.col("_level") - F.col("_slope") * time
        panel = attach(panel, line, keys).select(*keys, "t", detrended.alias("y"))
    window_lags = int(math.floor(longest ** (2.0 / 9.0))) if lags == "auto" else 0
    rows = with_lags(panel, {f"_lag{i}": ("y", i) for i in range(1, window_lags + 1)}, keys)
    blocks = _block_summaries(rows, "y", window_lags, keys)

    series = Window.partitionBy(*keys)
    before = series.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.col("mean") - F.col("_mu")
    blocks = (
        blocks.withColumn("n_obs", F.sum("rows").over(series))
        .withColumn("_mu", F.sum(F.col("rows") * F.col("mean")).over(series) / F.col("n_obs"))
        .withColumn("_offset", F.coalesce(F.sum(F.col("rows") * shift).over(before), F.lit(0.0)))
    )
    n = F.col("n_obs").cast("double")
    if lags == "auto":
        ss = F.sum(F.col("ss") + F.col("rows") * shift * shift).over(series)
        s0 = F.when(ss > 0, ss / n).otherwise(F.lit(1e-5))
        s1 = F.lit(0.0)
        cov_lags = F.floor(F.pow(n, F.lit(2.0 / 9.0)))
        for i in range(1, window_lags + 1):
            covariance = F.sum(F.col(f"prod{i}") + shift * F.col(f"lin{i}") + F.col(f"cnt{i}") * shift * shift).over(series)
            r = F.when(cov_lags >= i, covariance / (n / 2.0)).otherwise(0.0)
            s0, s1 = s0 + r, s1 + i * r
        blocks = blocks.withColumns({"_s0": s0, "_s1": s1})
        ratio = F.try_divide(F.col("_s1"), F.col("_s0"))
        chosen = F.floor(1.1447 * F.pow(ratio * ratio, F.lit(1.0 / 3.0)) * F.pow(n, F.lit(1.0 / 3.0)))
        used = F.when(F.col("n_obs") <= longest, F.greatest(F.coalesce(chosen, F.lit(1)), F.lit(1))).otherwise(
            F.raise_error(F.lit(f"a series has more than {longest} rows: pass a larger 'longest'"))
        )
    elif lags == "legacy":
        used = F.least(F.ceil(12.0 * F.pow(n / 100.0, F.lit(0.25))), F.col("n_obs") - 1)
    else:
        used = F.when(F.col("n_obs") > lags, F.lit(lags)).otherwise(
            F.raise_error(F.lit("lags must be below the number of rows"))
        )
    context = blocks.select(*keys, "blk", "n_obs", "_mu", "_offset", used.cast("bigint").alias("lags"))

    inside = block_window(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = (
        rows.select(*keys, "t", "blk", "y")
        .join(context, [*keys, "blk"])
        .withColumn("e", F.col("y") - F.col("_mu"))
        .withColumn("c", F.col("_offset") + F.sum("e").over(inside))
    )
    met = with_earlier(running.withColumn("e2", F.col("e") * F.col("e")), ["c", "e2"], F.col("lags") + 1, ["n_obs", "lags"], "back_", keys)
    moving = F.col("c") - F.col("back_c")
    sums = met.groupBy(*keys).agg(
        F.max("n_obs").alias("n_obs"),
        F.max("lags").alias("lags"),
        F.sum(F.col("c") * F.col("c")).alias("_cc"),
        F.sum(moving * moving).alias("_mm"),
        F.sum("e2").alias("_ee"),
    )
    s2 = F.col("_mm") / (F.col("lags") + 1) / n
    stat = F.when((F.col("_ee") == 0) | (s2 == 0), 0.0).otherwise(F.col("_cc") / (n * n) / s2)
    return (
        sums.withColumn("stat", stat)
        .withColumn("p_value", kpss_p_value(F.col("stat"), regression))
        .withColumn("critical", F.array(*[F.lit(c) for c in critical]))
        .select(*keys, "stat", "lags", "p_value", "critical")
    )


def ndiffs(
    panel: DataFrame,
    maxd: int = 2,
    D: int | str = 0,
    s: int = 1,
    value: str = "y",
    keys: Sequence[str] = KEYS,
    longest: int | None = None,
    max_sd: int = 1,
) -> DataFrame:
    """Smallest d whose (d, D)-difference passes KPSS at 5 %, else ``maxd``.

    All d are tested in one job.  ``D`` is a number, or the name of a column with
    values up to ``max_sd``.
    """
    keys = list(keys)
    seasonal = F.lit(D) if isinstance(D, int) else F.col(D)
    orders = [D] if isinstance(D, int) else range(max_sd + 1)
    longest = longest_series(panel) if longest is None else longest
    rows = panel.select(*keys, "t", F.col(value).alias("y"), seasonal.cast("int").alias("sd")).withColumn(
        "d", F.explode(F.array(*[F.lit(i) for i in range(maxd + 1)]))
    )
    each = [*keys, "d"]
    pairs_ = [(i, j) for i in range(maxd + 1) for j in orders]
    tested = kpss(difference_by_orders(rows, pairs_, s, "y", "w", each), "c", "auto", "w", each, longest)
    passed = F.min(F.when(F.col("p_value") > 0.05, F.col("d")))
    return tested.groupBy(*keys).agg(F.coalesce(passed, F.lit(maxd)).cast("int").alias("d"))


def lag_matrix(panel: DataFrame, lag: int, value: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    """Columns lag_0 .. lag_{lag-1} of ``value``, complete rows only; lag 0 gives one zero column."""
    if lag <= 0:
        return panel.select(*keys, "t", F.lit(0.0).alias("lag_0"))
    names = {f"lag_{k}": (value, k) for k in range(lag)}
    return with_lags(panel, names, keys).where(F.col("t") >= lag).select(*keys, "t", *names)


# --- OCSB -----------------------------------------------------------------------------------------


def _ocsb_columns(m: int, max_lag: int) -> list[tuple[str, int]]:
    """Columns of the joint moment matrix: y_t-k, seasonal and plain differences at their lags, 1."""
    columns = [("y", k) for k in range(max_lag + 1)]
    columns += [("ys", k) for k in range(1, max_lag + 2)]
    columns += [("dx", k) for k in range(m, m + max_lag + 1)]
    return columns + [("one", 0)]


def _ocsb_regression(gram: np.ndarray, index: dict, m: int, lag: int, max_lag: int, rows: float) -> tuple[float, float, int, int]:
    """t-value of the seasonal-root column, RSS, rows and columns of one lag order.

    The auxiliary regression and the columns built from it are linear in the
    joint columns, so both regressions come from the same moment matrix.
    """
    late = max_lag - lag
    size = gram.shape[0]

    def unit(name: str, k: int) -> np.ndarray:
        v = np.zeros(size)
        v[index[(name, k)]] = 1.0
        return v

    target = unit("y", 0)
    lags = [unit("y", late + k) for k in range(1, lag + 1)]
    first = np.array([unit("one", 0), *lags])
    beta = solve_normal(first @ gram @ first.T, first @ gram @ target)

    def filtered(name: str, start: int) -> np.ndarray:
        out = unit(name, start) - beta[0] * unit("one", 0)
        for k in range(1, lag + 1):
            out = out - beta[k] * unit(name, start + k)
        return out

    design = np.array([*lags, filtered("ys", 1 + late), filtered("dx", m + late)])
    normal = design @ gram @ design.T
    coef = solve_normal(normal, design @ gram @ target)
    rest = target - coef @ design
    rss = float(rest @ gram @ rest)
    columns = design.shape[0]
    scale = np.sqrt(np.where(np.diag(normal) > 0, np.diag(normal), 1.0))
    inverse = np.linalg.pinv(normal / np.outer(scale, scale), rcond=1e-15, hermitian=True) / np.outer(scale, scale)
    error = math.sqrt(rss / (rows - columns) * inverse[-1, -1])
    return float(coef[-1] / error), rss, int(rows), columns


def _ocsb_criterion(method: str, order: str, rss: float, rows: int, columns: int) -> float:
    # order "kept": the arguments land one place later (n=rss, k=n, rss=k), as the reference results need
    n, k, r = (rss, rows, columns) if order == "kept" else (rows, columns, rss)
    if method == "aic":
        return n * math.log(r / n) + 2 * k
    if method == "bic":
        return n * math.log(r / n) + k * math.log(n)
    return n * math.log(r / n) + 2 * k * (n / (n - k - 1))


def ocsb_moments(panel: DataFrame, m: int, max_lag: int = 3, value: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    """Joint moment matrices of the OCSB regressions, one row per series and row class.

    Regressions with fewer lags use a few more rows at the start; the class says
    how many lags a row can serve, so every row range is a sum of classes.
    """
    reach = m + max(max_lag, 1) + 1
    columns = _ocsb_columns(m, max_lag)
    lags = {f"_x{k}": (value, k) for k in range(reach + 1)}
    x = lambda k: F.col(f"_x{k}")

    def column(name: str, k: int) -> Column:
        if name == "y":
            return (x(k) - x(k + 1)) - (x(k + m) - x(k + m + 1))
        if name == "ys":
            return x(k) - x(k + m)
        if name == "dx":
            return x(k) - x(k + 1)
        return F.lit(1.0)

    usable = [(name, k) for name, k in columns]
    rows = with_lags(panel.select(*keys, "t", value), lags, keys).where(F.col("t") >= m + 2)
    classes = F.least(F.col("t") - (m + 2), F.lit(max_lag)).cast("int").alias("lags_served")
    return (
        rows.select(*keys, classes, *[column(n_, k).alias(f"_z{i}") for i, (n_, k) in enumerate(usable)])
        .groupBy(*keys, "lags_served")
        .agg(moment_array([F.col(f"_z{i}") for i in range(len(usable))]).alias("gram"), F.count(F.lit(1)).alias("rows"))
    )


def _ocsb_solver(m: int, max_lag: int, method: str, order: str):
    columns = _ocsb_columns(m, max_lag)
    index = {c: i for i, c in enumerate(columns)}
    size = len(columns)

    def matrices(classes) -> tuple[np.ndarray, np.ndarray]:
        upper = np.zeros((max_lag + 1, size * (size + 1) // 2))
        rows = np.zeros(max_lag + 1)
        for part in classes:
            upper[part["lags_served"]] += np.asarray(part["gram"], dtype=float)
            rows[part["lags_served"]] += part["rows"]
        return upper, rows

    def fit(upper: np.ndarray, rows: np.ndarray, lag: int, bound: int):
        gram = full_matrix(upper[bound:].sum(axis=0), size)
        return _ocsb_regression(gram, index, m, lag, bound, rows[bound:].sum())

    def attempt(upper, rows, lag, bound):
        try:
            result = fit(upper, rows, lag, bound)
            return result if np.isfinite(result[0]) else None
        except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
            return None

    def solve(batch: pd.Series) -> list[dict]:
        out = []
        for classes in batch:
            upper, rows = matrices(classes)
            lag = max_lag
            scores: list[float | None] = []
            if max_lag > 0 and method != "fixed":
                values = []
                for candidate in range(1, max_lag + 1):
                    result = attempt(upper, rows, candidate, max_lag)
                    try:
                        score = math.inf if result is None else _ocsb_criterion(method, order, *result[1:])
                    except (ValueError, ZeroDivisionError):
                        score = math.inf
                    values.append(score)
                lag = int(np.argmin(values)) + 1
                scores = [v if math.isfinite(v) else None for v in values]
            final = attempt(upper, rows, lag, lag)
            out.append(
                {"stat": None if final is None else final[0], "lag": lag, "rss": None if final is None else final[1], "scores": scores}
            )
        return out

    return solve


def ocsb(
    panel: DataFrame,
    m: int = 12,
    method: str = "aic",
    max_lag: int = 3,
    value: str = "y",
    keys: Sequence[str] = KEYS,
    argument_order: str = "kept",
) -> DataFrame:
    """OCSB statistic, chosen lag, critical value and seasonal order sd, one row per series.

    ``argument_order='textbook'`` uses the criteria as published for the lag choice.
    """
    if method not in ("fixed", "aic", "bic", "aicc"):
        raise ValueError("method must be 'fixed', 'aic', 'bic' or 'aicc'")
    critical = ocsb_critical(m)
    solve = _ocsb_solver(m, max_lag, method, argument_order)

    @F.pandas_udf("stat double, lag int, rss double, scores array<double>")
    def regressions(classes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(solve(classes), columns=["stat", "lag", "rss", "scores"])

    # at most max_lag + 1 small rows per series are gathered here
    gathered = ocsb_moments(panel, m, max_lag, value, keys).groupBy(*keys).agg(
        F.collect_list(F.struct("lags_served", "gram", "rows")).alias("classes")
    )
    return (
        gathered.withColumn("_r", regressions("classes"))
        .select(*keys, F.col("_r.stat").alias("stat"), F.col("_r.lag").alias("lag"), F.col("_r.scores").alias("scores"))
        .withColumn("critical", F.lit(critical))
        .withColumn("sd", F.when(F.col("stat") > critical, 1).otherwise(0))
    )


# --- seasonal strength ----------------------------------------------------------------------------


def seasonal_strength(panel: DataFrame, s: int, value: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    """Strength of seasonality of a classical decomposition and sd (1 above 0.64).

    The trend is a centred moving average (2 x s for even s), the season the mean
    of the detrended rows by phase, centred over the phases.
    """
    if s < 2:
        raise ValueError("the seasonal period must be at least 2")
    keys = list(keys)
    half = s // 2
    window = block_window(keys)
    halo = with_halo(panel.select(*keys, "t", value), 2 * half)

    def total(first: int, last: int) -> Column:
        return F.sum(value).over(window.rowsBetween(first, last))

    trend = (total(1 - s, 0) + total(-s, -1)) / (2.0 * s) if s % 2 == 0 else total(1 - s, 0) / float(s)
    # a row looks back over the whole window, so the centre lies ``half`` rows earlier
    detrended = (
        drop_halo(halo.withColumn("_trend", trend).withColumn("_centre", F.lag(value, half).over(window)))
        .where(F.col("t") > 2 * half)
        .select(*keys, "t", "blk", F.pmod(F.col("t") - half, F.lit(s)).alias("phase"), (F.col("_centre") - F.col("_trend")).alias("x"))
    )
    # the season and the remainder only need counts, sums and squares by phase
    phases = detrended.groupBy(*keys, "phase").agg(
        F.count("x").alias("k"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.avg("x").alias("season")
    )
    season = F.col("season") - F.col("_level")
    rest = F.col("sx") - F.col("k") * season
    rest2 = F.col("sxx") - 2 * season * F.col("sx") + F.col("k") * season * season
    k = F.sum("k").cast("double")

    def variance(total: Column, squares: Column) -> Column:
        return (F.sum(squares) - F.sum(total) * F.sum(total) / k) / (k - 1)

    return (
        phases.withColumn("_level", F.avg("season").over(Window.partitionBy(*keys)))
        .groupBy(*keys)
        .agg(variance(rest, rest2).alias("_vr"), variance(F.col("sx"), F.col("sxx")).alias("_vx"))
        .withColumn("strength", F.greatest(F.lit(0.0), 1.0 - F.coalesce(F.try_divide("_vr", "_vx"), F.lit(1.0))))
        .withColumn("sd", F.when(F.col("strength") > SEASONAL_STRENGTH_LIMIT, 1).otherwise(0))
        .select(*keys, "strength", "sd")
    )


# --- Canova-Hansen --------------------------------------------------------------------------------


def _seasonal_waves(s: int) -> list[Column]:
    angle = lambda j: F.col("t").cast("double") * F.lit(2.0 * math.pi * j / s)
    waves: list[Column] = []
    for j in range(1, (s - 1) // 2 + 1):
        waves += [F.cos(angle(j)), F.sin(angle(j))]
    if s % 2 == 0:
        waves.append(F.when(F.col("t") % 2 == 0, 1.0).otherwise(-1.0))
    return waves


def canova_hansen(panel: DataFrame, s: int, value: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    """LM statistic of Canova and Hansen for stable seasonality and sd (1 above the 5 % value).

    Regress on an intercept and seasonal waves, cumulate wave times residual, and
    weigh by the inverse of the Bartlett long-run covariance of the same products.
    """
    if s < 2:
        raise ValueError("the seasonal period must be at least 2")
    keys = list(keys)
    waves = _seasonal_waves(s)
    k = len(waves)
    names = [f"_f{i}" for i in range(k)]
    rows = panel.select(*keys, "t", F.col(value).alias("y"), *[w.alias(n_) for w, n_ in zip(waves, names)])
    @F.pandas_udf("array<double>")
    def regress(upper: pd.Series) -> pd.Series:
        out = []
        for values in upper:
            g = full_matrix(np.asarray(values, dtype=float), k + 2)
            out.append(solve_normal(g[1:, 1:], g[1:, 0]).tolist())
        return pd.Series(out)

    moments = rows.groupBy(*keys).agg(
        F.max("t").alias("n"),
        F.count(F.lit(1)).alias("n_obs"),
        moment_array([F.col("y"), F.lit(1.0), *[F.col(n_) for n_ in names]]).alias("_gram"),
    )
    bandwidth = F.rint(F.lit(float(s)) * F.pow(F.col("n_obs") / 100.0, F.lit(0.25))).cast("bigint")
    fitted = moments.select(*keys, "n", "n_obs", bandwidth.alias("lags"), regress("_gram").alias("_b"))
    both = attach(rows, fitted, keys)
    residual = F.col("y") - F.col("_b")[0]
    for i, n_ in enumerate(names):
        residual = residual - F.col("_b")[i + 1] * F.col(n_)
    scores = both.withColumn("_e", residual).select(
        *keys, "t", "blk", "n", "n_obs", "lags", *[(F.col(n_) * F.col("_e")).alias(n_) for n_ in names]
    )
    cumulated = [f"_c{i}" for i in range(k)]
    summed = running_sums(scores, dict(zip(cumulated, names)), keys).drop(*names)
    met = with_earlier(summed, cumulated, F.col("lags") + 1, ["n_obs", "lags"], "back", keys)
    agg = (
        met.withColumns({f"_m{i}": F.col(c) - F.col(f"back{c}") for i, c in enumerate(cumulated)})
        .groupBy(*keys)
        .agg(
            F.max("n_obs").alias("n_obs"),
            F.max("lags").alias("lags"),
            moment_array([F.col(c) for c in cumulated]).alias("_cc"),
            moment_array([F.col(f"_m{i}") for i in range(k)]).alias("_mm"),
        )
    )

    @F.pandas_udf("double")
    def statistic(cc: pd.Series, mm: pd.Series, n_obs: pd.Series, lags: pd.Series) -> pd.Series:
        out = []
        for c, m_, n_, lag in zip(cc, mm, n_obs, lags):
            spread = full_matrix(np.asarray(m_, dtype=float), k) / (lag + 1) / n_
            if np.linalg.svd(spread, compute_uv=False).min() < np.finfo(float).eps:
                out.append(0.0)
            else:
                out.append(float(np.trace(np.linalg.solve(spread, full_matrix(np.asarray(c, dtype=float), k)))) / n_**2)
        return pd.Series(out)

    critical = canova_hansen_critical(s)
    return (
        agg.withColumn("stat", statistic("_cc", "_mm", "n_obs", "lags"))
        .withColumn("sd", F.when(F.col("stat") > critical, 1).otherwise(0))
        .select(*keys, "stat", "lags", "sd")
    )


def nsdiffs(panel: DataFrame, s: int, test: str = "ocsb", value: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    """Seasonal order sd by the named test."""
    if test not in SEASONAL_TESTS:
        raise ValueError(f"the test {test!r} is not one of {SEASONAL_TESTS}")
    operator = {"ocsb": ocsb, "seas": seasonal_strength, "ch": canova_hansen}[test]
    return operator(panel, s, value=value, keys=keys).select(*keys, F.col("sd").cast("int").alias("sd"))


# --- several columns ------------------------------------------------------------------------------


def auto_difference(
    table: DataFrame,
    columns: Sequence[str],
    s: int = 1,
    seasonal_test: str = "ocsb",
    maxd: int = 2,
    longest: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Difference every column of ``series_id, ts, t, columns`` by its own tested orders.

    Returns the table cut to the rows all columns share, and the orders
    ``series_id, variable, d, sd``.  Columns named ``outlier*`` stay as they are.
    """
    if s < 1:
        raise ValueError("s must be at least 1")
    if seasonal_test not in SEASONAL_TESTS:
        raise ValueError(f"the test {seasonal_test!r} is not one of {SEASONAL_TESTS}")
    keys = ["series_id", "variable"]
    long = table.unpivot(["series_id", "ts", "t"], list(columns), "variable", "y").withColumn("y", F.col("y").cast("double"))
    tested = long.where(~F.col("variable").startswith("outlier"))
    ends = long.groupBy(*keys).agg(F.max("t").alias("n"))
    if s == 1:
        orders = ndiffs(tested, maxd, 0, s, "y", keys, longest).withColumn("sd", F.lit(0))
    else:
        seasonal = checkpoint(nsdiffs(tested, s, seasonal_test, "y", keys).join(ends, keys))
        with_d = attach(tested, seasonal, keys).drop("n", "blk")
        orders = ndiffs(with_d, maxd, "sd", s, "y", keys, longest).join(seasonal.drop("n"), keys)
    orders = ends.join(orders, keys, "left").fillna(0, ["d", "sd"]).select(*keys, "n", "d", "sd")
    orders = checkpoint(orders)
    rows = attach(long, orders, keys).drop("n", "blk")
    pairs_ = [(i, j) for i in range(maxd + 1) for j in ((0,) if s == 1 else (0, 1))]
    differenced = difference_by_orders(rows, pairs_, s, "y", "w", keys)
    wide = differenced.groupBy("series_id", "ts", "t").pivot("variable", list(columns)).agg(F.first("w"))
    return wide.dropna(subset=list(columns)), orders.drop("n")
