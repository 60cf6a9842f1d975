"""Estimation over panels: designs, exact linear fits, grouped fits of full candidates.

A specification row is ``series_id, model_id, p, d, q, sp, sd, sq, s, mean, drift,
objective, lambda, alpha`` (``sp, sd, sq`` are the seasonal orders: Spark column
names ignore case, so P and p would collide).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.criteria import log_likelihood, model_aic, model_aicc, model_bic, residual_variance
from panelwright.functions.polynomials import full_polynomial, invertible, stationary
from panelwright.operators.differencing import difference_by_orders, order_pairs
from panelwright.operators.kernel import Layout, fit_candidates, lambda_path
from panelwright.operators.moments import full_matrix, moment_array, solve_bounded
from panelwright.operators.panel import lengths, model_label
from panelwright.operators.regpath import solve_penalised
from panelwright.operators.unitroot import auto_difference
from panelwright.plans.blocks import KEYS, attach, block_rows, with_lags

MODEL = ["series_id", "model_id"]
SPEC_COLUMNS = ["series_id", "model_id", "p", "d", "q", "sp", "sd", "sq", "s", "mean", "drift", "objective", "lambda", "alpha"]
GIVEN_COLUMNS = ["c", "trend", "ar", "ma", "sar", "sma", "beta"]
FIT_FIELDS = (
    "c double, trend double, ar array<double>, ma array<double>, sar array<double>, sma array<double>, "
    "beta array<double>, sse double, sae double, worst double, n_resid int, n_w int, k int, k_var int, "
    "lambda double, bound double, recent array<double>, converged boolean"
)
CANDIDATE_BLOCK = 12


def specify(
    series: DataFrame,
    p: int = 0,
    d: int = 0,
    q: int = 0,
    sp: int = 0,
    sd: int = 0,
    sq: int = 0,
    s: int = 1,
    mean: bool = True,
    drift: bool = False,
    objective: str = "mse",
    lam: float | None = None,
    alpha: float | None = None,
) -> DataFrame:
    """The same specification for every series of ``series``."""
    if mean and drift:
        raise ValueError("mean and drift are both an intercept of the differenced series: allow one of them")
    values = {"p": p, "d": d, "q": q, "sp": sp, "sd": sd, "sq": sq, "s": s}
    spec = series.select("series_id").distinct()
    spec = spec.withColumns({k: F.lit(v) for k, v in values.items()}).withColumns(
        {
            "mean": F.lit(mean),
            "drift": F.lit(drift),
            "objective": F.lit(objective),
            "lambda": F.lit(lam).cast("double"),
            "alpha": F.lit(alpha).cast("double"),
        }
    )
    return spec.withColumn("model_id", model_label()).select(*SPEC_COLUMNS)


def param_count(exog: int = 0) -> Column:
    """Parameters of a specification row, the variance included."""
    constants = F.col("mean").cast("int") + F.col("drift").cast("int")
    return F.col("p") + F.col("q") + F.col("sp") + F.col("sq") + constants + exog + 1


# --- linear models from moments ---------------------------------------------------------------------


def _first_rows(max_p: int, max_sp: int, s: int) -> list[int]:
    return sorted({max(p, sp * s) for p in range(max_p + 1) for sp in range(max_sp + 1)})


def design(
    panel: DataFrame, max_p: int, max_sp: int = 0, s: int = 1, exog_columns: Sequence[str] = (), keys: Sequence[str] = KEYS
) -> DataFrame:
    """Target ``w`` with its regressors: lags ``ar_i`` and ``sar_k`` and the exogenous columns.

    ``tw`` counts the rows of the differenced series; a model uses ``tw > max(p, sp*s)``.
    """
    lags = {f"ar_{i}": ("w", i) for i in range(1, max_p + 1)} | {f"sar_{k}": ("w", s * k) for k in range(1, max_sp + 1)}
    return with_lags(panel, lags, keys).select(*keys, "t", "tw", "w", *exog_columns, *lags)


def linear_moments(
    rows: DataFrame, max_p: int, max_sp: int = 0, s: int = 1, exog_columns: Sequence[str] = (), keys: Sequence[str] = KEYS
) -> DataFrame:
    """Moment matrices of a design by row class, gathered to one row per series.

    All AR candidates of a series are sub-matrices of the sums over the classes
    their first row admits, so one scan serves every candidate.  Where ``rows`` has a column
    ``centre`` (one value a series), target and lags are measured from it, which keeps the sums of a high level exact.
    """
    centred = "centre" in rows.columns
    shift = F.col("centre") if centred else F.lit(0.0)
    own = {"w", *[f"ar_{i}" for i in range(1, max_p + 1)], *[f"sar_{k}" for k in range(1, max_sp + 1)]}
    value = lambda c: F.col(c) - shift if centred and c in own else F.col(c)
    starts = _first_rows(max_p, max_sp, s)
    label = F.lit(0)
    for i, start in enumerate(starts):
        label = F.when(F.col("tw") > start, i).otherwise(label)
    columns = ["w", *exog_columns, *[f"ar_{i}" for i in range(1, max_p + 1)], *[f"sar_{k}" for k in range(1, max_sp + 1)]]
    sums = rows.groupBy(*keys, label.alias("served")).agg(
        moment_array([value("w"), F.lit(1.0), *[value(c) for c in columns[1:]]]).alias("gram"), F.count(F.lit(1)).alias("rows"), F.max(shift).alias("centre")
    )
    return sums.groupBy(*keys).agg(F.collect_list(F.struct("served", "gram", "rows")).alias("moments"), F.max("centre").alias("centre"))


def fit_linear(
    moments: DataFrame, spec: DataFrame, max_p: int, max_sp: int = 0, s: int = 1, exog: int = 0, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Exact least squares of specifications without MA terms, within the bounds -1..1.

    With ``objective = 'elastic_net'`` the penalty of the row is applied to the same moments.
    """
    starts = _first_rows(max_p, max_sp, s)
    layout = Layout(exog, max_p, max_sp, 0, 0, s)
    size = layout.linear + 1

    @F.pandas_udf(FIT_FIELDS)
    def solve(moments_: pd.Series, centre: pd.Series, p: pd.Series, sp: pd.Series, mean: pd.Series, drift: pd.Series, lam: pd.Series, alpha: pd.Series) -> pd.DataFrame:
        out = []
        for parts, level, p_, sp_, m_, dr_, l_, a_ in zip(moments_, centre, p, sp, mean, drift, lam, alpha):
            first = starts.index(max(p_, sp_ * s))
            upper = np.zeros(size * (size + 1) // 2)
            n = total = 0
            for part in parts:
                total += part["rows"]
                if part["served"] >= first:
                    upper += np.asarray(part["gram"], dtype=float)
                    n += part["rows"]
            G = full_matrix(upper, size)
            orders = (p_, 0, sp_, 0, int(m_ or dr_))
            used = np.flatnonzero(layout.mask(np.array([orders]))[0])
            at = used + 1
            penal = 0.0 if l_ is None or np.isnan(l_) else float(l_)
            apart = level and (not orders[4] or penal)
            if apart:
                # no free constant takes up the centre: back to the sums of the values themselves
                back = np.eye(size)
                back[[0, *range(2 + exog, size)], 1] = level
                G = back @ G @ back.T
            low = np.where(used > exog, -1.0, -np.inf)
            b = np.zeros(layout.size)
            mix = 0.0 if a_ is None or np.isnan(a_) else float(a_)
            if penal and mix:
                b[used] = solve_penalised(G[np.ix_(at, at)], G[at, 0], low, -low, penal, mix)
            else:
                b[used] = solve_bounded(G[np.ix_(at, at)], G[at, 0], low, -low, penal)
            whole = np.concatenate([[1.0], -b])
            k = len(used) + 1
            if level and not apart:
                b[0] += level * (1.0 - b[1 + exog :].sum())
            row = _row(layout.split(b, orders), m_, dr_)
            row.update(
                sse=max(float(whole @ G @ whole), 0.0), sae=None, worst=None, n_resid=n, n_w=total, k=k, k_var=k - exog,
                bound=None, recent=[], converged=True, **{"lambda": penal if penal else None},
            )
            out.append(row)
        return pd.DataFrame(out, columns=[f.split()[0] for f in FIT_FIELDS.split(", ")])

    T = F.when(F.col("objective") == "elastic_net", F.col("lambda"))
    joined = spec.join(moments, list(keys)).withColumn("_f", solve("moments", F.coalesce("centre", F.lit(0.0)), "p", "sp", "mean", "drift", T.cast("double"), "alpha"))
    return joined.select(*[c for c in spec.columns if c != "lambda"], "_f.*")


def _row(parts: dict, mean, drift) -> dict:
    return {
        "c": float(parts["constant"]) if mean else 0.0,
        "trend": float(parts["constant"]) if drift and not mean else 0.0,
        **{name: np.asarray(parts[name], dtype=float).tolist() for name in ("ar", "ma", "sar", "sma", "beta")},
    }


# --- full candidates by group ------------------------------------------------------------------------


def differenced(
    panel: DataFrame, orders: DataFrame, s: int, exog: DataFrame | None = None, pairs: Sequence[tuple[int, int]] | None = None, ends: DataFrame | None = None
) -> DataFrame:
    """``y``, ``w`` and regressors per ``(series_id, d, sd, t)``; ``w`` is null in the first d + sd*s rows.

    ``pairs`` are the orders that may occur; without them they are read from ``orders``.  ``ends`` are the lengths
    ``n`` of the series, where they are known, and further values to carry.
    """
    pairs = order_pairs(orders) if pairs is None else pairs
    ends = lengths(panel) if ends is None else ends
    wanted = orders.select("series_id", "d", "sd").distinct().join(ends, "series_id")
    rows = attach(panel.select("series_id", "ts", "t", "y"), wanted).drop("blk")
    keys = ["series_id", "d", "sd"]
    out = difference_by_orders(rows, pairs, s, "y", "w", keys, keep_head=True).drop("blk")
    out = out.withColumn("tw", F.col("t") - F.col("d") - F.col("sd") * s)
    return out if exog is None else out.join(exog.drop("t", "blk"), ["series_id", "ts"], "left")


#: Objectives whose fit without MA terms is the least squares that the moments hold.
LINEAR_OBJECTIVES = ("mse", "ml", "bilevel", "bilevel_global")
DIFFERENCED = ["series_id", "d", "sd"]


def is_linear() -> Column:
    """Specification rows that moments settle: no MA terms and a squared objective."""
    return (F.col("q") == 0) & (F.col("sq") == 0) & F.col("objective").isin(*LINEAR_OBJECTIVES)


def series_moments(panel: DataFrame, orders: DataFrame, s: int, max_p: int, max_sp: int, pairs: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """One row per series and differencing orders with the moments of all AR candidates up to the given orders.

    Its size does not depend on the length of the series, so no candidate without MA terms reads a row again.
    """
    ends = panel.groupBy("series_id").agg(F.max("t").alias("n"), F.avg("y").alias("_level"))
    rows = differenced(panel, orders, s, None, pairs, ends).where("w IS NOT NULL")
    lags = {f"ar_{i}": ("w", i) for i in range(1, max_p + 1)} | {f"sar_{k}": ("w", s * k) for k in range(1, max_sp + 1)}
    centre = F.when(F.col("d") + F.col("sd") == 0, F.col("_level")).otherwise(0.0)
    laid = with_lags(rows.select(*DIFFERENCED, "t", "tw", "w", centre.alias("centre")), lags, DIFFERENCED)
    return linear_moments(laid, max_p, max_sp, s, keys=DIFFERENCED)


def fit_from_moments(moments: DataFrame, spec: DataFrame, max_p: int, max_sp: int, s: int) -> DataFrame:
    """Fits of linear specification rows with the columns of ``fit_packed``."""
    return fit_linear(moments, spec, max_p, max_sp, s, keys=DIFFERENCED).withColumn("n_t", F.col("n_w"))


def pack_series(
    panel: DataFrame,
    orders: DataFrame,
    s: int,
    exog: DataFrame | None = None,
    exog_columns: Sequence[str] = (),
    pairs: Sequence[tuple[int, int]] | None = None,
) -> DataFrame:
    """One row per short series and differencing: arrays ``y, w`` and ``x_<column>`` in time order.

    Only series of at most one block are packed; longer ones are fitted in blocks
    (``panelwright.operators.longfit``).
    """
    limit = block_rows(panel)
    rows = differenced(panel, orders, s, exog, pairs).where(F.col("n") <= limit)
    fields = ["t", "y", "w", *exog_columns]
    packed = rows.groupBy("series_id", "d", "sd").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_rows"))
    return packed.select(
        "series_id", "d", "sd", F.col("_rows.y").alias("y"), F.col("_rows.w").alias("w"), *[F.col(f"_rows.{c}").alias(f"x_{c}") for c in exog_columns]
    )


def fit_packed(
    packed: DataFrame, spec: DataFrame, s: int, exog_columns: Sequence[str] = (), given: bool = False, df: str = "residuals"
) -> DataFrame:
    """Fit every specification row of the packed series; one output row each.

    Work units are (series, up to 12 candidates), spread over tasks by their hash,
    so a series with many candidates does not hold up one task.
    """
    carried = [c for c in SPEC_COLUMNS if c not in ("series_id", "d", "sd")] + (GIVEN_COLUMNS if given else [])
    rank = F.row_number().over(Window.partitionBy("series_id", "d", "sd", "objective", "alpha", "lambda").orderBy("model_id"))
    units = (
        spec.withColumn("_unit", F.floor((rank - 1) / CANDIDATE_BLOCK))
        .groupBy("series_id", "d", "sd", "objective", "alpha", "lambda", "_unit")
        .agg(F.collect_list(F.struct(*[c for c in carried if c not in ("objective", "alpha", "lambda")])).alias("models"))
    )
    spark = packed.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    # a row attribute cannot be called lambda
    units = units.withColumnRenamed("lambda", "penalty")
    work = packed.join(units, ["series_id", "d", "sd"]).repartition(tasks, "series_id", "d", "sd", "objective", "_unit")
    exog_names = [f"x_{c}" for c in exog_columns]
    spec_fields = "series_id string, model_id string, p int, d int, q int, sp int, sd int, sq int, s int, mean boolean, drift boolean, objective string, alpha double"
    schema = f"{spec_fields}, {FIT_FIELDS}, n_t int"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                out += _fit_unit(row, exog_names, s, given, df)
            yield pd.DataFrame(out, columns=names)

    return work.mapInPandas(run, schema)


def _fit_unit(row, exog_names, s, given, df) -> list[dict]:
    y = np.asarray(row.y, dtype=float)
    w = np.asarray(row.w, dtype=float)
    X = np.column_stack([np.asarray(getattr(row, n), dtype=float) for n in exog_names]) if exog_names else np.zeros((len(w), 0))
    dummies = getattr(row, "dummies", None)
    if dummies is not None and len(dummies):
        marks = np.zeros((len(w), len(dummies)))
        marks[np.asarray(dummies) - 1, np.arange(len(dummies))] = 1.0
        X = np.column_stack([X, marks])
    keep = ~np.isnan(w) & ~np.isnan(X).any(axis=1)
    head = row.d + row.sd * s
    models = list(row.models)
    orders = [(m["p"], m["q"], m["sp"], m["sq"], int(m["mean"] or m["drift"])) for m in models]
    fixed = None
    if given:
        fixed = []
        for m in models:
            constant = m["c"] if m["c"] is not None else m["trend"]
            fixed.append({"constant": constant, **{n: m[n] for n in ("beta", "ar", "sar", "ma", "sma")}})
    lam = None if row_missing(row.penalty) else float(row.penalty)
    alpha = None if row_missing(row.alpha) else float(row.alpha)
    fits = fit_candidates(w[keep], y, X[keep], orders, s, row.objective, lam, alpha, fixed, df)
    out = []
    for m, f in zip(models, fits):
        lam_used = f["lam"] if np.isfinite(f["lam"]) else None
        out.append(
            {
                **{c: m[c] for c in ("model_id", "p", "q", "sp", "sq", "s", "mean", "drift")},
                "series_id": row.series_id, "d": row.d, "sd": row.sd, "objective": row.objective, "alpha": alpha,
                **_row(f, m["mean"], m["drift"]),
                **{c: f[c] for c in ("sse", "sae", "worst", "n_resid", "n_w", "k", "k_var", "recent", "converged")},
                "lambda": lam_used, "bound": f["bound"] if np.isfinite(f["bound"]) else None, "n_t": len(y) - head,
            }
        )
    return out


def row_missing(value) -> bool:
    return value is None or (isinstance(value, float) and np.isnan(value))


def fit_models(
    panel: DataFrame,
    spec: DataFrame,
    s: int = 1,
    exog: DataFrame | None = None,
    exog_columns: Sequence[str] = (),
    given: bool = False,
    auto_exog_difference: bool = False,
    df: str = "residuals",
    pairs: Sequence[tuple[int, int]] | None = None,
) -> DataFrame:
    """Fit all specification rows and score them (``with_criteria``).

    Without regressors, models that have no MA terms are solved from moments whatever the length of the series, those with
    an elastic net included (``penalty``).  Of the others, series of more than one block are fitted by block passes instead of in one task.
    """
    from panelwright.operators.longfit import fit_long
    from panelwright.operators.penalty import is_penalised, select_penalty

    if exog is not None and auto_exog_difference:
        numbered = exog if "t" in exog.columns else exog.join(panel.select("series_id", "ts", "t"), ["series_id", "ts"])
        exog, _ = auto_difference(numbered, exog_columns, s)
    pairs = order_pairs(spec) if pairs is None else pairs
    plain = exog is None and not given
    linear = is_linear() if plain else F.lit(False)
    penalised = is_penalised() if plain and df == "residuals" else F.lit(False)
    rest = ~(linear | penalised)
    # which ways are needed at all, and the orders of the designs
    ways = {"linear": linear, "penalised": penalised, "rest": rest}
    found = spec.agg(
        *[F.count(F.when(way, 1)).alias(name) for name, way in ways.items()], *[F.max(F.when(linear | penalised, F.col(c))).alias(c) for c in ("p", "sp")]
    ).first()
    parts = []
    if found["linear"] or found["penalised"]:
        max_p, max_sp = found["p"], found["sp"] if s > 1 else 0
        mine = spec.where(linear | penalised)
        moments = series_moments(panel, mine, s, max_p, max_sp, pairs)
        if found["linear"]:
            parts.append(fit_from_moments(moments, spec.where(linear), max_p, max_sp, s))
        if found["penalised"]:
            parts.append(select_penalty(panel, moments, spec.where(penalised), max_p, max_sp, s))

    if found["rest"] or not parts:
        others = spec.where(rest)
        parts.append(fit_packed(pack_series(panel, others, s, exog, exog_columns, pairs), others, s, exog_columns, given, df))
        long_fits = fit_long(panel, others, s, exog, exog_columns, given, pairs, df)
        if long_fits is not None:
            parts.append(long_fits)
    fits = parts[0]
    for part in parts[1:]:
        fits = fits.unionByName(part)
    return with_criteria(fits, s)


def with_criteria(fits: DataFrame, s: int, offset: Column | float = 0.0) -> DataFrame:
    """Add variance, likelihood, criteria, and whether the model is stationary and invertible."""
    sigma2 = F.when(F.col("objective") == "ml", F.try_divide("sse", "n_w")).otherwise(
        residual_variance(F.col("sse"), F.col("n_resid"), F.col("k_var"))
    )
    n, k, v = F.col("n_t"), F.col("k"), F.col("sigma2")
    return fits.withColumn("sigma2", sigma2).withColumns(
        {
            "loglik": log_likelihood(F.col("n_resid"), F.col("sse"), v),
            "aic": model_aic(n, k, v, offset),
            "aicc": model_aicc(n, k, v, offset),
            "bic": model_bic(n, k, v, offset),
            "stationary": stationary(full_polynomial(F.col("ar"), F.col("sar"), s)),
            "invertible": invertible(full_polynomial(F.col("ma"), F.col("sma"), s)),
        }
    )


def ic_offset(panel: DataFrame, d: int = 0, D: int = 0, s: int = 1) -> DataFrame:
    """-2 loglik - n ln(variance) of the null model (differences around their mean), per series."""
    from panelwright.operators.differencing import difference

    null = difference(panel, d, D, s).groupBy("series_id").agg(
        F.count("w").alias("rows"), F.var_pop("w").alias("_v"), F.max("t").alias("n")
    )
    sse = F.col("_v") * F.col("rows")
    sigma2 = residual_variance(sse, F.col("rows"), F.lit(2))
    return null.select("series_id", (-2.0 * log_likelihood(F.col("rows"), sse, sigma2) - F.col("n") * F.log(sigma2)).alias("offset"))


def lambda_path_panel(panel: DataFrame, k: int, steps: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Penalties per series from the largest useful one down: ``step, lambda``.

    The largest one is the greatest lagged cross-product of the centred, not
    differenced, series over lags 1..k, divided by n.
    """
    stats = panel.groupBy(*keys).agg(F.max("t").alias("n"), F.avg("y").alias("_mean"))
    centred = attach(panel.select(*keys, "t", "y"), stats, keys).withColumn("_r", F.col("y") - F.col("_mean"))
    lags = {f"_r{i}": ("_r", i) for i in range(1, k + 1)}
    products = [F.abs(F.sum(F.col("_r") * F.col(name))) for name in lags]
    top = with_lags(centred, lags, keys).where(F.col("t") > k).groupBy(*keys).agg(
        F.max("n").alias("n"), (F.greatest(*products) if k > 1 else products[0]).alias("_top")
    )
    largest = F.when(F.col("_top") / F.col("n") < np.finfo(float).eps, 1.0).otherwise(F.col("_top") / F.col("n"))
    ratio = F.when(F.col("n") > k, 1e-4).otherwise(1e-2)
    values = F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.exp(F.log(largest) + F.log(ratio) * i / float(max(steps - 1, 1)))
    )
    return top.select(*keys, F.posexplode(values).alias("step", "lambda"))


__all__ = ["lambda_path", "fit_models", "fit_packed", "pack_series", "fit_linear", "with_criteria", "specify"]
