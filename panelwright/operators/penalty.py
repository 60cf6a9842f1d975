"""Elastic nets without MA terms: whole paths and the choice of a penalty, from the moments of a series.

Nothing here reads a row of the series more than once, and its length does not matter: a model is one small matrix.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.kernel import Layout
from panelwright.operators.moments import full_matrix
from panelwright.operators.regpath import follow
from panelwright.plans.blocks import KEYS, attach, with_lags

STEPS = 10


def is_penalised() -> Column:
    """Specification rows that moments settle although they are penalised: an elastic net without MA terms."""
    return (F.col("q") == 0) & (F.col("sq") == 0) & (F.col("objective") == "elastic_net")


def lasso_path(moments: DataFrame, spec: DataFrame, max_p: int, max_sp: int = 0, s: int = 1, exog: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """All breakpoints of the lasso (alpha = 1) of every specification row: ``step, lambda`` and the coefficients there.

    The path is exact: between two breakpoints every coefficient is a straight line in lambda.  ``moments`` come from
    ``estimate.linear_moments`` of rows without a centre.
    """
    from panelwright.operators.estimate import _first_rows, _row

    starts = _first_rows(max_p, max_sp, s)
    layout = Layout(exog, max_p, max_sp, 0, 0, s)
    size = layout.linear + 1
    fields = "lambda double, c double, trend double, ar array<double>, sar array<double>, beta array<double>"
    names = [f.split()[0] for f in fields.split(", ")]

    @F.pandas_udf(f"array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>")
    def walk(moments_: pd.Series, p: pd.Series, sp: pd.Series, mean: pd.Series, drift: pd.Series) -> pd.Series:
        out = []
        for parts, p_, sp_, m_, dr_ in zip(moments_, p, sp, mean, drift):
            first = starts.index(max(p_, sp_ * s))
            upper = np.zeros(size * (size + 1) // 2)
            for part in parts:
                if part["served"] >= first:
                    upper += np.asarray(part["gram"], dtype=float)
            G = full_matrix(upper, size)
            orders = (p_, 0, sp_, 0, int(m_ or dr_))
            used = np.flatnonzero(layout.mask(np.array([orders]))[0])
            low = np.where(used > exog, -1.0, -np.inf)
            path = []
            for lam, part_b in follow(G[np.ix_(used + 1, used + 1)], G[used + 1, 0], low, -low):
                b = np.zeros(layout.size)
                b[used] = part_b
                row = {"lambda": lam, **_row(layout.split(b, orders), m_, dr_)}
                path.append({name: row[name] for name in names})
            out.append(path)
        return pd.Series(out)

    steps = spec.drop("lambda").join(moments, list(keys)).withColumn("_path", walk("moments", "p", "sp", "mean", "drift"))
    return steps.select(*[c for c in spec.columns if c != "lambda"], F.posexplode("_path").alias("step", "_at")).select("*", "_at.*").drop("_at")


def largest_penalties(panel: DataFrame, sizes: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """``k, largest, n`` for every series and every k of ``sizes``: where the paths of models with k parameters begin.

    One scan serves all sizes; the value of one size is the first step of ``estimate.lambda_path_panel``.
    """
    stats = panel.groupBy(*keys).agg(F.max("t").alias("n"), F.avg("y").alias("_mean"))
    centred = attach(panel.select(*keys, "t", "y"), stats, keys).withColumn("_r", F.col("y") - F.col("_mean"))
    lagged = with_lags(centred, {f"_r{i}": ("_r", i) for i in range(1, max(sizes) + 1)}, keys)
    product = lambda i, k: F.abs(F.coalesce(F.sum(F.when(F.col("t") > k, F.col("_r") * F.col(f"_r{i}"))), F.lit(0.0)))
    tops = [F.struct(F.lit(k).alias("k"), F.array_max(F.array(*[product(i, k) for i in range(1, k + 1)])).alias("top")) for k in sizes]
    found = lagged.groupBy(*keys).agg(F.max("n").alias("n"), F.array(*tops).alias("_sizes"))
    rows = found.select(*keys, "n", F.explode("_sizes").alias("_size"))
    share = F.col("_size.top") / F.col("n")
    return rows.select(*keys, "n", F.col("_size.k").alias("k"), F.when(share < np.finfo(float).eps, 1.0).otherwise(share).alias("largest"))


def select_penalty(panel: DataFrame, moments: DataFrame, spec: DataFrame, max_p: int, max_sp: int, s: int, steps: int = STEPS) -> DataFrame:
    """Fits of elastic nets without MA terms; of rows without a penalty, the step of the path with the lowest BIC.

    The path starts at the largest lagged product of the series and falls in even steps of the logarithm.  Freedom is counted
    as the number of fitted rows, which is the same for all steps of a model: a residual that is zero only because the penalty
    holds every coefficient at zero counts.  A model with no parameter takes 1/sqrt(rows).
    """
    from panelwright.operators.estimate import fit_from_moments, param_count

    rows = spec.withColumns({"_k": param_count(), "alpha": F.coalesce("alpha", F.lit(0.5))})
    sizes = [r["_k"] for r in rows.where("lambda IS NULL AND _k > 1").select("_k").distinct().collect()]
    # the path of a penalty column: one value where it is given
    if sizes:
        tops = largest_penalties(panel, sorted(sizes)).withColumnsRenamed({"n": "_n", "k": "_k"})
        rows = rows.join(tops, ["series_id", "_k"], "left")
    else:
        rows = rows.withColumns({"_n": F.lit(None).cast("long"), "largest": F.lit(None).cast("double")})
    ratio = F.when(F.col("_n") > F.col("_k"), 1e-4).otherwise(1e-2)
    path = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.exp(F.log("largest") + F.log(ratio) * i / float(max(steps - 1, 1))))
    counts = moments.select("series_id", "d", "sd", F.aggregate("moments", F.lit(0).cast("long"), lambda a, m: a + m["rows"]).alias("_rows"))
    open_ = F.col("lambda").isNull() & (F.col("_k") > 1)
    values = F.when(open_, path).otherwise(F.array(F.coalesce("lambda", 1.0 / F.sqrt("_rows"))))
    tried = rows.join(counts, ["series_id", "d", "sd"]).withColumn("_values", values).select(*[c for c in spec.columns if c != "lambda"], F.posexplode("_values").alias("step", "lambda"))
    fits = fit_from_moments(moments, tried, max_p, max_sp, s)
    n = F.col("n_w")
    bic = n * F.log(F.greatest(F.col("sse") / (n - F.col("k_var") + 1), F.lit(1e-300))) + F.log(n) * F.col("n_resid")
    kept = [c for c in fits.columns if c not in ("series_id", "model_id", "step")]
    best = fits.groupBy("series_id", "model_id").agg(F.min_by(F.struct(*kept), F.struct(bic, "step")).alias("_best"))
    return best.select("series_id", "model_id", "_best.*")
