"""Models without MA terms from moments against the fits of the arrays."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import estimate
from panelwright.operators.kernel import fit_candidates
from panelwright.plans.blocks import BLOCK_ROWS_SETTING

ORDERS = [(0, 0), (1, 0), (3, 0), (0, 1), (2, 1)]


def level_series(n, level, seed):
    rng = np.random.default_rng(seed)
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = 0.7 * y[t - 1] + rng.normal()
    return y + level


@pytest.mark.parametrize("block", [None, "32"])
def test_moments_equal_arrays(spark, block):
    data = {"low": level_series(90, 0.0, 1), "high": level_series(120, 1e7, 2), "short": level_series(20, -300.0, 3)}
    rows = [(name, dt.date(2000, 1, 1) + dt.timedelta(days=i), i + 1, float(v)) for name, y in data.items() for i, v in enumerate(y)]
    panel = spark.createDataFrame(rows, "series_id string, ts date, t long, y double")
    if block:
        spark.conf.set(BLOCK_ROWS_SETTING, block)
    try:
        specs = None
        for d in (0, 1):
            for p, sp in ORDERS:
                for mean in (True, False):
                    spec = estimate.specify(panel, p=p, sp=sp, d=d, s=4, mean=mean)
                    specs = spec if specs is None else specs.unionByName(spec)
        fits = {(r.series_id, r.d, r.p, r.sp, r["mean"]): r for r in estimate.fit_models(panel, specs, 4, pairs=[(0, 0), (1, 0)]).collect()}
    finally:
        spark.conf.unset(BLOCK_ROWS_SETTING)
    assert len(fits) == 3 * 2 * len(ORDERS) * 2
    for (name, d, p, sp, mean), got in fits.items():
        y = data[name]
        w = np.diff(y) if d else y
        # the arrays are measured from the level, which a model with a constant does not notice
        level = y.mean() if mean and not d else 0.0
        want = fit_candidates(w - level, y, None, [(p, 0, sp, 0, int(mean))], 4)[0]
        if mean or name != "high" or d:
            assert got.sse == pytest.approx(want["sse"], rel=1e-6)
            assert [*got.ar, *got.sar] == pytest.approx([*want["ar"], *want["sar"]], abs=1e-6)
        if mean:
            assert got.c == pytest.approx(want["constant"] + level * (1 - sum(want["ar"]) - sum(want["sar"])), rel=1e-6, abs=1e-6)
        assert (got.n_resid, got.n_w, got.k, got.k_var, got.n_t) == (want["n_resid"], want["n_w"], want["k"], want["k_var"], len(w)) and got.converged


def test_linear_rows_read_no_arrays(spark):
    rows = [("a", dt.date(2000, 1, 1) + dt.timedelta(days=i), i + 1, float(v)) for i, v in enumerate(level_series(60, 5.0, 4))]
    panel = spark.createDataFrame(rows, "series_id string, ts date, t long, y double")
    spec = estimate.specify(panel, p=1)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan(estimate.fit_models(panel, spec, pairs=[(0, 0)]))
    both = spec.unionByName(estimate.specify(panel, p=1, q=1))
    mixed = estimate.fit_models(panel, both, pairs=[(0, 0)])
    assert "MapInPandas" in plan(mixed) and mixed.count() == 2
    regressed = estimate.fit_models(panel, spec, 1, panel.select("series_id", "ts", F.sin("t").alias("x1")), ["x1"], pairs=[(0, 0)])
    assert "MapInPandas" in plan(regressed)


@pytest.mark.parametrize("block", [None, "16"])
def test_residuals_with_ma_terms_by_a_loop(spark, block):
    """The array folds, over chunks and blocks, against one plain loop; no pandas groups in the plan."""
    from panelwright.operators.residuals import fitted_residuals

    n, s = 300, 4
    y = level_series(n, 2.0, 6)
    rows = [(name, dt.date(2000, 1, 1) + dt.timedelta(days=i), i + 1, float(v)) for name, k in (("a", n), ("b", 7)) for i, v in enumerate(y[:k])]
    panel = spark.createDataFrame(rows, "series_id string, ts date, t long, y double")
    models = [([0.4], [0.5, -0.2], [0.3]), ([], [0.9], []), ([0.2], [], [])]
    specs = None
    for ar, ma, sma in models:
        spec = estimate.specify(panel, p=len(ar), q=len(ma), sq=len(sma), s=s)
        values = {"c": 0.1, "trend": 0.0, "ar": ar, "ma": ma, "sar": [], "sma": sma, "beta": []}
        for name, v in values.items():
            spec = spec.withColumn(name, F.lit(v) if isinstance(v, float) else F.array(*[F.lit(x) for x in v]).cast("array<double>"))
        specs = spec if specs is None else specs.unionByName(spec)
    if block:
        spark.conf.set(BLOCK_ROWS_SETTING, block)
    try:
        found = fitted_residuals(panel, specs, s, max_p=1, max_sp=0, pairs=[(0, 0)])
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
        got = {(r.series_id, r.model_id, r.t): r.resid for r in found.collect()}
    finally:
        spark.conf.unset(BLOCK_ROWS_SETTING)
    want = {}
    for spec in specs.collect():
        w = y[: n if spec.series_id == "a" else 7]
        lags = [(i + 1, v) for i, v in enumerate(spec.ma)] + [(s * (i + 1), v) for i, v in enumerate(spec.sma)]
        e = np.zeros(len(w))
        for t in range(max(spec.p, spec.q, spec.sq * s), len(w)):
            e[t] = w[t] - 0.1 - sum(v * w[t - 1] for v in spec.ar) - sum(v * e[t - lag] for lag, v in lags if lag <= t)
            want[spec.series_id, spec.model_id, t + 1] = e[t]
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
