"""Chosen orders of the known series, and the batched search against trying one move at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import search
from panelwright.operators.kernel import fit_candidates


@pytest.fixture(scope="module")
def air(published):
    return published.where("series_id = 'air'").coalesce(1)


def test_grid(air):
    best = search.auto_sarima(air, 12, search="grid").collect()[0]
    assert (best.p, best.d, best.q, best.sp, best.sd, best.sq) == (4, 1, 0, 0, 1, 1)


def test_naive(air):
    best = search.auto_sarima(air, 12, search="stepwiseNaive").collect()[0]
    assert (best.p, best.d, best.q, best.sp, best.sd, best.sq) == (2, 1, 0, 0, 1, 1)


def _lag_poly(short, seasonal, s):
    size = max(len(short), len(seasonal) * s)
    out = np.zeros(size)
    out[: len(short)] = short
    for k, v in enumerate(seasonal, 1):
        out[s * k - 1] = v
    return out


def _outside(v):
    if not len(v) or not np.any(v):
        return True
    v = np.trim_zeros(v, "b")
    companion = np.zeros((len(v), len(v)))
    companion[0] = v
    companion[1:, :-1] += np.eye(len(v) - 1)
    return np.abs(np.linalg.eigvals(companion)).max() < 1


def one_at_a_time(y, d, D, s, bounds=(5, 5, 2, 2), limit=94):
    """The same search written as a sequential loop for one series without a constant."""
    w = y
    for _ in range(D):
        w = w[s:] - w[:-s]
    for _ in range(d):
        w = np.diff(w)
    seen = {}

    def fit(o):
        f = fit_candidates(w, y, None, [(*o, 0)], s)[0]
        k, n = f["k"], len(w)
        ic = 2 * k + n * np.log(f["sse"] / (f["n_resid"] - k + 1)) + (2 * k * k + 2 * k) / (n - k - 1)
        ok = _outside(_lag_poly(f["ar"], f["sar"], s)) and _outside(-_lag_poly(f["ma"], f["sma"], s))
        seen[o] = ic
        return ic, ok

    centre = (2, 2, 1, 1)
    ic1, ok1 = fit(centre)
    ic2, _ = fit((0, 0, 0, 0))
    best, best_ic = (centre, ic1) if ok1 else ((0, 0, 0, 0), ic2)
    if best_ic > ic2:
        best = centre = (0, 0, 0, 0)
        best_ic = ic2
    for o in ((1, 0, 1, 0), (0, 1, 0, 1)):
        ic, ok = fit(o)
        if ok and ic < best_ic:
            best = centre = o
            best_ic = ic
    k = 4
    moving = True
    while moving and k < limit:
        moving = False
        for move in search.MOVES[:-1]:
            o = tuple(a + b for a, b in zip(centre, move))
            if o in seen or any(v < 0 or v > m for v, m in zip(o, bounds)):
                continue
            k += 1
            ic, ok = fit(o)
            if ok and ic < best_ic:
                best = centre = o
                best_ic = ic
                moving = True
                break
    return best, len(seen)


def test_stepwise_equals_one_at_a_time(air):
    y = np.array([r.y for r in air.orderBy("t").collect()])
    chosen = search.auto_sarima(air, 12).collect()[0]
    assert (chosen.d, chosen.sd) == (1, 1)
    assert (chosen.p, chosen.q, chosen.sp, chosen.sq) == one_at_a_time(y, 1, 1, 12)[0] == (2, 0, 0, 1)


def test_constant_series(spark):
    import datetime as dt

    rows = [("flat", dt.date(2019, 1, i), i, 1.0) for i in range(1, 32)] + [("line", dt.date(2019, 1, i), i, 2.0 * i) for i in range(1, 32)]
    panel = spark.createDataFrame(rows, "series_id string, ts date, t long, y double")
    got = {r.series_id: r for r in search.auto_sarima(panel).collect()}
    assert (got["flat"].p, got["flat"].d, got["flat"].q) == (0, 0, 0) and got["flat"].c == pytest.approx(1.0)
    assert (got["line"].p, got["line"].d, got["line"].q) == (0, 1, 0) and got["line"].c == pytest.approx(2.0)


def test_regressor_lowers_an_order(series):
    log = series.where("series_id = 'log'").coalesce(1)
    exog = log.select("series_id", "ts", (F.col("t") * 0.5).alias("x1"))
    plain = search.select_orders(log, 12).collect()[0]
    with_exog = search.select_orders(log, 12, exog=exog, exog_columns=["x1"]).collect()[0]
    assert (plain.d, plain.sd) == (1, 0)
    assert (with_exog.d, with_exog.sd) == (0, 0)


def test_stepwise_of_a_made_up_series_equals_one_at_a_time(series):
    """Default moves over a seasonal series without a constant, and the mark of a search that met its limit."""
    panel = series.where("series_id = 'air' AND t <= 72").coalesce(1)
    y = np.array([r.y for r in panel.orderBy("t").collect()])
    limits = dict(d=1, D=1, max_p=2, max_q=2, max_sp=1, max_sq=1, mean=False, drift=False)
    chosen = search.auto_sarima(panel, 12, **limits).collect()[0]
    found, models = one_at_a_time(y, 1, 1, 12, (2, 2, 1, 1))
    assert (chosen.p, chosen.q, chosen.sp, chosen.sq) == found and chosen.stopped_at == search.ENDED and chosen.converged
    few = search.auto_sarima(panel, 12, **limits, max_models=5).collect()[0]
    assert (few.p, few.q, few.sp, few.sq) == one_at_a_time(y, 1, 1, 12, (2, 2, 1, 1), 5)[0] and few.stopped_at == search.AT_MODELS and models > 5


def test_rounds_of_the_naive_search_are_marked(series):
    panel = series.where("series_id = 'air' AND t <= 60").coalesce(1)
    one = search.auto_sarima(panel, d=1, max_p=3, max_q=0, mean=False, drift=False, search="stepwiseNaive").collect()[0]
    every = search.auto_sarima(panel, d=1, max_p=3, max_q=0, mean=False, drift=False, search="grid").collect()[0]
    assert one.stopped_at == every.stopped_at == search.ENDED and one.ic >= every.ic
    none = search.auto_sarima(panel, d=1, max_p=3, max_q=0, mean=False, drift=False, search="stepwiseNaive", max_rounds=0).collect()[0]
    assert none.stopped_at == search.AT_ROUNDS and none.p in (0, 1, 2)


def test_fits_that_did_not_converge_are_not_admissible(series):
    from panelwright.operators import estimate

    panel = series.where("series_id = 'air' AND t <= 40").coalesce(1)
    spec = estimate.specify(panel, p=1)
    fits = estimate.fit_models(panel, spec, pairs=[(0, 0)])
    fitter = search.Fitter(lambda rows: fits.select(*[c for c in fits.columns if c not in ("sigma2", "loglik", "aic", "aicc", "bic", "stationary", "invertible")]).withColumn("converged", F.lit(False)), 1, "aicc", "mse", None, None, False, False)
    assert [r.admissible for r in fitter.score(spec).collect()] == [False]
