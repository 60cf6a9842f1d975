"""Least largest residuals by brute force, with their certificates, at every block size."""

import datetime as dt
import itertools

import numpy as np
import pytest

from panelwright.operators import estimate, kernel, longfit
from panelwright.operators.minimax import chebyshev
from panelwright.plans.blocks import BLOCK_ROWS_SETTING


def brute(e, J):
    """Least largest |e + J b| over the vertices: every choice of k + 1 rows and signs."""
    n, k = J.shape
    best = np.inf
    for rows in itertools.combinations(range(n), k + 1):
        for signs in itertools.product((1.0, -1.0), repeat=k):
            A = np.column_stack([J[list(rows)], -np.array([1.0, *signs])])
            if abs(np.linalg.det(A)) > 1e-9:
                best = min(best, np.abs(e + J @ np.linalg.solve(A, -e[list(rows)])[:k]).max())
    return best


@pytest.mark.parametrize("seed", range(6))
def test_small_programmes(seed):
    rng = np.random.default_rng(seed)
    for k in (1, 2, 3):
        J, e = rng.normal(size=(9, k)), rng.normal(size=9)
        if seed % 2:  # ties
            J, e = np.round(J), np.round(e)
            J[0] = 1.0 + np.arange(k)
        found = chebyshev(e, J, np.full(k, -np.inf), np.full(k, np.inf))
        assert found.settled and np.abs(e + J @ found.step).max() == pytest.approx(found.height, abs=1e-9)
        if not seed % 2:
            assert found.height == pytest.approx(brute(e, J), abs=1e-9)
        boxed = chebyshev(e, J, np.full(k, -0.05), np.full(k, 0.05))
        grid = np.array(list(itertools.product(np.linspace(-0.05, 0.05, 11), repeat=k)))
        assert np.abs(boxed.step).max() <= 0.05 + 1e-9 and boxed.height >= found.height - 1e-9
        assert boxed.height <= np.abs(e[:, None] + J @ grid.T).max(axis=0).min() + 1e-9


def test_columns_that_repeat_or_vanish():
    rng = np.random.default_rng(1)
    x, e = rng.normal(size=20), rng.normal(size=20)
    J = np.column_stack([x, x, np.zeros(20), np.ones(20)])
    found = chebyshev(e, J, np.full(4, -np.inf), np.full(4, np.inf))
    assert found.settled and np.abs(e + J @ found.step).max() == pytest.approx(found.height, abs=1e-9)
    assert found.height == pytest.approx(brute(e, J[:, [0, 3]]), abs=1e-9)
    assert chebyshev(np.zeros(0), np.zeros((0, 2)), np.zeros(2), np.zeros(2)).height == 0


@pytest.mark.parametrize("n", [30, 80, 200])
def test_location_is_the_middle_of_the_range(n):
    y = np.random.default_rng(n).normal(size=n) + 5
    fit = kernel.fit_candidates(y, y, None, [(0, 0, 0, 0, 1)], 1, "stable")[0]
    assert fit["worst"] == pytest.approx((y.max() - y.min()) / 2, rel=1e-12) and fit["constant"] == pytest.approx((y.max() + y.min()) / 2)
    assert fit["bound"] == pytest.approx(fit["worst"], rel=1e-11) and fit["converged"]


def walk(n, seed=3):
    rng = np.random.default_rng(seed)
    w = np.zeros(n)
    for t in range(1, n):
        w[t] = 0.2 + 0.6 * w[t - 1] + rng.normal()
    return w


def test_ar1_by_brute_force():
    w = walk(40)
    fit = kernel.fit_candidates(w, w, None, [(1, 0, 0, 0, 1)], 1, "stable")[0]
    assert fit["worst"] == pytest.approx(brute(w[1:], -np.column_stack([np.ones(39), w[:-1]])), rel=1e-9)
    assert fit["bound"] == pytest.approx(fit["worst"], rel=1e-9)


def test_ma1_by_a_grid():
    w = walk(120)
    fit = kernel.fit_candidates(w, w, None, [(0, 1, 0, 0, 0)], 1, "stable")[0]

    def worst(theta):
        e = np.zeros(len(w))
        for t in range(1, len(w)):
            e[t] = w[t] - theta * e[t - 1]
        return np.abs(e[1:]).max()

    assert fit["converged"] and fit["worst"] == pytest.approx(worst(fit["ma"][0]), rel=1e-9)
    near = fit["ma"][0] + np.linspace(-0.02, 0.02, 401)
    assert fit["worst"] <= min(worst(t) for t in near if -1 <= t <= 1) + 1e-9


def test_passes_over_a_model_with_ma_terms():
    """The exchange of the block fits, its passes done in one array: the same fit as the one with all rows at hand."""
    w = walk(150, 5)
    layout = kernel.Layout(0, 1, 0, 1, 0, 1)
    F, mask, valid = kernel.regressors(w, np.zeros((150, 0)), layout), np.ones((1, 3), bool), (np.arange(150) >= 1.0).astype(float)[:, None]
    start = kernel.fit_candidates(w, w, None, [(1, 1, 0, 0, 1)], 1, "mse")[0]
    b = [start["constant"], start["ar"][0], start["ma"][0]]
    row = dict.fromkeys(longfit.FIELDS) | {"b": b, "trial": b, "free": [True] * 3, "value": np.inf, "bound": 0.0, "radius": np.inf, "pool": [], "q": 1, "sq": 0, "done": False}
    for _ in range(60):
        E, J = kernel.residuals(w, F, layout, np.array([row["trial"]]), mask, valid)
        e, J = E[1:, 0], J[1:, 0]
        line = lambda i, e=e, J=J: [float(i), float(e[i]), *J[i].tolist()]
        row |= {"_top": line(int(e.argmax())), "_bottom": line(int(e.argmin())), "_watched": [line(int(x[0])) for x in row["pool"]], "_worst": float(np.abs(e).max())}
        row |= {"_recent": [], "_n_w": 150, "_sse": 0.0, "_sae": 0.0, "_n_resid": 149}
        row = longfit._exchange_row(row, layout, np.array([-np.inf, -1.0, -1.0]))
        if row["done"]:
            break
    whole = kernel.fit_candidates(w, w, None, [(1, 1, 0, 0, 1)], 1, "stable")[0]
    assert row["done"] and row["value"] == pytest.approx(whole["worst"], rel=1e-7) and row["bound"] == pytest.approx(row["value"], rel=1e-8)


@pytest.mark.parametrize("p, q", [(0, 0), (2, 0)])
def test_blocks_give_the_same_fit(spark, p, q):
    w = walk(150, 5)
    rows = [("a", dt.date(2000, 1, 1) + dt.timedelta(days=i), i + 1, float(v)) for i, v in enumerate(w)]
    panel = spark.createDataFrame(rows, "series_id string, ts date, t long, y double")
    spec = estimate.specify(panel, p=p, q=q, objective="stable")
    one = estimate.fit_models(panel, spec, pairs=[(0, 0)]).collect()[0]
    spark.conf.set(BLOCK_ROWS_SETTING, "64")
    try:
        many = estimate.fit_models(panel, spec, pairs=[(0, 0)]).collect()[0]
    finally:
        spark.conf.unset(BLOCK_ROWS_SETTING)
    assert one.converged and many.converged
    assert many.worst == pytest.approx(one.worst, rel=1e-9)
    assert many.bound == pytest.approx(many.worst, rel=1e-8) and one.bound == pytest.approx(one.worst, rel=1e-8)
    assert [many.c, *many.ar] == pytest.approx([one.c, *one.ar], abs=1e-7)
