"""Regularisation paths and penalties chosen from moments, against conditions of optimality and fits of the arrays."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import estimate, moments
from panelwright.operators.kernel import fit_candidates
from panelwright.operators.moments import solve_bounded
from panelwright.operators.penalty import largest_penalties
from panelwright.operators.regpath import follow, is_optimal, solve_penalised
from panelwright.plans.blocks import BLOCK_ROWS_SETTING


def problem(rng, k):
    X = rng.normal(size=(15, k)) @ (np.eye(k) + 0.7 * rng.normal(size=(k, k)))
    y = X @ rng.normal(size=k) * rng.choice([0.1, 1.0, 5.0]) + rng.normal(size=15)
    return X.T @ X, X.T @ y, np.where(rng.random(k) < 0.3, -np.inf, -1.0)


@pytest.mark.parametrize("seed", range(40))
def test_path_is_optimal_at_and_between_breakpoints(seed):
    rng = np.random.default_rng(seed)
    G, r, low = problem(rng, 1 + seed % 6)
    path = follow(G, r, low, -low)
    assert path[0][0] == pytest.approx(2 * np.abs(r).max()) and path[-1][0] == 0
    for (above, b), (under, c) in zip(path, path[1:]):
        assert above >= under
        assert is_optimal(G, r, low, -low, under, c)
        assert is_optimal(G, r, low, -low, (above + under) / 2, (b + c) / 2)
    assert path[-1][1] == pytest.approx(solve_bounded(G, r, low, -low), abs=1e-6)


@pytest.mark.parametrize("alpha", [0.2, 0.5, 1.0])
def test_one_penalty_is_not_worse_than_steps_by_coordinate(alpha):
    rng = np.random.default_rng(9)
    for _ in range(50):
        G, r, low = problem(rng, 4)
        lam = float(np.exp(rng.uniform(-4, 5)))
        value = lambda b: b @ G @ b - 2 * r @ b + lam * (alpha * np.abs(b).sum() + (1 - alpha) * b @ b)  # noqa: B023, E731
        found, other = solve_penalised(G, r, low, -low, lam, alpha), solve_bounded(G, r, low, -low, lam, alpha)
        assert value(found) <= value(other) + 1e-8 * (1 + abs(value(other)))


def test_repeated_zero_and_no_columns():
    G, r = np.array([[2.0, 2.0, 0.0], [2.0, 2.0, 0.0], [0.0, 0.0, 0.0]]), np.array([3.0, 3.0, 0.0])
    low = np.full(3, -np.inf)
    b = solve_penalised(G, r, low, -low, 1.0, 1.0)
    assert is_optimal(G, r, low, -low, 1.0, b, 1e-6) and b[2] == 0
    assert len(solve_penalised(np.zeros((0, 0)), np.zeros(0), np.zeros(0), np.zeros(0), 1.0, 0.5)) == 0
    assert follow(np.eye(2), np.zeros(2), low[:2], -low[:2])[-1][1].tolist() == [0.0, 0.0]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    out = {}
    for name, n, level in (("low", 90, 0.0), ("high", 130, 40.0)):
        # no value is zero, so the arrays count no residual as zero either
        y = rng.normal(size=n)
        for t in range(2, n):
            y[t] = 0.5 * y[t - 1] + 0.3 * y[t - 2] + rng.normal()
        out[name] = y + level
    return out


@pytest.fixture(scope="module")
def panel(spark, data):
    rows = [(name, dt.date(2000, 1, 1) + dt.timedelta(days=i), i + 1, float(v)) for name, y in data.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "series_id string, ts date, t long, y double")


@pytest.mark.parametrize("block", [None, "32"])
def test_chosen_penalties_equal_those_of_the_arrays(spark, data, panel, block):
    cases = [(p, sp, d, mean, alpha, lam) for p, sp in ((0, 0), (1, 0), (2, 1)) for d in (0, 1) for mean in (True, False) for alpha in (0.0, 0.4, 1.0) for lam in (None, 3.0)]
    rows = [(name, f"{i}", p, d, 0, sp, 0, 0, 4, mean, False, "elastic_net", lam, alpha) for name in data for i, (p, sp, d, mean, alpha, lam) in enumerate(cases)]
    specs = spark.createDataFrame(rows, estimate.specify(panel).schema).coalesce(1)
    if block:
        spark.conf.set(BLOCK_ROWS_SETTING, block)
    try:
        fits = {(r.series_id, r.model_id): r for r in estimate.fit_models(panel, specs, 4, pairs=[(0, 0), (1, 0)]).collect()}
    finally:
        spark.conf.unset(BLOCK_ROWS_SETTING)
    assert len(fits) == 2 * len(cases)
    for (name, label), got in fits.items():
        p, sp, d, mean, alpha, lam = cases[int(label)]
        y = data[name]
        w = np.diff(y) if d else y
        want = fit_candidates(w, y, None, [(p, 0, sp, 0, int(mean))], 4, "elastic_net", lam, alpha)[0]
        # the last steps of a path differ by less than the arrays' descent settles, so they may stop one step apart
        step = np.log(got["lambda"] / want["lam"]) / np.log(1e-4) * 9
        assert abs(step - round(step)) < 1e-6 and abs(step) < (1.5 if lam is None else 1e-6)
        # the descent of the arrays settles early where columns are nearly the same: never below the exact solution
        want = fit_candidates(w, y, None, [(p, 0, sp, 0, int(mean))], 4, "elastic_net", got["lambda"], alpha)[0]
        value = lambda b, sse: sse + got["lambda"] * (alpha * np.abs(b).sum() + (1 - alpha) * (b @ b))  # noqa: B023, E731
        found = value(np.array([got.c, *got.ar, *got.sar]), got.sse)
        other = value(np.array([want["constant"], *want["ar"], *want["sar"]]), want["sse"])
        assert other * (1 - 1e-4) <= found <= other * (1 + 1e-9)
        assert (got.n_resid, got.n_w, got.k) == (want["n_resid"], want["n_w"], want["k"])


def test_largest_penalties_are_the_first_steps(panel):
    got = {(r.series_id, r.k): r.largest for r in largest_penalties(panel, [2, 3, 5]).collect()}
    for k in (2, 3, 5):
        for row in estimate.lambda_path_panel(panel, k).where("step = 0").collect():
            assert got[row.series_id, k] == pytest.approx(row["lambda"], rel=1e-12)


def test_bounds_are_met_without_steps_by_coordinate(monkeypatch):
    # columns nearly alike and values of any size: steps by coordinate would go on for thousands of rounds
    monkeypatch.setattr(moments, "_polish", lambda *_: pytest.fail("steps by coordinate were taken"))
    rng = np.random.RandomState(4)
    low = np.array([-np.inf, -1.0, -1.0, -1.0])
    for size in (1.0, 1e3, 1e6):
        base = rng.randn(60)
        X = np.column_stack([base + 1e-3 * rng.randn(60) for _ in range(4)]) * size
        y = X @ np.array([2.0, -3.0, 2.5, 0.3]) + size * rng.randn(60)
        G, r = X.T @ X, X.T @ y
        for lam in (0.0, 1e-6 * size**2):
            b = solve_bounded(G, r, low, -low, lam)
            whole = G + lam * np.eye(4)
            slope = (whole @ b - r) / (np.abs(whole) @ np.abs(b) + np.abs(r))
            at_low, at_high = b == low, b == -low
            assert (at_low | at_high).any() and (b >= low).all() and (b <= -low).all()
            assert np.abs(slope[~(at_low | at_high)]).max() < 1e-9 and (slope[at_low] > -1e-9).all() and (slope[at_high] < 1e-9).all()
