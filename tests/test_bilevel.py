"""Global bilevel fits against a fine grid of MA coefficients, at every block size."""

import datetime as dt

import numpy as np
import pytest

from panelwright.operators import estimate, kernel, longfit

#: Seeds of made-up series on which a descent from zero ends in a local optimum.
MISSED = (32, 64, 229, 243, 288)


def made_up(seed):
    rng = np.random.default_rng(seed)
    return rng.standard_cauchy(size=14) if seed % 2 else rng.normal(size=12)


def squares(w, theta):
    """Sum of squared MA(1) residuals for every coefficient."""
    e, total = np.zeros(len(theta)), np.zeros(len(theta))
    for value in w[1:]:
        e = value - theta * e
        total += e * e
    return total


def fit(w, order, objective):
    return kernel.fit_candidates(w, w, None, [order], 4, objective)[0]


@pytest.mark.parametrize("seed", MISSED)
def test_descent_from_zero_misses_the_optimum_and_the_search_does_not(seed):
    w = made_up(seed)
    best = squares(w, np.linspace(-1, 1, 20001)).min()
    order = (0, 1, 0, 0, 0)
    assert fit(w, order, "mse")["sse"] > best * (1 + 5e-4)
    found = fit(w, order, "bilevel_global")
    assert found["sse"] <= best * (1 + 1e-12) and found["sse"] == pytest.approx(best, rel=1e-5) and found["converged"]


def test_never_above_any_point_of_a_fine_grid():
    theta = np.linspace(-1, 1, 4001)
    for seed in range(120):
        w = made_up(seed)
        assert fit(w, (0, 1, 0, 0, 0), "bilevel_global")["sse"] <= squares(w, theta).min() * (1 + 1e-9), seed


def test_two_ma_terms_with_an_inner_problem():
    rng = np.random.default_rng(5)
    w = rng.normal(size=25)
    found = fit(w, (0, 1, 0, 1, 1), "bilevel_global")
    line = np.linspace(-1, 1, 61)
    first = 4
    for a in line:
        for b in line:
            # columns of ones and of w, both filtered; the constant is solved exactly
            rows = np.zeros((len(w), 2))
            for t in range(first, len(w)):
                rows[t] = [w[t], 1.0]
                rows[t] -= a * rows[t - 1] + b * rows[t - 4]
            y, x = rows[first:].T
            assert found["sse"] <= (y @ y - (x @ y) ** 2 / (x @ x)) * (1 + 1e-9)


def test_grid_of_starts():
    free = np.array([True, True, True, False, True])
    points = kernel.start_points(free, 1)
    steps = len(kernel.STARTS)
    assert len(points) == 1 + 3 * steps + 3 * steps**2 and not points[0].any()
    assert not points[:, 2].any() and len({tuple(p) for p in points}) == len(points)
    assert len(kernel.start_points(np.array([True, False]), 1)) == 1
    points = kernel.start_points(np.array([False, True]), 0)
    # a plateau keeps all its points; a slope keeps its low end and zero
    assert len(kernel.grid_minima(points, np.zeros(len(points)))) == len(points)
    assert points[kernel.grid_minima(points, points[:, 1])][:, 1].tolist() == [0.0, min(kernel.STARTS)]


def test_given_coefficients_are_not_searched():
    w = made_up(64)
    found = kernel.fit_candidates(w, w, None, [(0, 1, 0, 0, 0)], 1, "bilevel_global", fixed=[{"ma": [0.3]}])[0]
    assert found["ma"].tolist() == [0.3] and found["sse"] == pytest.approx(squares(w, np.array([0.3]))[0])


def test_same_over_blocks(spark, small_blocks):
    rng = np.random.default_rng(3)
    noise = rng.normal(size=151)
    y = noise[1:] + 0.6 * noise[:-1]
    rows = [("a", dt.date(2000, 1, 1) + dt.timedelta(i), i + 1, float(v)) for i, v in enumerate(y)]
    # a series that a descent from zero leaves in a local optimum, among zeros that do not change its residuals
    hard = np.concatenate([np.zeros(120), made_up(64)])
    hard[120] = 0.0
    rows += [("b", dt.date(2000, 1, 1) + dt.timedelta(i), i + 1, float(v)) for i, v in enumerate(hard)]
    panel = spark.createDataFrame(rows, "series_id string, ts date, t long, y double")
    spec = estimate.specify(panel, q=1, mean=False, objective="bilevel_global")
    found = {r.series_id: r for r in longfit.fit_long(panel, spec, 1, pairs_=[(0, 0)]).collect()}
    for name, values in (("a", y), ("b", hard)):
        one = fit(values, (0, 1, 0, 0, 0), "bilevel_global")
        assert found[name].sse == pytest.approx(one["sse"], rel=1e-9) and found[name].model_id == spec.first().model_id
        assert found[name].sse <= squares(values, np.linspace(-1, 1, 4001)).min() * (1 + 1e-9) and found[name].converged
    assert found["b"].sse == pytest.approx(squares(made_up(64), np.linspace(-1, 1, 20001)).min(), rel=1e-6)
