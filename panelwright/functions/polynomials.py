"""Lag polynomials as array columns: position i of an array is the coefficient of lag i."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLES = "array<double>"


def empty() -> Column:
    return F.array().cast(DOUBLES)


def diff_coefficients(d: int, D: int, s: int) -> list[float]:
    """Coefficients of (1-B)^d (1-B^s)^D, lag 0 first."""
    if min(d, D) < 0 or s < 1:
        raise ValueError("d and D must not be negative and s must be at least 1")
    poly = [1.0]
    for step in [1] * d + [s] * D:
        longer = poly + [0.0] * step
        for i, c in enumerate(poly):
            longer[i + step] -= c
        poly = longer
    return poly


def _choose(n: Column, k: Column) -> Column:
    return F.factorial(n) / (F.factorial(k) * F.factorial(n - k))


def diff_coefficients_column(d: Column, D: Column, s: int) -> Column:
    """The same for orders held in columns (d, D as int)."""
    zero = F.lit(0.0)

    def term(k: Column, j: Column) -> Column:
        i = (k - j * s).cast("int")
        sign = F.when((i + j) % 2 == 0, 1.0).otherwise(-1.0)
        inside = (i >= 0) & (i <= d)
        return F.when(inside, sign * _choose(d, F.when(inside, i).otherwise(0)) * _choose(D, j)).otherwise(zero)

    return F.transform(
        F.sequence(F.lit(0), (d + D * s).cast("int")),
        lambda k: F.aggregate(F.sequence(F.lit(0), D.cast("int")), zero, lambda acc, j: acc + term(k, j)),
    )


def full_polynomial(short: Column, seasonal: Column, s: int) -> Column:
    """One lag vector: ``short`` at lags 1.., ``seasonal`` at s, 2s, ... (overwriting)."""
    short = F.coalesce(short, empty())
    seasonal = F.coalesce(seasonal, empty())
    size = F.greatest(F.size(short), F.size(seasonal) * s)

    def coefficient(i: Column) -> Column:
        k = F.floor(i / s).cast("int")
        at_season = (i % s == 0) & (k <= F.size(seasonal))
        return F.when(at_season, F.try_element_at(seasonal, k)).otherwise(
            F.coalesce(F.try_element_at(short, i), F.lit(0.0))
        )

    return F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), coefficient)).otherwise(empty())


def _dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: F.coalesce(a * b, F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def dot_recent(coefficients: Column, newest_first: Column) -> Column:
    """Sum of coefficient i times the i-th newest value; values before the start count as 0."""
    return _dot(coefficients, F.slice(newest_first, F.lit(1), F.greatest(F.size(coefficients), F.lit(1))))


def psi_weights(ar: Column, ma: Column, lags: int | Column) -> Column:
    """Weights of past shocks for full lag vectors ``ar`` and ``ma``: psi_1 .. psi_lags."""
    lags = F.lit(lags) if isinstance(lags, int) else lags
    ar, ma = F.coalesce(ar, empty()), F.coalesce(ma, empty())

    # the state holds psi_i .. psi_0, newest first
    def step(state: Column, i: Column) -> Column:
        own = F.coalesce(F.try_element_at(ma, i), F.lit(0.0))
        return F.concat(F.array(own + dot_recent(ar, state)), state)

    newest_first = F.aggregate(F.sequence(F.lit(1), lags), F.array(F.lit(1.0)), step)
    return F.slice(F.reverse(newest_first), F.lit(2), lags)


def roots_outside(lag_vector: Column) -> Column:
    """True if all roots of 1 - v_1 z - v_2 z^2 ... lie outside the unit circle.

    Steps the vector down one order at a time; the roots are outside exactly
    when every partial autocorrelation met on the way is below 1 in size.
    """
    vector = F.coalesce(lag_vector, empty())
    start = F.struct(vector.alias("v"), F.lit(True).alias("ok"))

    def step_down(state: Column, _: Column) -> Column:
        v = state["v"]
        r = F.element_at(v, -1)
        ok = state["ok"] & (F.abs(r) < 1.0)
        rest = F.slice(v, F.lit(1), F.size(v) - 1)
        lower = F.zip_with(rest, F.reverse(rest), lambda a, b: (a + r * b) / (1.0 - r * r))
        return F.struct(F.when(ok, lower).otherwise(rest).alias("v"), ok.alias("ok"))

    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(vector), F.lit(1))), start, step_down)
    return F.when(F.size(vector) == 0, True).otherwise(walked["ok"])


def stationary(ar: Column) -> Column:
    return roots_outside(ar)


def invertible(ma: Column) -> Column:
    return roots_outside(F.transform(F.coalesce(ma, empty()), lambda x: -x))
