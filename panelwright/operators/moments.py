"""Cross-moment aggregates and the small solves on top of them.

All work that grows with the rows is one ``groupBy`` with pre-aggregation; what
reaches Python is one k x k matrix per series or model.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs(k: int) -> list[tuple[int, int]]:
    """Upper triangle of a k x k matrix, row by row."""
    return [(i, j) for i in range(k) for j in range(i, k)]


def moment_array(columns: Sequence[Column], weight: Column | None = None) -> Column:
    """Sums of all pairwise products as one array (upper triangle); nulls count as 0."""
    filled = [F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns]

    def product(i: int, j: int) -> Column:
        term = filled[i] * filled[j]
        return F.sum(term if weight is None else weight * term)

    return F.array(*[product(i, j) for i, j in pairs(len(filled))])


def full_matrix(upper: np.ndarray, k: int) -> np.ndarray:
    """Symmetric matrices [..., k, k] from upper-triangle rows [..., k(k+1)/2]."""
    out = np.empty(upper.shape[:-1] + (k, k))
    for pos, (i, j) in enumerate(pairs(k)):
        out[..., i, j] = upper[..., pos]
        out[..., j, i] = upper[..., pos]
    return out


def solve_normal(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Least-squares solution of the normal equations, scaled to unit diagonal; pseudo-inverse if singular."""
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    scaled = gram / np.outer(scale, scale)
    target = rhs / scale
    if np.linalg.cond(scaled) < 1e13:
        return np.linalg.solve(scaled, target) / scale
    return np.linalg.pinv(scaled, rcond=1e-12, hermitian=True) @ target / scale


def solve_bounded(
    gram: np.ndarray,
    rhs: np.ndarray,
    lower: np.ndarray,
    upper: np.ndarray,
    lam: float = 0.0,
    alpha: float = 0.0,
    rounds: int = 5000,
    tol: float = 1e-11,
) -> np.ndarray:
    """Minimise b'Gb - 2 r'b + lam (alpha |b|_1 + (1-alpha) |b|^2) within bounds.

    The free solution is tried first; without an absolute part of the penalty the faces of the box are then searched
    for the exact solution.  Otherwise, and for matrices that are nearly singular, coordinates are minimised in turn
    until none moves.
    """
    k = len(rhs)
    if k == 0:
        return np.zeros(0)
    penalised = lam > 0 and np.isfinite(lam)
    b = solve_normal(gram, rhs)
    if not penalised and np.all(b >= lower) and np.all(b <= upper):
        return b
    if penalised and alpha == 0.0:
        ridge = np.linalg.solve(gram + lam * np.eye(k), rhs)
        if np.all(ridge >= lower) and np.all(ridge <= upper):
            return ridge
    soft = 0.5 * lam * alpha if penalised else 0.0
    ridge_add = lam * (1 - alpha) if penalised else 0.0
    if soft == 0:
        found = _on_faces(gram + ridge_add * np.eye(k), rhs, lower, upper)
        if found is not None:
            return found
    b = np.clip(b, lower, upper)
    diagonal = np.diag(gram) + ridge_add
    for _ in range(rounds):
        moved = 0.0
        for i in range(k):
            if diagonal[i] <= 0:
                continue
            r = rhs[i] - gram[i] @ b + gram[i, i] * b[i]
            new = np.sign(r) * max(abs(r) - soft, 0.0) / diagonal[i]
            new = min(max(new, lower[i]), upper[i])
            moved = max(moved, abs(new - b[i]) * np.sqrt(diagonal[i]))
            b[i] = new
        if moved <= tol * (1.0 + np.sqrt(abs(rhs @ b))):
            break
    return b if soft > 0 else _polish(gram + ridge_add * np.eye(k), rhs, lower, upper, b)


def _on_faces(gram, rhs, lower, upper):
    """Exact solution by moves from face to face of the box, each lower than the one before; None for a matrix near singular.

    Its steps depend on the number of coefficients only, not on the size of the values or how alike the columns are.
    """
    k = len(rhs)
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    if not np.isfinite(gram).all() or np.linalg.cond(gram / np.outer(scale, scale)) >= 1e13:
        return None
    b = np.clip(solve_normal(gram, rhs), lower, upper)
    low, high = b <= lower, b >= upper
    for _ in range(20 * (k + 2)):
        inner = ~(low | high)
        target = np.where(low, lower, np.where(high, upper, b))
        if inner.any():
            at = np.flatnonzero(inner)
            target[at] = solve_normal(gram[np.ix_(at, at)], rhs[at] - gram[np.ix_(at, ~inner)] @ target[~inner])
        under, over = inner & (target < lower), inner & (target > upper)
        if under.any() or over.any():
            # up to the first bound on the way
            way = np.full(k, np.inf)
            way[under] = (lower[under] - b[under]) / (target[under] - b[under])
            way[over] = (upper[over] - b[over]) / (target[over] - b[over])
            first = int(way.argmin())
            b = np.clip(b + way[first] * (target - b), lower, upper)
            low[first], high[first] = under[first], over[first]
            continue
        b = target
        slope = gram @ b - rhs
        size = np.abs(gram) @ np.abs(b) + np.abs(rhs) + 1e-300
        pull = np.where(low, -slope, np.where(high, slope, 0.0)) / size
        worst = int(pull.argmax())
        if pull[worst] <= 1e-12:
            return b
        low[worst] = high[worst] = False
    return None


def _polish(gram, rhs, lower, upper, b):
    """Exact solution on the face of the box that coordinate steps ended on."""
    near = 1e-6
    low, high = b <= lower + near, b >= upper - near
    for _ in range(2 * len(b) + 2):
        inner = ~(low | high)
        trial = np.where(low, lower, np.where(high, upper, b))
        if inner.any():
            at = np.flatnonzero(inner)
            rest = rhs[at] - gram[np.ix_(at, ~inner)] @ trial[~inner]
            trial[at] = solve_normal(gram[np.ix_(at, at)], rest)
        slope = gram @ trial - rhs
        scale = np.abs(gram) @ np.abs(trial) + np.abs(rhs) + 1e-300
        under, over = inner & (trial < lower), inner & (trial > upper)
        wrong_low = low & (slope < -1e-12 * scale)
        wrong_high = high & (slope > 1e-12 * scale)
        if not (under.any() or over.any() or wrong_low.any() or wrong_high.any()):
            return trial
        low, high = (low | under) & ~wrong_low, (high | over) & ~wrong_high
    value = lambda v: v @ gram @ v - 2 * rhs @ v
    trial = np.clip(trial, lower, upper)
    return trial if value(trial) < value(b) else b


def gram(df: DataFrame, keys: Sequence[str], columns: Sequence[Column], name: str = "gram") -> DataFrame:
    """One row per key with the moment array of ``columns`` and the row count."""
    return df.groupBy(*keys).agg(moment_array(columns).alias(name), F.count(F.lit(1)).alias("rows"))
