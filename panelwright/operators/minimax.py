"""Least largest residual, exactly: an exchange of extreme residuals.

``min over b of max over t |e_t + J_t b|`` within bounds is a linear programme.  Its dual has as many equations as there are
free parameters, plus one, so a basis of that many rows (or bounds) settles the rest.  A step solves the small system of
the basis, looks for the row that is violated most, and exchanges it for the row that leaves by the ratio test.
The height of the basis is a lower bound of the largest residual of any parameters; the search ends when no
row is above it, so the two meet and the pair is its own certificate.

With MA terms the residuals are not linear.  The same programme is then solved on their linearisation within a
radius that grows and shrinks with the agreement, and the certificate is that of the last linearisation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: A fit is settled when its largest residual is within this share of the lower bound.
EXACT, SETTLED = 1e-11, 1e-9
#: Least share of the promised decrease that a linearised step has to bring.
WORTH = 0.1


@dataclass
class Solution:
    """Parameters, the height they reach on the rows that were given, and the rows that hold it."""

    step: np.ndarray
    height: float
    rows: np.ndarray
    settled: bool


def chebyshev(e: np.ndarray, J: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 2000) -> Solution:
    """Step within ``low`` .. ``high`` (0 inside, infinite ones allowed) with the least largest |e + J step|."""
    n, k = J.shape
    size = max(float(np.abs(e).max(initial=0.0)), 1e-300)
    scale = np.abs(J).max(axis=0, initial=0.0)
    scale = np.where(scale > 0, scale, 1.0)
    reach = 16.0
    while True:
        box_low, box_high = np.maximum(low * scale / size, -reach), np.minimum(high * scale / size, reach)
        found, at_box = _exchange(e / size, J / scale, box_low, box_high, rounds)
        open_ends = ((box_low > low * scale / size) & (at_box < 0)) | ((box_high < high * scale / size) & (at_box > 0))
        # the box stands in for an infinite bound: it must not be what holds the solution
        if not open_ends.any() or reach > 1e12:
            return Solution(found.step * size / scale, found.height * size, found.rows, found.settled and not open_ends.any())
        reach *= 64.0


def _exchange(e: np.ndarray, J: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int) -> tuple[Solution, np.ndarray]:
    k = J.shape[1]
    if not len(e):
        return Solution(np.zeros(k), 0.0, np.zeros(0, int), True), np.zeros(k)
    # a column of the dual: (row or -1, bound or -1, sign); rows say height - sign * (J step) >= sign * e
    first = int(np.abs(e).argmax())
    sign = 1.0 if e[first] >= 0 else -1.0
    basis: list[tuple[int, int, float]] = [(first, -1, sign)]
    weight = [1.0]
    for j in range(k):
        slope = sign * J[first, j]
        basis.append((-1, j, 1.0 if slope >= 0 else -1.0))
        weight.append(abs(slope))
    y = np.array(weight)

    def column(b: tuple[int, int, float]) -> tuple[np.ndarray, float]:
        row, bound, s = b
        out = np.zeros(k + 1)
        if row >= 0:
            out[:k], out[k] = -s * J[row], 1.0
            return out, s * e[row]
        out[bound] = s
        return out, float(low[bound] if s > 0 else -high[bound])

    pairs = [column(b) for b in basis]
    M, cost = np.stack([p[0] for p in pairs], axis=1), np.array([p[1] for p in pairs])
    settled, stalled = False, 0
    for _ in range(rounds):
        z = np.linalg.solve(M.T, cost)
        step, height = z[:k], z[k]
        r = e + J @ step
        over = np.abs(r) - height
        under = np.concatenate([low - step, step - high])
        tol = EXACT * max(1.0, abs(height))
        if stalled > 40:  # ties: any violated row leads on, and the first one cannot cycle
            at = int(np.argmax(over > tol)) if (over > tol).any() else -1
        else:
            at = int(over.argmax())
            at = at if over[at] > tol else -1
        if at >= 0:
            entering = (at, -1, 1.0 if r[at] >= 0 else -1.0)
        elif k and under.max() > 1e-9:
            j = int(under.argmax())
            entering = (-1, j % k, 1.0 if j < k else -1.0)
        else:
            settled = True
            break
        a, c = column(entering)
        d = np.linalg.solve(M, a)
        able = d > 1e-11
        if not able.any():
            break
        ratio = np.where(able, y / np.where(able, d, 1.0), np.inf)
        leaves = int(ratio.argmin())
        t = max(float(ratio[leaves]), 0.0)
        stalled = stalled + 1 if t <= 1e-13 else 0
        y = np.maximum(y - t * d, 0.0)
        y[leaves] = t
        M[:, leaves], cost[leaves], basis[leaves] = a, c, entering
    held = np.zeros(k)
    for (_, bound, s), v in zip(basis, y, strict=True):
        if bound >= 0 and v > 1e-9:
            held[bound] = -s
    rows = np.array([b[0] for b in basis if b[0] >= 0], int)
    return Solution(np.clip(step, low, high), float(height), rows, settled), held


def least_worst(
    evaluate: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], b: np.ndarray, lower: np.ndarray, upper: np.ndarray, linear: bool, rounds: int
) -> tuple[np.ndarray, float, bool]:
    """Parameters with the least largest residual, the lower bound and whether they meet.

    ``evaluate`` gives residuals and their derivatives by the parameters, all of which are free.
    """
    radius = np.inf
    e, J = evaluate(b)
    worst = float(np.abs(e).max(initial=0.0))
    best = None
    for _ in range(1 if linear else rounds):
        best = chebyshev(e, J, np.maximum(lower - b, -radius), np.minimum(upper - b, radius))
        if linear:
            return b + best.step, best.height, best.settled
        promise = worst - best.height
        if promise <= SETTLED * worst:
            return b, min(best.height, worst), best.settled
        trial = b + best.step
        new_e, new_J = evaluate(trial)
        gain = worst - float(np.abs(new_e).max(initial=0.0))
        length = float(np.abs(best.step).max(initial=0.0))
        if gain > WORTH * promise:
            b, e, J, worst = trial, new_e, new_J, worst - gain
            radius = max(radius, 2 * length) if gain > 0.75 * promise else radius
        else:
            radius = length / 4
            if radius < 1e-13:
                break
    return b, min(best.height, worst) if best else worst, False
