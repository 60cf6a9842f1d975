"""The exact path of a penalised least-squares problem inside a box, on its moment matrix.

For b'Gb - 2 r'b + lam |b|_1 within bounds, the solution is piecewise linear in lam: between breakpoints the coefficients
that are neither zero nor at a bound move along one line.  Breakpoints are where one of them leaves or reaches zero or a
bound.  The path is followed down from the lam at which all are zero.  A quadratic part of the penalty is added to G.
"""

from __future__ import annotations

import numpy as np

from panelwright.operators.moments import solve_bounded, solve_normal

ZERO, FREE, BOUND = 0, 1, 2
NEAR = 1e-12


def follow(gram: np.ndarray, rhs: np.ndarray, lower: np.ndarray, upper: np.ndarray, end: float = 0.0) -> list[tuple[float, np.ndarray]]:
    """Breakpoints (lam, b) in falling order, the last one at ``end``."""
    k = len(rhs)
    b = np.zeros(k)
    slope = 2.0 * rhs
    lam = float(np.abs(slope).max(initial=0.0))
    path = [(max(lam, end), b.copy())]
    if lam <= end:
        return path
    state, sign = np.full(k, ZERO), np.zeros(k)
    first = int(np.abs(slope).argmax())
    state[first], sign[first] = FREE, np.sign(slope[first])
    just, tiny = -1, NEAR * lam
    for _ in range(20 * (k + 2) ** 2):
        free = np.flatnonzero(state == FREE)
        v = np.zeros(k)
        if len(free):
            v[free] = solve_normal(gram[np.ix_(free, free)], 0.5 * sign[free])
        turn = -2.0 * (gram @ v)
        length, what = lam - end, None
        for j in range(k):
            if state[j] == ZERO and gram[j, j] > 0:
                for s in (1.0, -1.0):
                    # s * slope rises to the falling lam
                    closing = 1.0 + s * turn[j]
                    if closing > 0:
                        at = max((lam - s * slope[j]) / closing, 0.0)
                        if at < length and not (j == just and at <= tiny):
                            length, what = at, (j, FREE, s)
            elif state[j] == FREE:
                if v[j] * sign[j] < 0 and not (j == just and b[j] == 0.0):
                    at = max(-b[j] / v[j], 0.0)
                    if at < length:
                        length, what = at, (j, ZERO, 0.0)
                limit = upper[j] if v[j] > 0 else lower[j]
                if np.isfinite(limit) and v[j] * sign[j] > 0:
                    at = max((limit - b[j]) / v[j], 0.0)
                    if at < length:
                        length, what = at, (j, BOUND, sign[j])
            elif state[j] == BOUND:
                # the pull outwards falls faster than lam
                opening = -1.0 - sign[j] * turn[j]
                if opening > 0:
                    at = max((sign[j] * slope[j] - lam) / opening, 0.0)
                    if at < length and not (j == just and at <= tiny):
                        length, what = at, (j, FREE, sign[j])
        lam -= length
        b = b + length * v
        if what is not None:
            j, state[j], sign[j] = what[0], what[1], what[2]
            just = j
            if state[j] == ZERO:
                b[j] = 0.0
            elif state[j] == BOUND:
                b[j] = upper[j] if sign[j] > 0 else lower[j]
        slope = 2.0 * (rhs - gram @ b)
        path.append((lam, b.copy()))
        if what is None:
            break
    return path


def is_optimal(gram, rhs, lower, upper, lam, b, slack: float = 1e-8) -> bool:
    """True where b meets the optimality conditions at lam, up to ``slack`` of the size of the right-hand side."""
    slope, room = 2.0 * (rhs - gram @ b), slack * (np.abs(rhs).max(initial=0.0) + lam + 1e-300)
    pull = slope - lam * np.sign(b)
    at_zero = b == 0
    high, low = ~at_zero & (b >= upper), ~at_zero & (b <= lower)
    inner = ~(at_zero | high | low)
    return bool(
        (np.abs(slope[at_zero]) <= lam + room).all() and (np.abs(pull[inner]) <= room).all() and (pull[high] >= -room).all() and (pull[low] <= room).all()
    )


def solve_penalised(gram, rhs, lower, upper, lam: float, alpha: float) -> np.ndarray:
    """Minimise b'Gb - 2 r'b + lam (alpha |b|_1 + (1-alpha) |b|^2) within bounds that hold zero."""
    whole = gram + lam * (1.0 - alpha) * np.eye(len(rhs))
    b = follow(whole, rhs, lower, upper, lam * alpha)[-1][1]
    # columns that repeat each other have no single path
    return b if is_optimal(whole, rhs, lower, upper, lam * alpha, b) else solve_bounded(gram, rhs, lower, upper, lam, alpha)
