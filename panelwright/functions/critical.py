"""Critical values and p-values of the unit-root and seasonality tests."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# P-values and the KPSS critical values at them
# (Kwiatkowski, Phillips, Schmidt and Shin 1992, table 1).
P_VALUES = [0.10, 0.05, 0.025, 0.01]
KPSS_CRITICAL = {
    "c": [0.347, 0.463, 0.574, 0.739],
    "ct": [0.119, 0.146, 0.176, 0.216],
}

# OCSB response surface, constants of the published critical-value curve.
OCSB_SCALE = -0.2937411
OCSB_LINEAR = -0.2850853
OCSB_SQUARE = -0.05983644
OCSB_CENTRE = 0.7656451
OCSB_SHIFT = -1.652202

# Canova-Hansen 5 % critical values for periods 2 to 12 and for 24, 52, 365.
CANOVA_HANSEN_CRITICAL = {
    2: 0.4617146,
    3: 0.7479655,
    4: 1.0007818,
    5: 1.2375350,
    6: 1.4625240,
    7: 1.6920200,
    8: 1.9043096,
    9: 2.1169602,
    10: 2.3268562,
    11: 2.5406922,
    12: 2.7391007,
    24: 5.098624,
    52: 10.341416,
    365: 65.44445,
}

SEASONAL_STRENGTH_LIMIT = 0.64


def kpss_critical(regression: str) -> list[float]:
    if regression not in KPSS_CRITICAL:
        raise ValueError("regression must be 'c' or 'ct'")
    return KPSS_CRITICAL[regression]


def kpss_p_value(stat: Column, regression: str = "c") -> Column:
    """Straight lines between the critical values, held at 0.10 and 0.01 outside."""
    crit = kpss_critical(regression)
    value = F.when(stat <= crit[0], P_VALUES[0])
    for i in range(len(crit) - 1):
        slope = (P_VALUES[i + 1] - P_VALUES[i]) / (crit[i + 1] - crit[i])
        value = value.when(stat <= crit[i + 1], F.lit(P_VALUES[i]) + F.lit(slope) * (stat - F.lit(crit[i])))
    return F.when(stat >= crit[-1], P_VALUES[-1]).otherwise(value)


def ocsb_critical(m: int) -> float:
    """Critical value of the OCSB test for period ``m``."""
    if m <= 1:
        raise ValueError("m must be greater than 1")
    x = math.log(m) - OCSB_CENTRE
    return OCSB_SCALE * math.exp(OCSB_LINEAR * x + OCSB_SQUARE * x * x) + OCSB_SHIFT


def canova_hansen_critical(m: int) -> float:
    return CANOVA_HANSEN_CRITICAL.get(m, 0.269 * m**0.928)
