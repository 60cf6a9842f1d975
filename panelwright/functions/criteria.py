"""Information criteria, likelihood and forecast-interval expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def aic(k: Column, loglik: Column) -> Column:
    return 2.0 * k - 2.0 * loglik


def _correction(n: Column, k: Column) -> Column:
    return F.try_divide((2.0 * k * k + 2.0 * k), (n - k - 1).cast("double"))


def aicc(n: Column, k: Column, loglik: Column) -> Column:
    return aic(k, loglik) + _correction(n, k)


def bic(n: Column, k: Column, loglik: Column) -> Column:
    return F.log(n.cast("double")) * k - 2.0 * loglik


def model_aic(n: Column, k: Column, sigma2: Column, offset: Column | float = 0.0) -> Column:
    """Criterion of a fitted model; ``n`` counts the differenced rows."""
    return 2.0 * k + n * F.log(sigma2) + offset


def model_aicc(n: Column, k: Column, sigma2: Column, offset: Column | float = 0.0) -> Column:
    return model_aic(n, k, sigma2, offset) + _correction(n, k)


def model_bic(n: Column, k: Column, sigma2: Column, offset: Column | float = 0.0) -> Column:
    return model_aic(n, k, sigma2, offset) + k * (F.log(n.cast("double")) - 2.0)


MODEL_CRITERIA = {"aic": model_aic, "aicc": model_aicc, "bic": model_bic}


def model_criterion(name: str):
    """The criterion function of that name."""
    if name not in MODEL_CRITERIA:
        raise ValueError(f"the information criterion {name!r} is not one of {sorted(MODEL_CRITERIA)}")
    return MODEL_CRITERIA[name]


def log_likelihood(n: Column, sse: Column, sigma2: Column) -> Column:
    """Normal log-likelihood of ``n`` residuals with sum of squares ``sse``."""
    return -0.5 * (n * math.log(2 * math.pi) + n * F.log(sigma2) + F.try_divide(sse, sigma2))


def residual_variance(sse: Column, n: Column, k: Column) -> Column:
    return F.try_divide(sse, (n - k + 1).cast("double"))


def normal_quantile(level: float) -> float:
    """Two-sided multiplier of an interval that covers ``level``."""
    return NormalDist().inv_cdf(1 - (1 - level) / 2)
