"""Row-wise and per-series basics: ranges, splits, transforms, specification checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.plans.blocks import KEYS, attach

OBJECTIVES = ("mae", "mse", "ml", "bilevel", "bilevel_global", "elastic_net", "stable")
INTEGRATION_TESTS = ("kpss",)
SEASONAL_TESTS = ("seas", "ch", "ocsb")
CRITERIA = ("aic", "aicc", "bic")
SEARCHES = ("stepwise", "stepwiseNaive", "grid")


def time_range(panel: DataFrame, start=None, end=None) -> DataFrame:
    """Rows from ``start`` to ``end``, both included."""
    if start is not None:
        panel = panel.where(F.col("ts") >= F.lit(start))
    if end is not None:
        panel = panel.where(F.col("ts") <= F.lit(end))
    return panel


def lengths(panel: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows per series, taken from the last position."""
    return panel.groupBy(*keys).agg(F.max("t").alias("n"))


def split_train_test(panel: DataFrame, frac: float = 0.8, keys: Sequence[str] = KEYS) -> DataFrame:
    """Flag the first floor(frac * n) rows of every series as training rows."""
    if not 0 <= frac <= 1:
        raise ValueError("frac must lie between 0 and 1")
    split = attach(panel, lengths(panel, keys), keys).withColumn("is_train", F.col("t") <= F.floor(F.col("n") * frac))
    return split.drop("n", "blk")


def transform(panel: DataFrame, how: str, value: str = "y") -> DataFrame:
    """Element-wise ``log`` before modelling and ``exp`` after it."""
    functions = {"log": F.log, "exp": F.exp}
    if how not in functions:
        raise ValueError(f"transform must be one of {sorted(functions)}")
    return panel.withColumn(value, functions[how](value))


def is_constant(panel: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """True for a series in which any of ``columns`` has exactly one distinct value."""
    constant = [F.coalesce(F.min(c) == F.max(c), F.lit(False)) for c in columns]
    any_constant = constant[0]
    for c in constant[1:]:
        any_constant = any_constant | c
    return panel.groupBy(*keys).agg(any_constant.alias("is_constant"))


def check_settings(
    objective: str = "mse",
    criterion: str = "aicc",
    test: str = "kpss",
    seasonal_test: str = "ocsb",
    search: str = "stepwise",
    s: int = 1,
    lam: float | None = None,
    alpha: float | None = None,
    bounds: Sequence[int] = (),
) -> None:
    """Reject settings of a whole call before any job starts."""
    for name, value, allowed in (
        ("objective", objective, OBJECTIVES),
        ("criterion", criterion, CRITERIA),
        ("test", test, INTEGRATION_TESTS),
        ("seasonal_test", seasonal_test, SEASONAL_TESTS),
        ("search", search, SEARCHES),
    ):
        if value not in allowed:
            raise ValueError(f"{name} {value!r} is not one of {allowed}")
    if s < 1:
        raise ValueError("s must be at least 1")
    if lam is not None and lam < 0:
        raise ValueError("lambda must not be negative")
    if alpha is not None and not 0 <= alpha <= 1:
        raise ValueError("alpha must lie between 0 and 1")
    if any(b < 0 for b in bounds):
        raise ValueError("order bounds must not be negative")


def validate_spec(spec: DataFrame, exog_columns: int = 0, given: bool = False) -> DataFrame:
    """Add ``error``: null for a usable row, else the first rule it breaks.

    With ``given`` the row also carries coefficient arrays ``ar, ma, sar, sma, beta``.
    """
    c = F.col
    rules: list[tuple[Column, str]] = [
        (F.least("p", "d", "q", "sp", "sd", "sq") < 0, "orders must not be negative"),
        (c("s") < 1, "s must be at least 1"),
        ((c("sp") + c("sq") > 0) & (c("s") == 1), "seasonal coefficients need s > 1"),
        (c("lambda") < 0, "lambda must not be negative"),
        ((c("alpha") < 0) | (c("alpha") > 1), "alpha must lie between 0 and 1"),
        ((c("objective") == "elastic_net") & c("alpha").isNull(), "elastic_net needs alpha"),
        (~c("objective").isin(*OBJECTIVES), "unknown objective"),
    ]
    if given:
        nothing = F.coalesce(*[c(a).cast("string") for a in ("ar", "ma", "sar", "sma")]).isNull()
        rules.append((nothing, "at least one coefficient vector must be given"))
        rules.append(
            ((c("sar").isNotNull() | c("sma").isNotNull()) & (c("s") == 1), "seasonal coefficients need s > 1")
        )
        if exog_columns == 0:
            rules.append((c("beta").isNotNull(), "regressor coefficients need regressors"))
        else:
            rules.append((F.coalesce(F.size("beta"), F.lit(0)) != exog_columns, "one coefficient per regressor is needed"))
    error = F.when(*[(rules[0][0]), rules[0][1]])
    for condition, message in rules[1:]:
        error = error.when(condition, message)
    return spec.withColumn("error", error.otherwise(F.lit(None).cast("string")))


def model_label() -> Column:
    """Text id of a specification row; the key by which searches drop duplicates."""
    return F.format_string(
        "SARIMA(%d,%d,%d)(%d,%d,%d s=%d, c=%s, drift=%s)",
        *[F.col(o) for o in ("p", "d", "q", "sp", "sd", "sq", "s")],
        F.col("mean").cast("string"),
        F.col("drift").cast("string"),
    )


def fit_status(spec: DataFrame, coef: DataFrame, fit: DataFrame, exog: bool = False) -> DataFrame:
    """Fitted exactly when residuals, in-sample fit and every needed coefficient exist."""
    on = ["series_id", "model_id"]
    joined = spec.join(coef, on, "left").join(fit.select(*on, "n_resid"), on, "left")
    needed = F.col("n_resid").isNotNull()
    for order, column in (("p", "ar"), ("q", "ma"), ("sp", "sar"), ("sq", "sma")):
        needed = needed & ((F.col(order) == 0) | F.col(column).isNotNull())
    needed = needed & (~F.col("mean") | F.col("c").isNotNull())
    if exog:
        needed = needed & F.col("beta").isNotNull()
    return joined.select(*on, F.when(needed, "fitted").otherwise("not fitted").alias("status"))
