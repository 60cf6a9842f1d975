"""Differencing and its inverse."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.polynomials import diff_coefficients
from panelwright.plans.blocks import KEYS, block_rows, lags_of_halo, running_sums, with_lags
from panelwright.sources.store import read_halo


def _lag_names(lags: Sequence[int], value: str) -> dict[str, tuple[str, int]]:
    return {f"_{value}_{k}": (value, k) for k in lags}


def _weighted(coefficients: Sequence[float], value: str) -> Column:
    terms = [F.col(f"_{value}_{k}") * F.lit(c) for k, c in enumerate(coefficients) if c]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def difference(
    panel: DataFrame, d: int = 0, D: int = 0, s: int = 1, value: str = "y", name: str = "w", keys: Sequence[str] = KEYS
) -> DataFrame:
    """(1-B)^d (1-B^s)^D of ``value`` as ``name``; the first d + D*s rows of a series drop out."""
    return _differenced(lambda lags: with_lags(panel, lags, keys), d, D, s, value, name)


def difference_stored(spark: SparkSession, table: str, d: int = 0, D: int = 0, s: int = 1, value: str = "y", name: str = "w") -> DataFrame:
    """As ``difference`` of a panel kept by ``sources.store``, whose blocks hold the rows before them: no row is shuffled."""
    return _differenced(lambda lags: lags_of_halo(read_halo(spark, table, d + D * s), lags), d, D, s, value, name)


def _differenced(lagged: Callable[[dict], DataFrame], d: int, D: int, s: int, value: str, name: str) -> DataFrame:
    coefficients = diff_coefficients(d, D, s)
    lags = _lag_names([k for k, c in enumerate(coefficients) if c], value)
    return lagged(lags).where(F.col("t") > d + D * s).withColumn(name, _weighted(coefficients, value)).drop(*lags)


def difference_by_orders(
    panel: DataFrame,
    pairs: Sequence[tuple[int, int]],
    s: int,
    value: str = "y",
    name: str = "w",
    keys: Sequence[str] = KEYS,
    keep_head: bool = False,
) -> DataFrame:
    """As ``difference`` with orders ``d, sd`` held in columns of the panel, out of ``pairs``.

    One window pass makes the lags of all pairs; each row picks its own sum, and
    orders that are not among the pairs fail the job.
    With ``keep_head`` the rows without a difference stay, with a null.
    """
    by_pair = {pair: diff_coefficients(*pair, s) for pair in pairs}
    lags = _lag_names(sorted({k for cs in by_pair.values() for k, c in enumerate(cs) if c}), value)
    unknown = F.concat(F.lit("no differencing was prepared for the orders d = "), F.col("d"), F.lit(", D = "), F.col("sd"))
    chosen = F.when(F.col("d").isNotNull() & F.col("sd").isNotNull(), F.raise_error(unknown).cast("double"))
    for (d, D), coefficients in by_pair.items():
        mine = (F.col("d") == d) & (F.col("sd") == D)
        chosen = F.when(mine, _weighted(coefficients, value)).otherwise(chosen)
    rows = with_lags(panel, lags, keys).withColumn(name, chosen).drop(*lags)
    return rows if keep_head else rows.where(F.col("t") > F.col("d") + F.col("sd") * s)


def order_pairs(orders: DataFrame) -> list[tuple[int, int]]:
    """The distinct differencing orders that occur: a handful of rows, whatever the number of series."""
    return sorted((r["d"], r["sd"]) for r in orders.select("d", "sd").distinct().collect())


def integrate(
    initial: DataFrame, diffs: DataFrame, d: int, D: int, s: int, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Undo ``difference``: ``initial`` has the first d + D*s rows (t, y), ``diffs`` the rest (t, w).

    The initial values are differenced against zeros before the start; after
    that the inverse is D running sums by season and d running sums over all rows.
    """
    keys = list(keys)
    coefficients = diff_coefficients(d, D, s)
    lags = _lag_names([k for k, c in enumerate(coefficients) if c], "y")
    head = with_lags(initial.select(*keys, "t", "y"), lags, keys).fillna(0.0, list(lags))
    rows = head.select(*keys, "t", _weighted(coefficients, "y").alias("y")).unionByName(
        diffs.select(*keys, "t", F.col("w").alias("y"))
    )
    for _ in range(D):
        # a block of one season phase spans s times as many positions
        span = block_rows(rows) * s
        rows = rows.withColumns({"_phase": F.pmod("t", F.lit(s)), "blk": F.expr(f"(t - 1) div {span}")})
        rows = running_sums(rows, {"_sum": "y"}, [*keys, "_phase"]).select(*keys, "t", F.col("_sum").alias("y"))
    for _ in range(d):
        rows = running_sums(rows.select(*keys, "t", "y"), {"_sum": "y"}, keys).select(*keys, "t", F.col("_sum").alias("y"))
    return rows


def undo_difference_one_step(
    panel: DataFrame, d: int, D: int, s: int, fitted: str = "w_hat", name: str = "y_hat", keys: Sequence[str] = KEYS
) -> DataFrame:
    """One-step predictions on the original scale; history is the actual ``y`` of the panel."""
    coefficients = diff_coefficients(d, D, s)
    lags = _lag_names([k for k, c in enumerate(coefficients) if c and k], "y")
    past = with_lags(panel, lags, keys)
    total = F.col(fitted)
    for k, c in enumerate(coefficients):
        if c and k:
            total = total - F.col(f"_y_{k}") * F.lit(c)
    return past.withColumn(name, total).drop(*lags)
