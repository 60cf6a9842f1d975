"""In-sample residuals and fitted values of stored models.

The linear part is a projection over block-window lags.  The MA recursion is a fold over the array of a block, in
SQL functions.  It needs the residuals before the block; they are found without walking the series in one
task: every block of a long series runs from a zero start, the end states are chained over the
blocks (the recursion is linear, so the chain is exact), and the blocks run again
from their true start.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.estimate import differenced
from panelwright.operators.panel import lengths
from panelwright.plans.blocks import attach, block_rows, with_lags
from panelwright.plans.session import checkpoint

SERIES = ["series_id", "d", "sd"]
MODEL_BLOCK = ["series_id", "model_id", "blk"]


def recurse(x: np.ndarray, lags: Sequence[int], theta: Sequence[float], start: np.ndarray) -> np.ndarray:
    """out_t = x_t - sum theta_j out_{t - lag_j}; ``start`` holds earlier outputs, newest first [m, ...]."""
    m = len(start)
    out = np.zeros((m + len(x),) + x.shape[1:])
    out[:m] = start[::-1]
    for t in range(len(x)):
        value = x[t].copy() if x.ndim > 1 else x[t]
        for lag, coefficient in zip(lags, theta):
            value = value - coefficient * out[m + t - lag]
        out[m + t] = value
    return out[m:]


def end_state(out: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The newest outputs after a block, newest first, as long as ``start``."""
    m = len(start)
    return np.concatenate([start[::-1], out])[::-1][:m]


def step_matrix(lags: Sequence[int], theta: Sequence[float], m: int) -> np.ndarray:
    """One step of the homogeneous recursion on the state (newest first)."""
    M = np.zeros((m, m))
    for lag, coefficient in zip(lags, theta):
        M[0, lag - 1] -= coefficient
    if m > 1:
        M[1:, :-1] += np.eye(m - 1)
    return M


def ma_terms(row, s: int) -> tuple[list[int], list[float]]:
    ma = [] if row["ma"] is None else list(row["ma"])
    sma = [] if row["sma"] is None else list(row["sma"])
    return [*range(1, len(ma) + 1), *(s * k for k in range(1, len(sma) + 1))], [*ma, *sma]


def fitted_residuals(
    panel: DataFrame,
    fits: DataFrame,
    s: int = 1,
    exog: DataFrame | None = None,
    exog_columns: Sequence[str] = (),
    max_p: int | None = None,
    max_sp: int | None = None,
    ma: bool = True,
    pairs: Sequence[tuple[int, int]] | None = None,
) -> DataFrame:
    """``series_id, model_id, t, ts, y, y_hat, w, w_hat, resid`` for rows a model reaches.

    One-step predictions use the actual history, so undoing the differences of
    the fit amounts to ``y_hat = y - resid``.  ``ma=False`` skips the recursion
    for models without MA terms.  Outlier dummies of a search count where ``fits``
    has their positions.  The largest AR orders are measured unless they
    are given; a model above given ones fails the job.
    """
    if max_p is None or max_sp is None or pairs is None:
        fits = checkpoint(fits)  # measured and used: not fitted twice
        most = fits.agg(F.max("p"), F.max("sp")).first()
        max_p = (most[0] or 0) if max_p is None else max_p
        max_sp = (most[1] or 0) if max_sp is None else max_sp
    beyond = (F.col("p") > max_p) | ((F.col("sp") > max_sp) & F.lit(s > 1))
    fits = fits.withColumn("p", F.when(beyond, F.raise_error(F.lit(f"a model has more AR terms than {max_p} and {max_sp}")).cast("int")).otherwise(F.col("p")))
    rows = differenced(panel, fits, s, exog, pairs).where("w IS NOT NULL")
    lags = {f"_ar{i}": ("w", i) for i in range(1, max_p + 1)}
    if s > 1:
        lags |= {f"_sar{k}": ("w", s * k) for k in range(1, max_sp + 1)}
    lagged = with_lags(rows.drop("n"), lags, SERIES)
    marks = ["dummies"] if "dummies" in fits.columns else []
    models = fits.select(*SERIES, "model_id", "p", "q", "sp", "sq", "c", "trend", "ar", "sar", "ma", "sma", "beta", *marks)
    both = attach(lagged, models.join(lengths(panel), "series_id"), SERIES)
    linear = F.coalesce("c", F.lit(0.0)) + F.coalesce("trend", F.lit(0.0))
    for i in range(1, max_p + 1):
        linear = linear + F.coalesce(F.try_element_at("ar", F.lit(i)) * F.col(f"_ar{i}"), F.lit(0.0))
    for k in range(1, max_sp + 1) if s > 1 else ():
        linear = linear + F.coalesce(F.try_element_at("sar", F.lit(k)) * F.col(f"_sar{k}"), F.lit(0.0))
    for i, c in enumerate(exog_columns, 1):
        linear = linear + F.try_element_at("beta", F.lit(i)) * F.col(c)
    if marks:
        place = F.coalesce(F.array_position("dummies", F.col("t")), F.lit(0)).cast("int")
        linear = linear + F.when(place > 0, F.try_element_at("beta", place + len(exog_columns))).otherwise(0.0)
    first = F.greatest(F.col("p"), F.col("q"), F.col("sp") * s, F.col("sq") * s)
    both = both.withColumn("_u", F.when(F.col("tw") > first, F.col("w") - linear))
    if ma:
        both = _ma_recursion(both, s)
    else:
        both = both.withColumnRenamed("_u", "resid")
    return both.where("resid IS NOT NULL").select(
        "series_id", "model_id", "t", "ts", "y", (F.col("y") - F.col("resid")).alias("y_hat"), "w", (F.col("w") - F.col("resid")).alias("w_hat"), "resid"
    )


#: Steps of the recursion that are appended to one array before it is closed; longer arrays would be copied too often.
CHUNK = 128


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _run_block(u: Column, lags: Column, theta: Column, start: Column) -> Column:
    """Outputs of ``out_t = u_t - sum theta_j out_{t - lag_j}`` over the array ``u``; ``start`` holds the outputs before it, oldest first.

    A fold over chunks carries the last outputs; within a chunk a fold appends one output a step.
    """

    def step(held: Column, value: Column) -> Column:
        terms = F.zip_with(lags, theta, lambda lag, coefficient: coefficient * F.element_at(held, -lag))
        return F.concat(held, F.array(value - F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)))

    width = F.size(start)

    def closed(state: Column, grown: Column) -> Column:
        # the last outputs, then those of this chunk
        own = F.slice(grown, width + 1, F.size(grown) - width)
        return F.struct(F.slice(grown, F.size(grown) - width + 1, width).alias("tail"), F.concat(state["done"], F.array(own)).alias("done"))

    def whole(values: Column) -> Column:
        grow = lambda state, at: F.aggregate(F.slice(values, at, F.lit(CHUNK)), state["tail"], step)
        return F.aggregate(F.sequence(F.lit(1), F.size(values), F.lit(CHUNK)), empty, lambda state, at: _bound(grow(state, at), lambda grown: closed(state, grown)))

    empty = F.struct(start.alias("tail"), F.array().cast("array<array<double>>").alias("done"))
    return _bound(u, whole)


def _chained(ends: pd.Series, ma: pd.Series, sma: pd.Series, s: int, size: int) -> pd.Series:
    """States before each block after the first, oldest first, from the end states of zero starts; one short row a block."""
    out = []
    for parts, short, seasonal in zip(ends, ma, sma, strict=True):
        lags, theta = ma_terms({"ma": short, "sma": seasonal}, s)
        m = max(lags, default=0)
        whole = np.linalg.matrix_power(step_matrix(lags, theta, m), size) if m else np.zeros((0, 0))
        state, starts = np.zeros(m), []
        for end in parts:
            state = np.asarray(end["state"], dtype=float)[::-1] + whole @ state
            starts.append({"blk": int(end["blk"]) + 1, "start": state[::-1].tolist()})
        out.append(starts)
    return pd.Series(out)


def _ma_recursion(rows: DataFrame, s: int) -> DataFrame:
    """The recursion as array folds, one row per model and block; Python sees only the states between blocks of long series."""
    size = block_rows(rows)
    empty = F.array().cast("array<double>")
    line = F.struct("t", "ts", "y", "w", "_u")
    packed = rows.groupBy(*MODEL_BLOCK).agg(
        F.sort_array(F.collect_list(line)).alias("rows"), F.max("n").alias("n"), F.first("ma").alias("ma"), F.first("sma").alias("sma")
    )
    ma, sma = F.coalesce("ma", empty), F.coalesce("sma", empty)
    count = lambda values, step: F.transform(values, lambda x, i: (i + 1) * step)
    packed = packed.withColumns({"lags": F.concat(count(ma, 1), count(sma, s)), "theta": F.concat(ma, sma)})
    packed = packed.withColumn("width", F.when(F.size("lags") > 0, F.array_max("lags")).otherwise(0))
    packed = packed.withColumn("zero", F.array_repeat(F.lit(0.0), F.col("width")))
    u = F.transform("rows", lambda x: F.coalesce(x["_u"], F.lit(0.0)))
    # only series of several blocks have states to pass on
    earlier = packed.where((F.col("blk") + 1) * size < F.col("n"))
    ends = earlier.select("series_id", "model_id", "ma", "sma", F.struct("blk", _run_block(u, F.col("lags"), F.col("theta"), F.col("zero"))["tail"].alias("state")).alias("end"))
    ends = ends.groupBy("series_id", "model_id").agg(F.sort_array(F.collect_list("end")).alias("ends"), F.first("ma").alias("ma"), F.first("sma").alias("sma"))
    chain = F.pandas_udf(lambda e, a, b: _chained(e, a, b, s, size), "array<struct<blk:bigint,start:array<double>>>")
    starts = ends.select("series_id", "model_id", F.explode(chain("ends", ma, sma)).alias("_s")).select("series_id", "model_id", "_s.*")
    begun = packed.join(starts, MODEL_BLOCK, "left").withColumn("start", F.coalesce("start", "zero"))
    found = begun.select("series_id", "model_id", "rows", F.flatten(_run_block(u, F.col("lags"), F.col("theta"), F.col("start"))["done"]).alias("resid"))
    each = found.select("series_id", "model_id", F.explode(F.arrays_zip("rows", "resid")).alias("_z"))
    value = F.when(F.col("_z.rows._u").isNotNull(), F.col("_z.resid"))
    return each.select("series_id", "model_id", "_z.rows.ts", "_z.rows.t", "_z.rows.y", "_z.rows.w", value.alias("resid"))
