"""Outlier flags by the interquartile rule, and the dummies made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.differencing import difference
from panelwright.operators.estimate import design, fit_linear, linear_moments, specify
from panelwright.operators.panel import lengths
from panelwright.plans.blocks import KEYS, attach, count_up

SKETCH_ACCURACY = 10_000
SKETCH_MARGIN = 3.0 / SKETCH_ACCURACY


def exact_quantiles(panel: DataFrame, probabilities: Sequence[float], value: str = "x", keys: Sequence[str] = KEYS) -> DataFrame:
    """Linearly interpolated quantiles ``prob, quantile`` per series, exact at any length.

    A sketch brackets each quantile by two values; one aggregate counts what lies
    outside, and only the distinct values inside the bracket are ranked.
    """
    keys = list(keys)
    asked = [max(p - SKETCH_MARGIN, 0.0) for p in probabilities] + [min(p + SKETCH_MARGIN, 1.0) for p in probabilities]
    k = len(probabilities)
    sketch = panel.groupBy(*keys).agg(
        F.max("t").alias("n"), F.count(value).alias("rows"), F.percentile_approx(value, asked, SKETCH_ACCURACY).alias("_q")
    )
    brackets = F.array(
        *[F.struct(F.lit(p).alias("prob"), F.col("_q")[i].alias("lo"), F.col("_q")[i + k].alias("hi")) for i, p in enumerate(probabilities)]
    )
    rows = attach(panel.select(*keys, "t", value), sketch.select(*keys, "n", "rows", brackets.alias("_b")), keys).select(
        *keys, "rows", F.col(value).alias("v"), F.explode("_b").alias("_b")
    )
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    place = F.when(F.col("v") < lo, -1).when(F.col("v") > hi, 1).otherwise(0)
    # below and above the bracket only the nearest value and the count matter
    shown = F.when(place == 0, F.col("v"))
    counted = rows.groupBy(*keys, F.col("_b.prob").alias("prob"), place.alias("place"), shown.alias("shown")).agg(
        F.max("rows").alias("rows"),
        F.count(F.lit(1)).alias("c"),
        F.max("v").alias("_max"),
        F.min("v").alias("_min"),
    )
    ranked = counted.withColumn("v", F.when(F.col("place") == -1, F.col("_max")).otherwise(F.col("_min"))).withColumn(
        "last", F.sum("c").over(Window.partitionBy(*keys, "prob").orderBy("place", "v"))
    )
    position = (F.col("rows") - 1) * F.col("prob")
    first, part = F.floor(position) + 1, position - F.floor(position)

    def at(rank):
        return F.min(F.when(F.col("last") >= rank, F.col("v")))

    ends = ranked.groupBy(*keys, "prob").agg(
        at(first).alias("_lo"), at(F.least(first + 1, F.col("rows"))).alias("_hi"), F.max(part).alias("_part")
    )
    return ends.select(*keys, "prob", (F.col("_lo") + F.col("_part") * (F.col("_hi") - F.col("_lo"))).alias("quantile"))


def iqr_outliers(panel: DataFrame, k: float = 1.5, value: str = "x", method: str = "iqr", keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``is_outlier``: outside the quartiles by more than k interquartile ranges."""
    if method != "iqr":
        raise ValueError(f"the method {method!r} is not supported")
    keys = list(keys)
    quartiles = (
        exact_quantiles(panel, [0.25, 0.75], value, keys)
        .groupBy(*keys)
        .agg(F.max(F.when(F.col("prob") == 0.25, F.col("quantile"))).alias("_q1"), F.max(F.when(F.col("prob") == 0.75, F.col("quantile"))).alias("_q3"))
        .join(lengths(panel, keys), keys)
    )
    spread = F.col("_q3") - F.col("_q1")
    outside = (F.col(value) < F.col("_q1") - k * spread) | (F.col(value) > F.col("_q3") + k * spread)
    return attach(panel, quartiles, keys).withColumn("is_outlier", outside).drop("_q1", "_q3", "n", "blk")


def outlier_dummies(flags: DataFrame, lead: int = 0, first: str = "t") -> DataFrame:
    """Sparse dummies ``series_id, name, dummy_t``: one row per flagged position.

    ``lead`` rows of padding shift the position; the name keeps the unpadded one.
    """
    return flags.where("is_outlier").select(
        "series_id", F.concat(F.lit("outlier_"), F.col(first).cast("string")).alias("name"), (F.col(first) + lead).alias("dummy_t")
    )


def dense_dummies(dummies: DataFrame, axis: DataFrame, names: Sequence[str], tail: int = 0) -> DataFrame:
    """0/1 columns ``names`` over all positions of ``axis`` (series_id, n) plus ``tail`` rows."""
    start, inside = count_up(F.col("n") + (tail - 1), "_at")
    positions = axis.select("series_id", "n", start).select("series_id", "n", inside).select("series_id", (F.col("_at") + 1).alias("t"))
    hits = dummies.where(F.col("name").isin(list(names))).withColumnRenamed("dummy_t", "t")
    wide = hits.groupBy("series_id", "t").pivot("name", list(names)).agg(F.lit(1.0))
    return positions.join(wide, ["series_id", "t"], "left").fillna(0.0, list(names))


def null_residuals(
    panel: DataFrame, d: int = 0, D: int = 0, s: int = 1, exog: DataFrame | None = None, exog_columns: Sequence[str] = ()
) -> DataFrame:
    """Residuals ``x`` of the null model (mean, and regressors if given) of the differenced series."""
    lost = d + D * s
    w = difference(panel.select("series_id", "ts", "t", "y"), d, D, s)
    if exog is None:
        mean = w.groupBy("series_id").agg(F.avg("w").alias("_m"), F.max("t").alias("n"))
        rows = attach(w, mean).withColumn("x", F.col("w") - F.col("_m"))
    else:
        both = w.join(exog.drop("t", "blk"), ["series_id", "ts"]).withColumn("tw", F.col("t") - lost)
        moments = linear_moments(design(both, 0, 0, s, exog_columns), 0, 0, s, exog_columns)
        fit = fit_linear(moments, specify(panel, d=d, sd=D, s=s), 0, 0, s, len(exog_columns))
        parts = attach(both, fit.select("series_id", "c", "beta").join(lengths(panel), "series_id"))
        fitted = F.col("c")
        for i, c in enumerate(exog_columns):
            fitted = fitted + F.col("beta")[i] * F.col(c)
        rows = parts.withColumn("x", F.col("w") - fitted)
    rows = rows.withColumn("x", F.when(F.abs("x") < 1e-10, 0.0).otherwise(F.col("x")))
    return rows.select("series_id", "ts", "t", (F.col("t") - lost).alias("i"), "x")


def detect_outliers(
    panel: DataFrame,
    d: int = 0,
    D: int = 0,
    s: int = 1,
    exog: DataFrame | None = None,
    exog_columns: Sequence[str] = (),
    k: float = 1.5,
) -> DataFrame:
    """Sparse dummies ``series_id, ts, name, dummy_t`` of the null model's outlying residuals."""
    flagged = iqr_outliers(null_residuals(panel, d, D, s, exog, exog_columns), k)
    name = F.concat(F.lit("outlier_"), F.col("i").cast("string"))
    return flagged.where("is_outlier").select("series_id", "ts", name.alias("name"), F.col("t").alias("dummy_t"))
