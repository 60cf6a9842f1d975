"""Forecasts, intervals and scenario paths as folds over arrays, one row per model."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.criteria import normal_quantile
from panelwright.functions.polynomials import diff_coefficients_column, dot_recent, empty, full_polynomial, psi_weights
from panelwright.operators.axis import future_steps, future_timestamps
from panelwright.operators.panel import lengths
from panelwright.plans.blocks import attach

MODEL = ["series_id", "model_id"]
#: Scenarios of a model that travel as one row.
SPAN = 50
#: Horizons up to which the shocks of a path are weighted in one expression each; longer paths are folds.
SHORT = 16


def recent_values(panel: DataFrame, reach: DataFrame) -> DataFrame:
    """The last ``reach`` values of every series, newest first; only those rows are gathered."""
    ends = reach.join(lengths(panel), "series_id")
    rows = attach(panel.select("series_id", "t", "y"), ends).where(F.col("t") > F.col("n") - F.col("reach"))
    newest_first = F.reverse(F.sort_array(F.collect_list(F.struct("t", "y"))))
    return rows.groupBy("series_id").agg(newest_first.alias("_rows")).select("series_id", F.col("_rows.y").alias("y"))


def _states(fits: DataFrame, panel: DataFrame, s: int) -> DataFrame:
    """Models with their lag vectors, difference coefficients and the recent values they need."""
    lost = F.col("d") + F.col("sd") * s
    needed = F.greatest(lost + F.greatest(F.col("p"), F.col("sp") * s), F.lit(1))
    reach = fits.groupBy("series_id").agg(F.max(needed).alias("reach"))
    models = fits.withColumns(
        {
            "_ar": full_polynomial(F.col("ar"), F.col("sar"), s),
            "_ma": full_polynomial(F.col("ma"), F.col("sma"), s),
            "_diff": diff_coefficients_column(F.col("d").cast("int"), F.col("sd").cast("int"), s),
            "_const": F.coalesce("c", F.lit(0.0)) + F.coalesce("trend", F.lit(0.0)),
        }
    ).join(recent_values(panel, reach), "series_id")
    known = F.size("y") - lost
    w = F.when(
        known > 0,
        F.transform(
            F.sequence(F.lit(1), F.greatest(known, F.lit(1))),
            lambda i: dot_recent(F.col("_diff"), F.slice("y", i, F.size("_diff"))),
        ),
    ).otherwise(empty())
    return models.withColumn("_w", w)


def _path(h: int, extra: Column, shocks: Column | None) -> Column:
    """Values of the next ``h`` steps on the original scale, in time order."""
    past = F.slice(F.col("_diff"), F.lit(2), F.greatest(F.size("_diff") - 1, F.lit(1)))
    start = F.struct(F.col("_w").alias("w"), F.coalesce(F.col("recent"), empty()).alias("e"), F.col("y").alias("y"))

    def step(state: Column, i: Column) -> Column:
        shock = F.lit(0.0) if shocks is None else F.element_at(shocks, i)
        w = F.col("_const") + dot_recent(F.col("_ar"), state["w"]) + dot_recent(F.col("_ma"), state["e"])
        w = w + F.coalesce(F.try_element_at(extra, i), F.lit(0.0)) + shock
        y = w - dot_recent(past, state["y"])
        return F.struct(
            F.concat(F.array(w), state["w"]).alias("w"),
            F.concat(F.array(shock), state["e"]).alias("e"),
            F.concat(F.array(y), state["y"]).alias("y"),
        )

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(h)), start, step)
    return F.reverse(F.slice(walked["y"], 1, h))


def exog_contributions(fits: DataFrame, axis: DataFrame, exog: DataFrame, columns: Sequence[str], h: int) -> DataFrame:
    """Array ``xb`` of regressor contributions of the next h steps, joined by timestamp.

    Missing future values of ``outlier*`` columns count as 0; any other gap fails the job.
    """
    steps = future_timestamps(axis, h).join(exog.drop("t", "blk"), ["series_id", "ts"], "left")
    filled = []
    for c in columns:
        if c.startswith("outlier"):
            filled.append(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
        else:
            missing = F.raise_error(F.concat(F.lit(f"no future value of {c} for series "), F.col("series_id")))
            filled.append(F.when(F.col(c).isNull(), missing.cast("double")).otherwise(F.col(c).cast("double")))
    rows = steps.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("h", F.array(*filled).alias("x")))).alias("_x"))
    return (
        fits.select(*MODEL, "beta")
        .join(rows, "series_id")
        .select(*MODEL, F.transform(F.col("_x.x"), lambda x: dot_recent(F.col("beta"), x)).alias("xb"))
    )


def _with_exog(states: DataFrame, xb: DataFrame | None) -> DataFrame:
    return states.withColumn("xb", empty()) if xb is None else states.join(xb, MODEL)


def _convolved_ar() -> Column:
    """AR lag vector of the model on the original scale: AR polynomial times difference polynomial."""
    whole = F.concat(F.array(F.lit(1.0)), F.transform(F.col("_ar"), lambda a: -a))
    size = F.size(whole) + F.size("_diff") - 1

    def coefficient(k: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), k),
            F.lit(0.0),
            lambda acc, i: acc
            + F.coalesce(F.try_element_at(whole, i), F.lit(0.0)) * F.coalesce(F.try_element_at(F.col("_diff"), k - i + 1), F.lit(0.0)),
        )

    return F.when(size > 1, F.transform(F.sequence(F.lit(2), F.greatest(size, F.lit(2))), lambda k: -coefficient(k))).otherwise(empty())


def forecast_variance(h: int, s: int, integrated: bool = False) -> Column:
    """Array of forecast variances for steps 1..h of a model row with ``_ar, _ma, sigma2``.

    The weights belong to the differenced scale, so by default intervals do not
    widen through integration; ``integrated`` uses the original scale instead.
    """
    psi = psi_weights(_convolved_ar() if integrated else F.col("_ar"), F.col("_ma"), max(h - 1, 1))
    squares = F.transform(F.sequence(F.lit(1), F.lit(h)), lambda i: F.col("sigma2") * (1.0 + F.aggregate(F.filter(psi, lambda _, j: j < i - 1), F.lit(0.0), lambda a, v: a + v * v)))
    return squares


def forecast(
    fits: DataFrame,
    panel: DataFrame,
    axis: DataFrame,
    h: int,
    s: int = 1,
    level: float | None = None,
    xb: DataFrame | None = None,
    integrated: bool = False,
) -> DataFrame:
    """The next ``h`` values per model with timestamps; with ``level`` also variance and interval."""
    states = _with_exog(_states(fits, panel, s), xb)
    fields = [_path(h, F.col("xb"), None).alias("mean")]
    if level is not None:
        fields.append(forecast_variance(h, s, integrated).alias("variance"))
    arrays = states.select(*MODEL, F.arrays_zip(*fields).alias("_steps"))
    rows = arrays.select(*MODEL, F.posexplode("_steps").alias("_at", "_step")).select(*MODEL, (F.col("_at") + 1).alias("h"), "_step.*")
    if level is not None:
        margin = normal_quantile(level) * F.sqrt("variance")
        rows = rows.withColumns({"lower": F.col("mean") - margin, "upper": F.col("mean") + margin})
    return rows.join(future_timestamps(axis, h), ["series_id", "h"])


def shock(seed: int, h: Column) -> Column:
    """Standard normal draw that depends only on seed, series, scenario and step."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("series_id"), F.col("scenario").cast("string"), h.cast("string")))
    uniform = lambda at: (F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.sqrt(-2.0 * F.log(uniform(1))) * F.cos(2.0 * math.pi * uniform(9))


def scenario_paths(
    fits: DataFrame, panel: DataFrame, axis: DataFrame, h: int, s: int = 1, scenarios: int = 200, seed: int = 1234, xb: DataFrame | None = None
) -> DataFrame:
    """Sample paths of every model: normal shocks enter the value and the MA terms.

    Draws come from a hash, so the rows are the same under any partitioning.
    """
    kind = axis.schema["end_ts"].dataType.simpleString()
    states = _with_exog(_states(fits, panel, s), xb).join(axis.select("series_id", future_steps(axis, h).cast(f"array<{kind}>").alias("_ts")), "series_id")
    spark = panel.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    steps = range(1, h + 1)
    if h <= SHORT:
        # the model is linear: a path is the forecast plus the shocks so far, each by the weight of its age
        weights = F.concat(F.array(F.lit(1.0)), psi_weights(_convolved_ar(), F.col("_ma"), max(h - 1, 1)))
        states = states.select("*", _path(h, F.col("xb"), None).alias("_mean"), weights.alias("_psi")).select(*MODEL, "sigma2", "_ts", "_mean", "_psi")
    spans = states.withColumn("_from", F.explode(F.sequence(F.lit(1), F.lit(scenarios), F.lit(SPAN)))).repartition(tasks, *MODEL, "_from")
    drawn = spans.withColumn("scenario", F.explode(F.sequence("_from", F.least(F.col("_from") + (SPAN - 1), F.lit(scenarios)))))
    if h <= SHORT:
        drawn = drawn.withColumns({f"_z{i}": F.sqrt("sigma2") * shock(seed, F.lit(i)) for i in steps})

        def value(i: int) -> Column:
            total = F.col("_mean")[i - 1]
            for j in range(1, i + 1):
                total = total + F.col("_psi")[i - j] * F.col(f"_z{j}")
            return total

        rows = F.array(*[F.struct(F.lit(i).alias("h"), value(i).alias("value"), F.col("_ts")[i].alias("ts")) for i in steps])
    else:
        drawn = drawn.withColumn("_shocks", F.transform(F.sequence(F.lit(1), F.lit(h)), lambda i: F.sqrt("sigma2") * shock(seed, i)))
        zipped = F.arrays_zip(F.sequence(F.lit(1), F.lit(h)).alias("h"), _path(h, F.col("xb"), F.col("_shocks")).alias("value"), F.slice("_ts", 2, h).alias("ts"))
        rows = F.transform(zipped, lambda x: F.struct(x["h"].alias("h"), x["value"].alias("value"), x["ts"].alias("ts")))
    return drawn.select(*MODEL, "scenario", F.inline(rows)).select("series_id", "h", "model_id", "scenario", "value", "ts")


def accuracy(actual: DataFrame, predicted: DataFrame, value: str = "y", mean: str = "mean", keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Mean absolute error and mean absolute percentage error over the shared timestamps."""
    both = actual.select(*keys, "ts", value).join(predicted.select(*keys, "ts", mean), [*keys, "ts"])
    error = F.col(value) - F.col(mean)
    return both.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae"), (100.0 * F.avg(F.abs(F.try_divide(error, F.col(value))))).alias("mape")
    )
