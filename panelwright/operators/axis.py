"""Time axes: step detection, future timestamps, alignment, regressor coverage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.plans.blocks import KEYS, attach, with_lags

# Seconds of the units, finest first.
UNITS = [("Second", 1), ("Minute", 60), ("Hour", 3600), ("Day", 86400), ("Week", 604800)]


def seconds_of(ts: Column, kind: T.DataType) -> Column:
    """Seconds since 1970, free of session time zone rules for zone-less types."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(ts) / 1e6
    days = F.unix_date(F.to_date(ts)) * F.lit(86400.0)
    if isinstance(kind, T.DateType):
        return days
    return days + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts).cast("double")


def identify_granularity(panel: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Step of every series: ``granularity, frequency, weekdays, start_ts, end_ts, n, ok``.

    Only the smallest and largest gap and a weekday flag are needed, so one lag
    and one aggregate decide every unit.
    """
    stamped = panel.withColumn("_sec", seconds_of(F.col("ts"), panel.schema["ts"].dataType))
    gaps = with_lags(stamped.select(*keys, "ts", "t", "_sec"), {"_before": ("_sec", 1)}, keys)
    axis = gaps.groupBy(*keys).agg(
        F.min(F.col("_sec") - F.col("_before")).alias("_lo"),
        F.max(F.col("_sec") - F.col("_before")).alias("_hi"),
        F.bool_and(F.weekday("ts") < 5).alias("_workdays"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.max("t").alias("n"),
    )
    lo, hi = F.col("_lo"), F.col("_hi")
    day, week = 86400.0, 604800.0

    def step(unit: str, frequency: Column, weekdays: bool = False) -> Column:
        return F.struct(F.lit(unit).alias("unit"), frequency.cast("double").alias("freq"), F.lit(weekdays).alias("weekdays"))

    equal = (
        F.when(lo < 1, F.lit(None))
        .when(lo < 60, step("Second", lo))
        .when(lo < 3600, step("Minute", lo / 60))
        .when(lo < day, step("Hour", lo / 3600))
        .when((lo < 7 * day) | (lo % week != 0), step("Day", lo / day))
        .otherwise(step("Week", lo / week))
    )
    uneven = F.when(hi < 1, F.lit(None))
    for unit, size in UNITS:
        if size > 1:
            uneven = uneven.when(hi < size, F.lit(None))
        if unit == "Day":
            uneven = uneven.when(F.col("_workdays") & (lo / size < 7), step("Day", F.lit(1.0), True))
        uneven = uneven.when((hi - lo) / size < 1, step(unit, F.rint(lo / size)))
    freq = F.col("_step.freq")
    weekly = F.col("_step.unit") == "Week"
    return (
        axis.withColumn("_step", F.when(lo.isNull(), F.lit(None)).when(lo == hi, equal).otherwise(uneven))
        .withColumn(
            "granularity",
            F.when(weekly & (freq % 52 == 0), "Year")
            .when(weekly & ((freq % 13 == 0) | (freq % 4 == 0)), "Month")
            .otherwise(F.col("_step.unit")),
        )
        .withColumn(
            "frequency",
            F.when(weekly & (freq % 52 == 0), freq / 52)
            .when(weekly & (freq % 13 == 0), F.lit(3.0))
            .when(weekly & (freq % 4 == 0), freq / 4)
            .otherwise(freq),
        )
        .withColumn("weekdays", F.coalesce(F.col("_step.weekdays"), F.lit(False)))
        .withColumn("ok", F.col("_step").isNotNull())
        .select(*keys, "granularity", "frequency", "weekdays", "start_ts", "end_ts", "n", "ok")
    )


def require_regular(panel: DataFrame, axis: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split the panel into regular series and a quarantine of the others.

    With ``strict`` an irregular series fails the job instead.
    """
    ok = F.col("ok")
    if strict:
        message = F.concat(F.lit("inconsistent date pattern in series "), F.col("series_id"))
        ok = F.when(ok, True).otherwise(F.raise_error(message).cast("boolean"))
    marked = attach(panel, axis.select("series_id", "n", ok.alias("_ok"))).drop("n", "blk")
    return marked.where("_ok").drop("_ok"), marked.where("NOT _ok").drop("_ok")


def future_timestamps(axis: DataFrame, h: int, last: str = "end_ts") -> DataFrame:
    """The next ``h`` timestamps after ``last``, one row each."""
    if h == 0:
        return axis.select("series_id", F.lit(0).alias("h"), F.col(last).alias("ts")).limit(0)
    kind = axis.schema[last].dataType
    return axis.select("series_id", F.posexplode(future_steps(axis, h, last)).alias("h", "ts")).where("h > 0").withColumn("ts", F.col("ts").cast(kind))


def future_steps(axis: DataFrame, h: int, last: str = "end_ts") -> Column:
    """Array of ``last`` and the ``h`` timestamps after it, one step added at a time.

    Adding step by step keeps the clamped day of a month (31 Jan, 29 Feb, 29 Mar);
    on a weekday axis a Friday is followed by the Monday.
    """
    kind = axis.schema[last].dataType
    months = F.when(F.col("granularity") == "Year", 12).otherwise(1) * F.col("frequency")
    by_month = F.col("granularity").isin("Year", "Month")
    sizes = F.coalesce(*[F.when(F.col("granularity") == unit, F.lit(float(size))) for unit, size in UNITS])
    gap = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (sizes * F.col("frequency")).cast("decimal(18,6)"))
    weekend = F.make_dt_interval(F.lit(3))
    work = "timestamp_ntz" if not isinstance(kind, T.TimestampType) else "timestamp"

    def following(ts: Column) -> Column:
        by_gap = F.when(F.col("weekdays") & (F.weekday(ts) == 4), ts + weekend).otherwise(ts + gap)
        return F.when(by_month, ts + F.make_ym_interval(F.lit(0), months.cast("int"))).otherwise(by_gap).cast(work)

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(h)),
        F.array(F.col(last).cast(work)),
        lambda acc, _: F.concat(acc, F.array(following(F.element_at(acc, -1)))),
    )


def align(frames: Sequence[DataFrame]) -> DataFrame:
    """Several tables of ``series_id, ts, columns`` side by side on their common timestamps."""
    if not frames:
        raise ValueError("align needs at least one table")
    return reduce(lambda a, b: a.join(b, ["series_id", "ts"]), [f.drop("t", "blk") for f in frames])


def join_exog(panel: DataFrame, exog: DataFrame) -> DataFrame:
    """The panel cut to the timestamps at which regressors exist."""
    return panel.join(exog.drop("t", "blk"), ["series_id", "ts"])


def validate_exog(panel_axis: DataFrame, exog_axis: DataFrame) -> DataFrame:
    """Per series: same first timestamp, regressors last long enough, same step."""
    renamed = exog_axis.select("series_id", *[F.col(c).alias(f"x_{c}") for c in exog_axis.columns if c != "series_id"])
    both = panel_axis.join(renamed, "series_id")
    same = F.lit(True)
    for c in ("granularity", "frequency", "weekdays"):
        same = same & F.col(c).eqNullSafe(F.col(f"x_{c}"))
    return both.select(
        "series_id",
        (F.col("start_ts") == F.col("x_start_ts")).alias("same_start"),
        (F.col("end_ts") <= F.col("x_end_ts")).alias("long_enough"),
        same.alias("same_step"),
    )


def exog_horizon_check(axis: DataFrame, exog: DataFrame, h: int) -> DataFrame:
    """Future timestamps for which no regressor row exists; empty when the horizon is covered."""
    return future_timestamps(axis, h).join(exog.select("series_id", "ts"), ["series_id", "ts"], "left_anti")
