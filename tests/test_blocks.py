"""Series cut into several blocks give the results of one block."""

import pytest
from pyspark.sql import functions as F

from panelwright.operators import estimate, forecast, outliers, residuals, unitroot
from panelwright.operators.axis import identify_granularity
from panelwright.operators.differencing import difference, integrate
from panelwright.plans.blocks import BLOCK_ROWS_SETTING


def in_both(spark, make):
    """Sorted rows of ``make()`` with one block and with blocks of 64 rows."""
    out = []
    for rows in ("65536", "64"):
        spark.conf.set(BLOCK_ROWS_SETTING, rows)
        out.append(sorted(tuple(r) for r in make().collect()))
    spark.conf.unset(BLOCK_ROWS_SETTING)
    return out


def assert_close(pair, rel=1e-7):
    one, many = pair
    assert len(one) == len(many) and one
    for a, b in zip(one, many):
        for x, y in zip(a, b):
            assert x == (pytest.approx(y, rel=rel, abs=1e-9) if isinstance(y, (float, list)) else y)


def test_windows_and_tests(spark, series):
    assert_close(in_both(spark, lambda: difference(series, 1, 1, 12).select("series_id", "t", "w")))
    assert_close(in_both(spark, lambda: unitroot.kpss(series).select("series_id", "stat", "lags")))
    assert_close(in_both(spark, lambda: unitroot.kpss(series, "ct").select("series_id", "stat", "lags")), 1e-6)
    assert_close(in_both(spark, lambda: unitroot.ocsb(series, 12).select("series_id", "stat")))
    assert_close(in_both(spark, lambda: unitroot.seasonal_strength(series, 12)))
    assert_close(in_both(spark, lambda: unitroot.canova_hansen(series, 4).select("series_id", "stat")), 1e-6)
    assert_close(in_both(spark, lambda: identify_granularity(series).select("series_id", "granularity", "frequency", "n")))
    assert_close(in_both(spark, lambda: outliers.exact_quantiles(series.withColumnRenamed("y", "x"), [0.25, 0.75])))


@pytest.mark.parametrize("d, D", [(1, 0), (0, 1), (2, 1)])
def test_integrate_inverts_difference(series, small_blocks, d, D):
    panel = series.where("series_id IN ('air', 'log')")
    back = integrate(panel.where(F.col("t") <= d + 12 * D), difference(panel, d, D, 12), d, D, 12).withColumnRenamed("y", "z")
    both = panel.join(back, ["series_id", "t"])
    assert both.count() == panel.count()
    assert both.agg(F.max(F.abs(F.col("y") - F.col("z")))).first()[0] < 1e-5


def test_residuals_cross_blocks(spark, series):
    panel = series.where("series_id = 'log'")
    arrays = {"c": F.lit(0.05), "trend": F.lit(None).cast("double"), "ar": F.array(F.lit(0.3)), "ma": F.array(F.lit(-0.4)), "sar": F.array(), "sma": F.array(F.lit(-0.5)), "beta": F.array()}
    arrays = {k: v if k in ("c", "trend") else v.cast("array<double>") for k, v in arrays.items()}
    fits = estimate.specify(panel, 1, 0, 1, 0, 1, 1, 12).withColumns(arrays)
    assert_close(in_both(spark, lambda: residuals.fitted_residuals(panel, fits, 12).select("t", "resid")))


def test_long_series_fit(spark, series):
    panel = series.where("series_id = 'log'").coalesce(1).cache()
    spec = estimate.specify(panel, 0, 1, 1, mean=False)
    fields = ["ma", "sse", "n_resid", "recent", "aicc"]
    assert_close(in_both(spark, lambda: estimate.fit_models(panel, spec, 1).select(*fields)), 1e-5)


def test_copies_of_a_series_get_the_same_fit(spark, series):
    air = series.where("series_id = 'air'")
    panel = air.crossJoin(spark.range(3)).withColumn("series_id", F.concat("series_id", F.col("id").cast("string"))).drop("id")
    fits = estimate.fit_models(panel, estimate.specify(panel, 2, 1, 0, 0, 1, 1, 12, mean=False), 12)
    rows = {(r.sse, tuple(r.ar), tuple(r.sma)) for r in fits.collect()}
    assert len(rows) == 1


def test_scenarios_do_not_depend_on_partitions(spark, series):
    panel = series.where("series_id = 'log'").coalesce(1)
    spec = estimate.specify(panel, 1, 1, 0)
    fits = estimate.fit_models(panel, spec, 1).cache()
    axis = identify_granularity(panel)
    make = lambda: forecast.scenario_paths(fits, panel, axis, 4, scenarios=300, seed=5)
    first = sorted(tuple(r) for r in make().collect())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    second = sorted(tuple(r) for r in make().collect())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert first == second and len(first) == 1200
    point = {r.h: r for r in forecast.forecast(fits, panel, axis, 4, level=0.95, integrated=True).collect()}
    for r in make().groupBy("h").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v")).collect():
        assert r.m == pytest.approx(point[r.h]["mean"], abs=4 * (point[r.h].variance / 300) ** 0.5)
        assert r.v == pytest.approx(point[r.h].variance, rel=0.35)
