"""No result depends on the block size, and no order or length is cut off silently."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import estimate, outliers, residuals, search, unitroot
from panelwright.operators.differencing import difference_by_orders
from panelwright.operators.panel import lengths
from panelwright.plans.blocks import BLOCK_ROWS_SETTING, number_rows
from panelwright.sources.series import fill_calendar, series_key

SCHEMA = "series_id string, ts date, t long, y double"


def panel_of(spark, values, name="a"):
    rows = [(name, dt.date(1990 + i // 12, i % 12 + 1, 1), i + 1, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def both_sizes(spark, make, size="64"):
    out = []
    for rows in ("65536", size):
        spark.conf.set(BLOCK_ROWS_SETTING, rows)
        out.append(make())
    spark.conf.unset(BLOCK_ROWS_SETTING)
    return out


@pytest.fixture(scope="module")
def walk():
    return np.random.RandomState(11).randn(150).cumsum()


@pytest.mark.parametrize("d, D, s", [(3, 0, 1), (0, 2, 4), (1, 2, 4)])
def test_high_orders_are_fitted(spark, walk, d, D, s):
    panel = panel_of(spark, walk)
    fit = estimate.fit_models(panel, estimate.specify(panel, 1, d, 0, 0, D, 0, s, mean=False), s).collect()[0]
    w = walk
    for _ in range(D):
        w = w[s:] - w[:-s]
    w = np.diff(w, d)
    phi = float(w[1:] @ w[:-1] / (w[:-1] @ w[:-1]))
    assert fit.n_resid == len(w) - 1 and fit.ar == pytest.approx([max(-1.0, min(1.0, phi))], abs=1e-6)


def test_orders_that_were_not_prepared_fail(spark, walk):
    rows = panel_of(spark, walk).withColumns({"d": F.lit(3), "sd": F.lit(0)})
    with pytest.raises(Exception, match="d = 3"):
        difference_by_orders(rows, [(0, 0), (1, 0)], 1).collect()


def test_search_allows_higher_orders(spark):
    panel = panel_of(spark, np.random.RandomState(3).randn(60).cumsum().cumsum().cumsum())
    best = search.auto_sarima(panel, d=3, max_d=3, max_p=1, max_q=0).collect()[0]
    assert best.d == 3 and best.n_resid > 50


def test_residuals_take_every_lag(spark, walk):
    panel = panel_of(spark, walk)
    zero = F.array().cast("array<double>")
    fits = estimate.specify(panel, 6, mean=False).withColumns(
        {"c": F.lit(0.0), "trend": F.lit(0.0), "ar": F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 0.0, 0.0, 0.9)]), "ma": zero, "sar": zero, "sma": zero, "beta": zero}
    )
    found = {r.t: r.w_hat for r in residuals.fitted_residuals(panel, fits).collect()}
    assert found == {t: pytest.approx(0.9 * walk[t - 7]) for t in range(7, 151)}
    with pytest.raises(Exception, match="AR terms"):
        residuals.fitted_residuals(panel, fits, max_p=5, max_sp=0).collect()


def test_lag_rule_of_a_long_series(spark):
    n = 100_300
    panel = spark.range(1, n + 1).select(F.lit("a").alias("series_id"), F.col("id").alias("t"), F.randn(5).alias("y"))
    row = unitroot.kpss(panel).collect()[0]
    assert 0 <= row.stat < 3 and row.lags >= 1
    assert unitroot.ndiffs(panel, 1).collect()[0].d in (0, 1)


def test_outlier_search_is_the_same_in_blocks(spark, walk):
    y = np.random.RandomState(9).randn(150) + 10
    y[[20, 75, 130]] += [30, -25, 40]
    panel = panel_of(spark, y)
    run = lambda: search.auto_sarima(panel, d=0, max_p=1, max_q=1, outliers=True).collect()[0]
    one, many = both_sizes(spark, run)
    assert {21, 76, 131} <= set(one.dummies) and one.dummies == many.dummies
    assert (one.p, one.q, one.k, one.k_var) == (many.p, many.q, many.k, many.k_var)
    assert one.sse == pytest.approx(many.sse, rel=1e-6) and one.aicc == pytest.approx(many.aicc, rel=1e-6)
    assert one.beta == pytest.approx(many.beta, rel=1e-4)
    resid = {r.t: r.resid for r in residuals.fitted_residuals(panel, spark.createDataFrame([one], search.auto_sarima(panel, d=0, max_p=1, max_q=1, outliers=True).schema)).collect()}
    assert sum(v * v for v in resid.values()) == pytest.approx(one.sse, rel=1e-6)


@pytest.mark.parametrize("objective, alpha", [("elastic_net", 0.5), ("stable", None), ("mae", None)])
def test_objectives_are_the_same_in_blocks(spark, walk, objective, alpha):
    panel = panel_of(spark, walk)
    x = panel.select("series_id", "ts", F.sin("t").alias("x1"))
    spec = estimate.specify(panel, d=1, mean=False, objective=objective, alpha=alpha)
    one, many = both_sizes(spark, lambda: estimate.fit_models(panel, spec, 1, x, ["x1"]).collect()[0])
    assert one["lambda"] == (None if many["lambda"] is None else pytest.approx(many["lambda"]))
    assert one.beta == pytest.approx(many.beta, rel=1e-3, abs=1e-6)
    assert one.worst == pytest.approx(many.worst, rel=1e-4) and one.sae == pytest.approx(many.sae, rel=1e-4)


def test_keys_do_not_collide(spark):
    rows = [("a", None), (None, "a"), ("x|y", "z"), ("x", "y|z"), ("\\N", "a"), ("a\\", "b"), ("a", "\\|b")]
    df = spark.createDataFrame(rows, "k string, l string")
    assert df.select(series_key([F.col("k"), F.col("l")])).distinct().count() == len(rows)


def test_a_missing_timestamp_fails(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", dt.date(2020, 1, 1), 2.0)], "series_id string, ts date, y double")
    with pytest.raises(Exception, match="no ts"):
        number_rows(df).collect()


@pytest.mark.parametrize("step, days", [("day", 1), ("week", 7)])
def test_calendar_is_filled_in_ranges(spark, step, days):
    ends = [dt.date(2000, 1, 3), dt.date(2000, 1, 3) + dt.timedelta(days=9000 * days)]
    df = spark.createDataFrame([("a", d, 1.0) for d in ends] + [("b", ends[0], 2.0)], "series_id string, ts date, y double")
    filled = fill_calendar(df, step)
    assert filled.schema["ts"].dataType.simpleString() == "date"
    assert sorted((r.ts, r.y) for r in filled.where("series_id = 'a'").collect()) == [(ends[0] + dt.timedelta(days=i * days), 1.0 if i in (0, 9000) else 0.0) for i in range(9001)]
    assert filled.where("series_id = 'b'").count() == 1


def test_dense_dummies_over_a_long_series(spark):
    axis = spark.createDataFrame([("a", 10_000)], "series_id string, n long")
    hits = spark.createDataFrame([("a", "outlier_3", 3), ("a", "outlier_9999", 9999)], "series_id string, name string, dummy_t long")
    out = outliers.dense_dummies(hits, axis, ["outlier_3", "outlier_9999"], tail=2)
    assert out.count() == 10_002
    assert [(r.t, r.outlier_3, r.outlier_9999) for r in out.where("outlier_3 + outlier_9999 > 0").orderBy("t").collect()] == [(3, 1.0, 0.0), (9999, 0.0, 1.0)]
    assert lengths(out.withColumn("ts", F.lit(None))).collect()[0].n == 10_002


def seeded(label, period):
    """Fixed generator: noise for odd labels, its running sum for even ones; labels 4 and 8 get a wave."""
    y = np.random.RandomState(42).randn(200)
    if label % 2 == 0:
        y = y.cumsum()
    return y + (5 * np.sin(2 * np.pi * np.arange(200) / period) if label in (4, 8) else 0.0)


# Published results for the seeded series
KPSS = {1: (0.19481988569078376, 0.1), 2: (0.48057298472235727, 0.04604212055802765), 4: (0.39648328498259205, 0.07867099785233102)}
OCSB = {1: -10.522332369943875, 2: -12.903449346884171, 4: -3.759686724651314}


def test_published_kpss_and_ocsb(spark):
    many = [(str(k), i + 1, float(v)) for k in range(1, 11) for i, v in enumerate(seeded(k, 50))]
    for r in unitroot.kpss(spark.createDataFrame(many, "series_id string, t long, y double"), lags="legacy").collect():
        kind = 4 if r.series_id in ("4", "8") else 2 - int(r.series_id) % 2
        assert (r.stat, r.p_value) == (pytest.approx(KPSS[kind][0], abs=1e-9), pytest.approx(KPSS[kind][1], abs=1e-9)) and r.lags == 15
    many = [(str(k), i + 1, float(np.float32(v))) for k in range(1, 11) for i, v in enumerate(seeded(k, 12))]
    for r in unitroot.ocsb(spark.createDataFrame(many, "series_id string, t long, y double"), 12).collect():
        kind = 4 if r.series_id in ("4", "8") else 2 - int(r.series_id) % 2
        assert r.stat == pytest.approx(OCSB[kind], rel=1e-4) and r.sd == 0
