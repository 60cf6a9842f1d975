"""Published numbers of the known series, and small hand-made cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwright.functions.criteria import model_criterion
from panelwright.functions.polynomials import diff_coefficients, full_polynomial, psi_weights
from panelwright.operators import axis, estimate, forecast, outliers, panel, unitroot
from panelwright.sources import from_table


def by_series(df):
    return {row["series_id"]: row for row in df.collect()}


def test_series_files(published):
    rows = by_series(published.groupBy("series_id").agg(F.count("y").alias("n"), F.min_by("y", "t").alias("first"), F.max_by("y", "t").alias("last")))
    assert (rows["air"].n, rows["air"].first, rows["air"].last) == (204, 3.526591, 19.43174)
    assert (rows["gdp"].n, rows["gdp"].first, rows["gdp"].last) == (344, 2260.807, 27944.5)
    assert (rows["nrou"].n, rows["nrou"].first) == (344, 5.25505256652832)


def test_split(published):
    sizes = by_series(panel.split_train_test(published).groupBy("series_id").agg(F.count_if("is_train").alias("a"), F.count_if(~F.col("is_train")).alias("b")))
    assert (sizes["air"].a, sizes["air"].b) == (163, 41)
    assert (sizes["gdp"].a, sizes["gdp"].b) == (275, 69)


def test_kpss(published):
    rows = by_series(unitroot.kpss(published))
    for name, stat, lags in (("air", 2.01312564, 9), ("log", 2.11818897, 9), ("gdp", 2.90119724, 11), ("nrou", 2.09584042, 11)):
        assert rows[name].stat == pytest.approx(stat, abs=1e-7)
        assert (rows[name].lags, rows[name].p_value) == (lags, 0.01)


def test_kpss_seed_42(spark):
    np = pytest.importorskip("numpy")
    noise = np.random.RandomState(42).randn(200)
    wave = 5 * np.sin(2 * np.pi * np.arange(200) / 50)
    data = {"noise": noise, "walk": noise.cumsum(), "wave": noise.cumsum() + wave}
    rows = [(k, i + 1, float(v)) for k, values in data.items() for i, v in enumerate(values)]
    got = by_series(unitroot.kpss(spark.createDataFrame(rows, "series_id string, t long, y double"), lags="legacy"))
    assert got["noise"].stat == pytest.approx(0.19481988569078376) and got["noise"].lags == 15
    assert got["walk"].p_value == pytest.approx(0.04604212055802765)
    assert got["wave"].stat == pytest.approx(0.39648328498259205)
    with pytest.raises(ValueError):
        unitroot.kpss(spark.createDataFrame(rows, "series_id string, t long, y double"), "invalid")


def test_ocsb(published):
    rows = by_series(unitroot.ocsb(published, 12))
    assert rows["air"].stat == pytest.approx(-1.0402140896188212) and rows["air"].sd == 1
    assert rows["log"].stat == pytest.approx(-3.247584501115398) and rows["log"].sd == 0
    assert rows["gdp"].stat == pytest.approx(-16.589586845196475) and rows["gdp"].sd == 0
    assert rows["nrou"].sd == 0


def test_orders(published):
    d = {k: r.d for k, r in by_series(unitroot.ndiffs(published, 2, 0, 12)).items()}
    assert d == {"air": 1, "log": 1, "gdp": 2, "nrou": 2}
    assert by_series(unitroot.nsdiffs(published, 12, "seas"))["air"].sd == 1
    assert by_series(unitroot.nsdiffs(published, 12, "ch"))["air"].sd == 0
    with pytest.raises(ValueError):
        unitroot.nsdiffs(published, 12, "hegy")


def test_difference_coefficients():
    assert diff_coefficients(1, 0, 1) == [1.0, -1.0]
    assert diff_coefficients(2, 1, 4) == [1.0, -2.0, 1.0, 0.0, -1.0, 2.0, -1.0]
    assert diff_coefficients(1, 1, 12) == [1.0, -1.0] + [0.0] * 10 + [-1.0, 1.0]
    # colliding terms add up (a deviation from the studied behaviour)
    assert diff_coefficients(1, 1, 1) == [1.0, -2.0, 1.0]


def test_seasonal_model_criteria(published):
    log = published.where("series_id = 'log'")
    row = estimate.fit_models(log, estimate.specify(log, 3, 0, 1, 1, 1, 1, 12), 12).collect()[0]
    assert row.k == 8
    assert row.aic == pytest.approx(-1063.1519532534248, abs=1e-6)
    assert row.aicc == pytest.approx(-1062.3650680075232, abs=1e-6)
    assert row.bic == pytest.approx(-1037.0919902772025, abs=1e-6)
    assert row.loglik == pytest.approx(254.012, abs=0.1)
    with pytest.raises(ValueError):
        model_criterion("mse")


def test_objectives(published):
    log = published.where("series_id = 'log'")
    spec = estimate.specify(log, 1, 0, 1, 0, 1, 1, 12)
    every = spec
    for name, alpha in (("ml", None), ("bilevel", None), ("mae", None), ("stable", None), ("elastic_net", 0.0)):
        every = every.unionByName(spec.withColumns({"objective": F.lit(name), "alpha": F.lit(alpha).cast("double")}))
    fits = {r.objective: r for r in estimate.fit_models(log, every, 12).collect()}
    mse = fits["mse"]
    assert fits["ml"].sse == pytest.approx(mse.sse) and fits["ml"].sigma2 == pytest.approx(mse.sse / fits["ml"].n_w)
    assert fits["bilevel"].sse == pytest.approx(mse.sse, rel=1e-6)
    assert fits["mae"].sae < mse.sae and fits["stable"].worst < mse.worst
    assert fits["elastic_net"].ar != mse.ar and fits["elastic_net"]["lambda"] > 0


def test_given_penalty_is_used(published):
    log = published.where("series_id = 'log'")
    spec = estimate.specify(log, 1, 1, objective="elastic_net", lam=0.1, alpha=1.0)
    fit = estimate.fit_models(log, spec).collect()[0]
    assert fit["lambda"] == 0.1
    assert fit.ar == pytest.approx([-0.3013120314], abs=1e-5) and fit.sse == pytest.approx(6.0439011821, abs=1e-6)


@pytest.mark.parametrize(
    "ar, seasonal, s, d", [([0.3], 0.0, 1, 0), ([0.3, 0.4], 0.0, 1, 0), ([-0.3, -0.2], -0.4, 12, 1)]
)
def test_recovers_noise_free_coefficients(spark, ar, seasonal, s, d):
    np = pytest.importorskip("numpy")
    start = np.random.RandomState(1).randn(max(s, len(ar)))
    y = list(start)
    trend = 0.1 if d else 0.0
    for i in range(len(y), 200):
        y.append(seasonal * y[i - s] + sum(a * y[i - j - 1] for j, a in enumerate(ar)) + trend * (i + 1))
    rows = [("a", dt.date(1991 + i // 12, i % 12 + 1, 1), i + 1, float(v)) for i, v in enumerate(y)]
    p = spark.createDataFrame(rows, "series_id string, ts date, t long, y double")
    spec = estimate.specify(p, len(ar), d, 0, 1 if seasonal else 0, 0, 0, s)
    fit = estimate.fit_models(p, spec, s).collect()[0]
    assert fit.ar == pytest.approx(ar, abs=1e-3)
    if seasonal:
        assert fit.sar == pytest.approx([seasonal], abs=1e-3)
        train = panel.split_train_test(p).where("is_train").drop("is_train")
        fits = estimate.fit_models(train, spec, s)
        out = forecast.forecast(fits, train, axis.identify_granularity(train), 40, s)
        assert forecast.accuracy(p, out).collect()[0].mae < 1e-3


def test_psi_weights(spark):
    def psi(ar, ma, sar, n):
        empty = F.array().cast("array<double>")
        arr = lambda v: F.array(*[F.lit(x) for x in v]) if v else empty
        full = full_polynomial(arr(ar), arr(sar), 12)
        return spark.range(1).select(psi_weights(full, arr(ma), n).alias("v")).collect()[0].v

    assert psi([-0.2, 0.0, 0.5], [], [], 5) == pytest.approx([-0.2, 0.04, 0.492, -0.1984, 0.05968], abs=1e-3)
    assert psi([0.2, -0.1], [0.5], [], 5) == pytest.approx([0.7, 0.04, -0.062, -0.0164, 0.00292], abs=1e-3)
    assert psi([0.2, -0.1], [0.5], [0.1], 15)[11:] == pytest.approx([0.1000006, 0.08999941, 0.01199982, -0.01279998], abs=1e-3)


def test_granularity(spark):
    start = dt.datetime(2024, 3, 24)
    month = lambda i: dt.datetime(2024 + (i // 12), i % 12 + 1, 1)
    cases = {
        "year": ([dt.datetime(2020 + i, 1, 1) for i in range(10)], ("Year", 1.0, False)),
        "month": ([month(i) for i in range(10)], ("Month", 1.0, False)),
        "quarter": ([month(3 * i) for i in range(10)], ("Month", 3.0, False)),
        "days15": ([start + dt.timedelta(days=15 * i) for i in range(10)], ("Day", 15.0, False)),
        "week": ([start + dt.timedelta(weeks=i) for i in range(10)], ("Week", 1.0, False)),
        "hour": ([start + dt.timedelta(hours=i) for i in range(10)], ("Hour", 1.0, False)),
        "minutes15": ([start + dt.timedelta(minutes=15 * i) for i in range(10)], ("Minute", 15.0, False)),
        "weekdays": ([dt.datetime(2024, 3, 25) + dt.timedelta(days=i + 2 * (i // 5)) for i in range(10)], ("Day", 1.0, True)),
        "uneven": ([start + dt.timedelta(hours=h) for h in (0, 1, 4, 5, 8, 10)], (None, None, False)),
    }
    rows = [(k, t, i + 1) for k, (stamps, _) in cases.items() for i, t in enumerate(stamps)]
    got = by_series(axis.identify_granularity(spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, t long")))
    for name, (_, expected) in cases.items():
        assert (got[name].granularity, got[name].frequency, got[name].weekdays) == expected, name
        assert got[name].ok == (expected[0] is not None)
    with pytest.raises(Exception, match="inconsistent"):
        good, _ = axis.require_regular(spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, t long"), axis.identify_granularity(spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, t long")), strict=True)
        good.collect()


def test_month_ends_are_clamped_step_by_step(spark):
    one = spark.createDataFrame([("a", dt.date(2024, 1, 31), "Month", 1.0, False)], "series_id string, end_ts date, granularity string, frequency double, weekdays boolean")
    assert [r.ts for r in axis.future_timestamps(one, 3).orderBy("h").collect()] == [dt.date(2024, 2, 29), dt.date(2024, 3, 29), dt.date(2024, 4, 29)]


def test_outliers(spark):
    cases = {"a": [1, 2, 3, 4, 5], "b": [1, 2, 3, 100], "c": [1, 2, 3, 100, -50], "d": [5] * 10, "e": [7]}
    rows = [(k, i + 1, float(v)) for k, values in cases.items() for i, v in enumerate(values)]
    p = spark.createDataFrame(rows, "series_id string, t long, x double")
    flags = {}
    for r in outliers.iqr_outliers(p).orderBy("series_id", "t").collect():
        flags.setdefault(r.series_id, []).append(r.is_outlier)
    assert flags == {"a": [False] * 5, "b": [False] * 3 + [True], "c": [False] * 3 + [True] * 2, "d": [False] * 10, "e": [False]}
    with pytest.raises(ValueError):
        outliers.iqr_outliers(p, method="unknown")


def test_detect_outliers(spark):
    values = [100.0 if i in (15, 20) else 1.0 for i in range(1, 32)]
    p = spark.createDataFrame([("a", dt.date(2019, 1, i), i, v) for i, v in enumerate(values, 1)], "series_id string, ts date, t long, y double")
    assert sorted(r.name for r in outliers.detect_outliers(p).collect()) == ["outlier_15", "outlier_20"]
    exog = p.select("series_id", "ts", F.lit(2.0).alias("x1"))
    assert sorted(r.name for r in outliers.detect_outliers(p, exog=exog, exog_columns=["x1"]).collect()) == ["outlier_15", "outlier_20"]


def test_table_without_dates(spark):
    df = spark.createDataFrame([("a", "2020-01-02", 2), ("a", "2020-01-01", 1)], "k string, d string, v int")
    got = from_table(df, ["k"], "v", order_by="d").orderBy("t").collect()
    assert [(r.ts, r.y) for r in got] == [(dt.date(1, 1, 1), 1.0), (dt.date(2, 1, 1), 2.0)]
    with pytest.raises(ValueError):
        from_table(df, ["k"], "v")


def test_settings_are_checked():
    with pytest.raises(ValueError):
        panel.check_settings(objective="huber")
    with pytest.raises(ValueError):
        panel.check_settings(alpha=10.0)
    with pytest.raises(ValueError):
        panel.check_settings(lam=-1.0)
