"""Work that grows with the panel is done once, whatever reads it afterwards."""

import datetime as dt

import numpy as np
import pytest

from panelwright.catalog.forecast_queries import outlier_forecast_query, scenario_query
from panelwright.operators import estimate, forecast, search
from panelwright.operators.axis import identify_granularity


def months(n):
    return [dt.date(2000 + i // 12, i % 12 + 1, 1) for i in range(n)]


@pytest.fixture
def panel(spark):
    rng = np.random.RandomState(3)
    rows = [(name, ts, i + 1, float(v)) for name in "ab" for i, (ts, v) in enumerate(zip(months(60), rng.randn(60).cumsum()))]
    return spark.createDataFrame(rows, "series_id string, ts date, t long, y double").coalesce(1)


@pytest.fixture
def tables(spark, tmp_path):
    rng = np.random.RandomState(5)
    rows = [(k, dt.datetime(ts.year, ts.month, 9), float(v), 0.0) for k in (1, 2) for ts, v in zip(months(30), 1e5 + 1e4 * rng.randn(30))]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path), rows


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_paths_are_not_joined_once_drawn(spark, panel):
    fits = estimate.fit_models(panel, estimate.specify(panel, 1, 1, 1), 1).cache()
    paths = forecast.scenario_paths(fits, panel, identify_granularity(panel), 4, scenarios=3, seed=5)
    text = plan(paths)
    assert "Join" not in text[: text.index("Generate")]


@pytest.mark.parametrize("sd, sq", [(0, 0), (1, 1)])
def test_short_paths_equal_folds(spark, panel, sd, sq):
    fits = estimate.fit_models(panel, estimate.specify(panel, 1, 1, 1, 0, sd, sq, 12), 12).cache()
    draw = lambda h: {(r.series_id, r.scenario, r.h): r for r in forecast.scenario_paths(fits, panel, identify_granularity(panel), h, 12, scenarios=70, seed=5).collect()}
    short, long = draw(forecast.SHORT), draw(forecast.SHORT + 2)
    assert len(short) == 2 * 70 * forecast.SHORT and len(long) == 2 * 70 * (forecast.SHORT + 2)
    for key, row in short.items():
        assert row.value == pytest.approx(long[key].value, rel=1e-9, abs=1e-9) and row.ts == long[key].ts


def test_a_search_reads_its_panel_once(spark, panel):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    counted = panel.mapInPandas(count, panel.schema)
    assert search.auto_sarima(counted, d=0, max_p=1, max_q=1).count() == 2
    # a checkpoint may run its plan once to fill it and once to write it
    assert read.value <= 2 * 120


def test_outlier_forecast_reads_and_fits_once(spark, tables):
    folder, rows = tables
    out = outlier_forecast_query(spark, folder)
    assert "parquet" not in plan(out) and "MapInPandas" not in plan(out)
    got = {(r.series_id, r.h): r["mean"] for r in out.collect()}
    for k in (1, 2):
        y = np.array([r[2] for r in rows if r[0] == k]) / 99991.0
        for h in (1, 2, 3):
            assert got[str(k), h] == pytest.approx((y.sum() - y.max()) / 29, abs=2e-6)


def test_scenarios_read_the_items_once(spark, tables):
    out = scenario_query(spark, tables[0])
    assert "parquet" not in plan(out) and out.count() == 2 * 200 * 6
