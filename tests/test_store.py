"""Stored panels: the same rows and differences, without a shuffle."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from panelwright.operators import differencing, unitroot
from panelwright.plans.blocks import BLOCK_ROWS_SETTING, block_window
from panelwright.sources.store import read_halo, read_panel, write_panel


@pytest.fixture
def panel(spark):
    rows = [("hot", dt.date(2000, 1, 1) + dt.timedelta(i), i + 1, float((i * 7919) % 101), "x") for i in range(700)]
    rows += [("short", dt.date(2000, 1, 1) + dt.timedelta(i), i + 1, None if i == 3 else float(i * i), None) for i in range(9)]
    return spark.createDataFrame(rows, "series_id string, ts date, t long, y double, note string")


@pytest.fixture
def stored(spark, panel, small_blocks, tmp_path):
    def make(df=panel, reach=14, buckets=4):
        name = f"panel_{uuid.uuid4().hex}"
        write_panel(df, name, reach, buckets, str(tmp_path / name))
        return name

    return make


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_every_row_comes_back_once(spark, panel, stored):
    for reach in (0, 14, 64):
        back = read_panel(spark, stored(reach=reach))
        assert rows_of(back, *panel.columns) == rows_of(panel, *panel.columns)


@pytest.mark.parametrize("d, D, s", [(0, 0, 1), (1, 0, 1), (2, 0, 1), (1, 1, 7), (0, 1, 12)])
def test_differences_without_a_shuffle(spark, panel, stored, d, D, s):
    out = differencing.difference_stored(spark, stored(), d, D, s)
    assert shuffles(out) == 0
    assert d + D == 0 or shuffles(differencing.difference(panel, d, D, s)) > 0
    assert rows_of(out, "series_id", "ts", "t", "w") == rows_of(differencing.difference(panel, d, D, s), "series_id", "ts", "t", "w")


def test_block_sums_without_a_shuffle_and_a_hot_series_over_many_buckets(spark, stored):
    name = stored()
    rows = read_panel(spark, name)
    assert shuffles(rows.withColumn("up", F.sum("y").over(block_window()))) == 0
    assert shuffles(rows.groupBy("series_id", "blk").agg(F.sum("y"))) == 0
    files = spark.table(name).where("series_id = 'hot'").select(F.input_file_name().alias("file")).distinct().count()
    assert files == 4


def test_kpss_of_a_stored_panel_shuffles_less(spark, panel, stored):
    whole = panel.where("series_id = 'hot'")
    back = read_panel(spark, stored(whole))
    kept, plain = unitroot.kpss(back, longest=700), unitroot.kpss(whole, longest=700)
    assert rows_of(kept.select(F.round("stat", 9), "lags"), "*") == rows_of(plain.select(F.round("stat", 9), "lags"), "*")
    assert shuffles(kept) <= shuffles(plain)


def test_empty_panel(spark, panel, stored):
    name = stored(panel.where("false"))
    assert read_panel(spark, name).count() == 0 and differencing.difference_stored(spark, name, 1).count() == 0


def test_what_a_table_cannot_answer_is_refused(spark, stored):
    name = stored(reach=3)
    with pytest.raises(ValueError, match="reaches back 3 rows"):
        differencing.difference_stored(spark, name, 1, 1, 7)
    spark.conf.set(BLOCK_ROWS_SETTING, "100")
    with pytest.raises(ValueError, match="blocks of 64 rows"):
        read_halo(spark, name, 1)
    spark.conf.set(BLOCK_ROWS_SETTING, "64")
