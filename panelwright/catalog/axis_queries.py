"""Sources, ranges, splits, specification checks and time axes."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.catalog import panels as P
from panelwright.catalog.registry import query, r, rounded
from panelwright.operators import axis as A
from panelwright.operators import panel as B
from panelwright.sources import from_table, read_series

SUP = P.supplier_months_sql()


def _shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="panelwright-")
    return f"{folder}/{uuid.uuid4().hex}"


@query("read_series", f"WITH {P.event_days_sql('e')}, s AS (SELECT ts, {r('sum(y)')} AS y FROM e GROUP BY ts) "
       "SELECT 'events' AS series_id, ts, y, row_number() OVER (ORDER BY ts) AS t FROM s")  # fmt: skip
def read_series_query(spark: SparkSession, sf: str) -> DataFrame:
    total = P.event_days(spark, sf).groupBy("ts").agg(F.round(F.sum("y"), 6).alias("value"))
    path = _shared_folder(spark)
    total.select(F.col("ts").alias("date"), "value").write.csv(path, header=True, sep=";")
    return read_series(spark, path, "date", "value", ";", "events")


@query("from_table_without_dates", "SELECT CAST(l_orderkey AS VARCHAR) AS series_id, "
       "make_date(CAST(row_number() OVER w AS INTEGER), 1, 1) AS ts, l_extendedprice AS y, row_number() OVER w AS t "
       "FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice)")  # fmt: skip
def from_table_query(spark: SparkSession, sf: str) -> DataFrame:
    # the driver's line numbers repeat within an order, so the order is made total
    lines = P.table(spark, sf, "lineitem").withColumn("place", F.struct("l_linenumber", "l_partkey", "l_extendedprice"))
    return from_table(lines, ["l_orderkey"], "l_extendedprice", order_by="place")


@query("from_table_with_dates", f"WITH {P.user_days_sql()} SELECT series_id, ts, {r('y')} AS y, t FROM p")
def from_table_dated(spark: SparkSession, sf: str) -> DataFrame:
    days = P.user_days(spark, sf).select("series_id", "ts", "y")
    return rounded(from_table(days, ["series_id"], "y", "ts"), "y")


@query("time_range", f"SELECT l_returnflag AS series_id, count(*) AS n, {r('sum(l_extendedprice) / 1e6')} AS total FROM lineitem "
       "WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1998-06-30' GROUP BY 1")  # fmt: skip
def time_range_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").alias("ts"), "l_extendedprice")
    cut = B.time_range(rows, dt.datetime(1996, 1, 1), dt.datetime(1998, 6, 30))
    return rounded(cut.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), (F.sum("l_extendedprice") / 1e6).alias("total")), "total")


@query("split_train_test", f"WITH {SUP} SELECT series_id, ts, t, {r('y')} AS y, t <= floor(n * 0.8::DOUBLE) AS is_train FROM p")
def split_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.split_train_test(P.supplier_months(spark, sf), 0.8), "y").select("series_id", "ts", "t", "y", "is_train")


@query("log_and_back", f"WITH {SUP} SELECT series_id, ts, {r('ln(y)')} AS log_y, {r('y')} AS y FROM p WHERE y > 0")
def log_query(spark: SparkSession, sf: str) -> DataFrame:
    logs = B.transform(P.supplier_months(spark, sf).where("y > 0"), "log").withColumn("log_y", F.col("y"))
    return rounded(B.transform(logs, "exp"), "log_y", "y").select("series_id", "ts", "log_y", "y")


@query("is_constant", "SELECT CAST(l_orderkey AS VARCHAR) AS series_id, (count(DISTINCT l_discount) = 1 OR count(DISTINCT l_tax) = 1) AS is_constant "
       "FROM lineitem GROUP BY 1")  # fmt: skip
def is_constant_query(spark: SparkSession, sf: str) -> DataFrame:
    lines = P.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("series_id"), "l_discount", "l_tax")
    return B.is_constant(lines, ["l_discount", "l_tax"])


def part_specs(spark: SparkSession, sf: str) -> DataFrame:
    """Specification rows derived from the part table, valid and invalid ones."""
    size = F.col("p_size")
    return P.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("series_id"),
        (size % 4 - F.when(size == 13, 2).otherwise(0)).cast("int").alias("p"),
        (size % 3).cast("int").alias("d"),
        (F.col("p_partkey") % 3).cast("int").alias("q"),
        (size % 2).cast("int").alias("sp"),
        (F.col("p_partkey") % 2).cast("int").alias("sd"),
        (F.col("p_partkey") % 5 % 2).cast("int").alias("sq"),
        F.when(size % 7 == 0, 1).otherwise(12).alias("s"),
        (size % 2 == 0).alias("mean"),
        (size % 2 == 1).alias("drift"),
        F.when(size % 5 == 0, "elastic_net").when(size == 17, "huber").otherwise("mse").alias("objective"),
        (F.col("p_retailprice") / 1000.0 - 1.0).alias("lambda"),
        F.when(size % 10 == 0, (F.col("p_partkey") % 40) / 20.0).alias("alpha"),
    )


PART_SPECS = """specs AS (SELECT CAST(p_partkey AS VARCHAR) AS series_id, p_size % 4 - CASE WHEN p_size = 13 THEN 2 ELSE 0 END AS p,
 p_size % 3 AS d, p_partkey % 3 AS q, p_size % 2 AS sp, p_partkey % 2 AS sd, p_partkey % 5 % 2 AS sq,
 CASE WHEN p_size % 7 = 0 THEN 1 ELSE 12 END AS s, p_size % 2 = 0 AS mean, p_size % 2 = 1 AS drift,
 CASE WHEN p_size % 5 = 0 THEN 'elastic_net' WHEN p_size = 17 THEN 'huber' ELSE 'mse' END AS objective,
 p_retailprice / 1000.0::DOUBLE - 1.0::DOUBLE AS "lambda", CASE WHEN p_size % 10 = 0 THEN (p_partkey % 40) / 20.0::DOUBLE END AS alpha FROM part)"""


@query("validate_spec", f"""WITH {PART_SPECS} SELECT series_id, CASE WHEN least(p, d, q, sp, sd, sq) < 0 THEN 'orders must not be negative'
 WHEN s < 1 THEN 's must be at least 1' WHEN sp + sq > 0 AND s = 1 THEN 'seasonal coefficients need s > 1'
 WHEN "lambda" < 0 THEN 'lambda must not be negative' WHEN alpha < 0 OR alpha > 1 THEN 'alpha must lie between 0 and 1'
 WHEN objective = 'elastic_net' AND alpha IS NULL THEN 'elastic_net needs alpha' WHEN objective = 'huber' THEN 'unknown objective' END AS error FROM specs""")  # fmt: skip
def validate_query(spark: SparkSession, sf: str) -> DataFrame:
    return B.validate_spec(part_specs(spark, sf)).select("series_id", "error")


@query("model_label", f"""WITH {PART_SPECS} SELECT series_id, format('SARIMA({{}},{{}},{{}})({{}},{{}},{{}} s={{}}, c={{}}, drift={{}})', p, d, q, sp, sd, sq, s, mean, drift) AS model_id FROM specs""")
def label_query(spark: SparkSession, sf: str) -> DataFrame:
    return part_specs(spark, sf).select("series_id", B.model_label().alias("model_id"))


# --- axes -------------------------------------------------------------------------------------------

UNITS_SQL = [("Second", 1), ("Minute", 60), ("Hour", 3600), ("Day", 86400), ("Week", 604800)]


def granularity_sql(source: str) -> str:
    """The step cascade over a table series_id, ts (timestamp): ends in axis(...)."""
    uneven = "WHEN hi < 1 THEN NULL "
    for unit, size in UNITS_SQL:
        uneven += f"WHEN hi < {size} THEN NULL "
        if unit == "Day":
            uneven += "WHEN workdays AND lo / 86400.0::DOUBLE < 7 THEN 'Weekday' "
        uneven += f"WHEN (hi - lo) / {size}.0::DOUBLE < 1 THEN '{unit}' "
    size = "CASE unit " + " ".join(f"WHEN '{u}' THEN {n}.0::DOUBLE" for u, n in UNITS_SQL) + " END"
    return f"""gaps AS (SELECT series_id, ts, epoch(CAST(ts AS TIMESTAMP)) AS sec, lag(epoch(CAST(ts AS TIMESTAMP))) OVER (PARTITION BY series_id ORDER BY ts) AS before FROM {source}),
 extremes AS (SELECT series_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n, bool_and(isodow(ts) < 6) AS workdays,
   min(sec - before) AS lo, max(sec - before) AS hi FROM gaps GROUP BY 1),
 units AS (SELECT *, CASE WHEN lo IS NULL THEN NULL WHEN lo = hi THEN CASE WHEN lo < 1 THEN NULL WHEN lo < 60 THEN 'Second' WHEN lo < 3600 THEN 'Minute'
   WHEN lo < 86400 THEN 'Hour' WHEN lo < 604800 OR lo % 604800 <> 0 THEN 'Day' ELSE 'Week' END ELSE CASE {uneven} END END AS unit FROM extremes),
 steps AS (SELECT *, CASE WHEN unit = 'Weekday' THEN 1.0::DOUBLE WHEN lo = hi THEN lo / {size} ELSE round_even(lo / {size}, 0) END AS f FROM units),
 axis AS (SELECT series_id, CASE WHEN unit = 'Week' AND f % 52 = 0 THEN 'Year' WHEN unit = 'Week' AND (f % 13 = 0 OR f % 4 = 0) THEN 'Month'
   WHEN unit = 'Weekday' THEN 'Day' ELSE unit END AS granularity,
   CASE WHEN unit = 'Week' AND f % 52 = 0 THEN f / 52 WHEN unit = 'Week' AND f % 13 = 0 THEN 3.0::DOUBLE WHEN unit = 'Week' AND f % 4 = 0 THEN f / 4 ELSE f END AS frequency,
   coalesce(unit = 'Weekday', false) AS weekdays, start_ts, end_ts, n, unit IS NOT NULL AS ok FROM steps)"""


MIXED = (
    f"{SUP}, {P.event_days_sql('ed')}, {P.user_days_sql('ud')}, mixed AS (SELECT 's' || series_id AS series_id, ts FROM p UNION ALL SELECT series_id, ts FROM ed "
    "UNION ALL SELECT 'u' || series_id, ts FROM ud UNION ALL SELECT 'w' || series_id, ts FROM ed WHERE isodow(ts) < 6 UNION ALL SELECT 'q' || series_id, ts FROM p WHERE month(ts) % 3 = 1)"
)


def mixed_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly, quarterly, daily, weekday-only and gappy series in one panel."""
    from panelwright.plans.blocks import number_rows

    months, days, users = P.supplier_months(spark, sf), P.event_days(spark, sf), P.user_days(spark, sf)
    named = lambda prefix, df: df.select(F.concat(F.lit(prefix), "series_id").alias("series_id"), "ts", "y")
    parts = [
        named("s", months), named("", days), named("u", users),
        named("w", days.where(F.weekday("ts") < 5)), named("q", months.where(F.month("ts") % 3 == 1)),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return number_rows(union)


@query("identify_granularity", f"WITH {MIXED}, {granularity_sql('mixed')} SELECT * FROM axis")
def granularity_query(spark: SparkSession, sf: str) -> DataFrame:
    return A.identify_granularity(mixed_panel(spark, sf))


HOURS = f"{P.event_hours_sql()}, {granularity_sql('p')}"


@query("identify_granularity_hours", f"WITH {HOURS} SELECT * FROM axis")
def granularity_hours_query(spark: SparkSession, sf: str) -> DataFrame:
    return A.identify_granularity(P.event_hours(spark, sf))


@query("require_regular", f"WITH {P.user_days_sql()}, {granularity_sql('p')} SELECT series_id, ts, t, {r('y')} AS y, ok FROM p JOIN axis USING (series_id)")
def regular_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.user_days(spark, sf)
    good, bad = A.require_regular(panel, A.identify_granularity(panel))
    both = good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False)))
    return rounded(both, "y").select("series_id", "ts", "t", "y", "ok")


@query("future_timestamps_months", f"WITH {SUP} SELECT series_id, h, CAST(max(ts) + to_months(CAST(h AS INTEGER)) AS DATE) AS ts FROM p, range(1, 7) x(h) GROUP BY 1, 2")
def future_months_query(spark: SparkSession, sf: str) -> DataFrame:
    axis = A.identify_granularity(P.supplier_months(spark, sf))
    return A.future_timestamps(axis, 6).select("series_id", F.col("h").cast("bigint").alias("h"), "ts")


@query("future_timestamps_weekdays", f"""WITH RECURSIVE {P.event_days_sql()}, f AS (
 SELECT series_id, 0::BIGINT AS h, max(ts) AS ts FROM p WHERE isodow(ts) < 6 GROUP BY 1
 UNION ALL SELECT series_id, h + 1, CAST(ts + CASE WHEN isodow(ts) = 5 THEN INTERVAL 3 DAY ELSE INTERVAL 1 DAY END AS DATE) FROM f WHERE h < 10)
 SELECT * FROM f WHERE h > 0""")  # fmt: skip
def future_weekdays_query(spark: SparkSession, sf: str) -> DataFrame:
    from panelwright.plans.blocks import number_rows

    days = number_rows(P.event_days(spark, sf).where(F.weekday("ts") < 5).drop("t"))
    axis = A.identify_granularity(days)
    return A.future_timestamps(axis, 10).select("series_id", F.col("h").cast("bigint").alias("h"), "ts")


@query("future_timestamps_hours", f"WITH {P.event_hours_sql()} SELECT series_id, h, max(ts) + to_hours(h) AS ts FROM p, range(1, 6) x(h) GROUP BY 1, 2")
def future_hours_query(spark: SparkSession, sf: str) -> DataFrame:
    axis = A.identify_granularity(P.event_hours(spark, sf))
    return A.future_timestamps(axis, 5).select("series_id", F.col("h").cast("bigint").alias("h"), "ts")


PAID = P.paid_months_sql("q")


@query("align", f"WITH {SUP}, {PAID} SELECT p.series_id, p.ts, {r('p.y')} AS revenue, {r('q.y')} AS paid FROM p JOIN q USING (series_id, ts)")
def align_query(spark: SparkSession, sf: str) -> DataFrame:
    revenue = P.supplier_months(spark, sf).select("series_id", "ts", F.col("y").alias("revenue"))
    paid = P.paid_months(spark, sf).select("series_id", "ts", F.col("y").alias("paid"))
    return rounded(A.align([revenue, paid]), "revenue", "paid")


@query("join_exog", f"WITH {SUP}, {PAID} SELECT p.series_id, p.ts, p.t, {r('p.y')} AS y, {r('q.y')} AS x1 FROM p JOIN q USING (series_id, ts)")
def join_exog_query(spark: SparkSession, sf: str) -> DataFrame:
    exog = P.paid_months(spark, sf).select("series_id", "ts", F.col("y").alias("x1"))
    return rounded(A.join_exog(P.supplier_months(spark, sf), exog), "y", "x1").select("series_id", "ts", "t", "y", "x1")


AXIS = "SELECT series_id, min(ts) AS lo, max(ts) AS hi, min(gap) AS step FROM (SELECT *, datediff('month', lag(ts) OVER (PARTITION BY series_id ORDER BY ts), ts) AS gap FROM {}) GROUP BY 1"


# the regressor of every third supplier has a quarterly axis
@query("validate_exog", f"""WITH {SUP}, {P.paid_months_sql("q", quarterly="l_suppkey % 3 = 0")}, a AS ({AXIS.format("p")}), b AS ({AXIS.format("q")})
 SELECT series_id, a.lo = b.lo AS same_start, a.hi <= b.hi AS long_enough, a.step = b.step AS same_step FROM a JOIN b USING (series_id)""")  # fmt: skip
def validate_exog_query(spark: SparkSession, sf: str) -> DataFrame:
    exog = P.paid_months(spark, sf, "l_suppkey % 3 <> 0", "month").unionByName(P.paid_months(spark, sf, "l_suppkey % 3 = 0", "quarter"))
    return A.validate_exog(A.identify_granularity(P.supplier_months(spark, sf)), A.identify_granularity(exog))


@query("exog_horizon_check", f"""WITH {SUP}, cut AS (SELECT series_id, max(ts) AS last FROM p WHERE ts <= DATE '1998-06-01' GROUP BY 1),
 f AS (SELECT series_id, h, CAST(last + to_months(CAST(h AS INTEGER)) AS DATE) AS ts FROM cut, range(1, 61) x(h))
 SELECT f.* FROM f ANTI JOIN p USING (series_id, ts)""")  # fmt: skip
def horizon_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    axis = A.identify_granularity(B.time_range(panel, end=dt.date(1998, 6, 1)))
    return A.exog_horizon_check(axis, panel, 60).select("series_id", F.col("h").cast("bigint").alias("h"), "ts")
