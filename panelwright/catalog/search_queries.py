"""Order selection: rules, candidates and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.catalog import panels as P
from panelwright.catalog.fit_queries import CROSS
from panelwright.catalog.registry import query, r, rounded
from panelwright.catalog.unitroot_queries import ndiffs_sql
from panelwright.operators import estimate as E
from panelwright.operators import search as S
from panelwright.operators.panel import is_constant
from panelwright.sources import from_table

SUP = P.supplier_months_sql()


@query("select_orders", ndiffs_sql(0, 12, SUP).replace("SELECT series_id, CAST(coalesce", "SELECT series_id, 83::BIGINT AS n, 0 AS sd, CAST(coalesce")
       .replace("83::BIGINT AS n", "any_value(n) AS n").replace("FROM kpss GROUP BY 1", "FROM kpss JOIN (SELECT series_id, max(n) AS n FROM p GROUP BY 1) USING (series_id) GROUP BY 1"))
def select_orders_query(spark: SparkSession, sf: str) -> DataFrame:
    return S.select_orders(P.supplier_months(spark, sf), 1)


@query("select_orders_seasonal")
def select_orders_seasonal(spark: SparkSession, sf: str) -> DataFrame:
    return S.select_orders(P.supplier_months(spark, sf), 12)


def customer_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of differencing orders and lengths derived from the customers."""
    key = F.col("c_custkey")
    return P.table(spark, sf, "customer").select(
        key.cast("string").alias("series_id"), (key % 97 + 4).alias("n"), (key % 3).cast("int").alias("d"), (key % 2).cast("int").alias("sd")
    )


CUSTOMERS = "c AS (SELECT CAST(c_custkey AS VARCHAR) AS series_id, c_custkey % 97 + 4 AS n, CAST(c_custkey % 3 AS INTEGER) AS d, CAST(c_custkey % 2 AS INTEGER) AS sd FROM customer)"


@query("constant_rules", f"WITH {CUSTOMERS} SELECT *, d + sd > 1 AS fix_constant, d + sd = 0 AS mean, d + sd = 1 AS drift FROM c")
def constant_rules_query(spark: SparkSession, sf: str) -> DataFrame:
    return S.constant_rules(customer_orders(spark, sf))


@query("constant_rules_given_mean", f"WITH {CUSTOMERS} SELECT *, true AS fix_constant, true AS mean, d + sd = 1 AS drift FROM c")
def constant_rules_given(spark: SparkSession, sf: str) -> DataFrame:
    return S.constant_rules(customer_orders(spark, sf), mean=True)


@query("constant_series_model", "SELECT CAST(l_orderkey AS VARCHAR) AS series_id, 0 AS p, 0 AS d, 0 AS q, 0 AS sp, 0 AS sd, 0 AS sq, true AS mean, false AS drift "
       "FROM lineitem GROUP BY l_orderkey HAVING min(l_discount) = max(l_discount)")  # fmt: skip
def constant_series_query(spark: SparkSession, sf: str) -> DataFrame:
    lines = P.table(spark, sf, "lineitem").withColumn("place", F.struct("l_linenumber", "l_partkey", "l_extendedprice"))
    panel = from_table(lines, ["l_orderkey"], "l_discount", order_by="place")
    return S.constant_series_model(panel)


@query("constant_diff_model", f"WITH {CUSTOMERS} SELECT series_id, n, d, sd, 0 AS p, 0 AS q, 0 AS sp, 0 AS sq, CASE WHEN sd > 0 THEN false ELSE d < 2 END AS mean, sd > 0 AND d = 0 AS drift FROM c")
def constant_diff_query(spark: SparkSession, sf: str) -> DataFrame:
    return S.constant_diff_model(customer_orders(spark, sf))


BOUNDED = f"{CUSTOMERS}, b AS (SELECT *, CAST(least(5, n // 3) AS INTEGER) AS max_p, CAST(least(5, n // 3) AS INTEGER) AS max_q, CAST(least(2, floor(n / 3 * 12)) AS INTEGER) AS max_sp, CAST(least(2, floor(n / 3 * 12)) AS INTEGER) AS max_sq FROM c)"


@query("order_bounds", f"WITH {BOUNDED} SELECT * FROM b")
def order_bounds_query(spark: SparkSession, sf: str) -> DataFrame:
    return S.order_bounds(customer_orders(spark, sf), 12)


def search_state(spark: SparkSession, sf: str) -> DataFrame:
    return S.order_bounds(S.constant_rules(customer_orders(spark, sf)), 12)


STATE = f"{BOUNDED}, st AS (SELECT *, d + sd > 1 AS fix_constant, d + sd = 0 AS mean, d + sd = 1 AS drift FROM b)"
FIVE = "range(0, 6)"
THREE = "range(0, 3)"


@query("grid_candidates", f"""WITH {STATE}, g AS (SELECT series_id, p, q, sp, sq, k = 1 AS mean FROM st, {FIVE} a(p), {FIVE} b2(q), {THREE} c2(sp), {THREE} d2(sq), range(0, 2) e(k)
 WHERE p <= max_p AND q <= max_q AND sp <= max_sp AND sq <= max_sq AND p + q + sp + sq <= 5 AND (k = 0 OR mean OR drift))
 SELECT series_id, count(*) + 1 AS candidates, CAST(sum(p) AS BIGINT) AS sum_p, CAST(sum(sq) AS BIGINT) AS sum_sq, count(*) FILTER (WHERE mean) + any_value(m0) AS with_mean
 FROM g JOIN (SELECT series_id, CAST(mean AS INTEGER) AS m0 FROM st) USING (series_id) GROUP BY 1""")  # fmt: skip
def grid_candidates_query(spark: SparkSession, sf: str) -> DataFrame:
    grid = S.grid_candidates(search_state(spark, sf))
    return grid.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.sum("p").alias("sum_p"), F.sum("sq").alias("sum_sq"), F.count_if("mean").alias("with_mean")
    )


def seeds_sql(seeds) -> str:
    rows = ", ".join(str((i, *s)) for i, s in enumerate(seeds))
    return f"(VALUES {rows}) v(candidate, p, q, sp, sq)"


SEED_OUT = "series_id, candidate, p, q, sp, sq, CASE WHEN candidate = 0 THEN false ELSE mean END AS mean, CASE WHEN candidate = 0 THEN false ELSE drift END AS drift"


def _seeds(s: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return S.seed_candidates(search_state(spark, sf), s).select("series_id", "candidate", "p", "q", "sp", "sq", "mean", "drift")

    return run


for _s, _list in ((1, S.SEEDS[:5]), (12, S.SEEDS)):
    query(f"seed_candidates_{'seasonal' if _s > 1 else 'nonseasonal'}",
          f"WITH {STATE} SELECT {SEED_OUT} FROM st, {seeds_sql(_list)} WHERE p <= max_p AND q <= max_q AND sp <= max_sp AND sq <= max_sq")(_seeds(_s))


def best_state(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("series_id").cast("long")
    return search_state(spark, sf).withColumns(
        {"p": (key % 4).cast("int"), "q": (key % 5 % 3).cast("int"), "sp": (key % 7 % 2).cast("int"), "sq": (key % 11 % 3).cast("int")}
    )


BEST = f"""{STATE}, best AS (SELECT st.*, CAST(CAST(series_id AS BIGINT) % 4 AS INTEGER) AS p, CAST(CAST(series_id AS BIGINT) % 5 % 3 AS INTEGER) AS q,
 CAST(CAST(series_id AS BIGINT) % 7 % 2 AS INTEGER) AS sp, CAST(CAST(series_id AS BIGINT) % 11 % 3 AS INTEGER) AS sq FROM st)"""
MOVED = "p >= 0 AND q >= 0 AND sp >= 0 AND sq >= 0 AND p <= max_p AND q <= max_q AND sp <= max_sp AND sq <= max_sq AND p + q + sp + sq <= 5"
STEP = "(VALUES (-1), (0), (1))"
NEIGHBOUR = ["series_id", "p", "q", "sp", "sq", "mean", "drift"]


def moved_sql(shifts: dict[str, str], tables: str, extra: str) -> str:
    columns = ", ".join(f"CAST({n}{' + ' + shifts[n] if n in shifts else ''} AS INTEGER) AS {n}" for n in ("p", "q", "sp", "sq"))
    return f"WITH {BEST}, m AS (SELECT series_id, max_p, max_q, max_sp, max_sq, d, sd, mean, drift, fix_constant, {columns} FROM best, {tables}) SELECT {', '.join(NEIGHBOUR)} FROM m WHERE {MOVED} AND {extra}"


NONSEASONAL = moved_sql({"p": "i", "q": "j"}, f"{STEP} a(i), {STEP} a2(j)", "p + q > 0")


@query("neighbours_nonseasonal", NONSEASONAL)
def neighbours_nonseasonal_query(spark: SparkSession, sf: str) -> DataFrame:
    return S.neighbours_nonseasonal(best_state(spark, sf)).select(*NEIGHBOUR)


@query("neighbours_seasonal", moved_sql({"sp": "i", "sq": "j"}, f"{STEP} a(i), {STEP} a2(j)", "sp + sq BETWEEN 1 AND 2"))
def neighbours_seasonal_query(spark: SparkSession, sf: str) -> DataFrame:
    return S.neighbours_seasonal(best_state(spark, sf)).select(*NEIGHBOUR)


@query("neighbours_joint", moved_sql({"p": "i", "q": "j", "sp": "k", "sq": "l"}, f"{STEP} a(i), {STEP} a2(j), {STEP} a3(k), {STEP} a4(l)", "p + q > 0 AND sp + sq BETWEEN 1 AND 2"))
def neighbours_joint_query(spark: SparkSession, sf: str) -> DataFrame:
    return S.neighbours_joint(best_state(spark, sf)).select(*NEIGHBOUR)


@query("toggle_constant", NONSEASONAL.replace(f"SELECT {', '.join(NEIGHBOUR)} FROM m", "SELECT series_id, p, q, sp, sq, d + sd <> 1 AND NOT mean AS mean, d + sd = 1 AND NOT drift AS drift FROM m") + " AND NOT fix_constant")
def toggle_query(spark: SparkSession, sf: str) -> DataFrame:
    return S.toggle_constant(S.neighbours_nonseasonal(best_state(spark, sf))).select(*NEIGHBOUR)


MOVES_VALUES = ", ".join(str((i, *m)) for i, m in enumerate(S.MOVES, 1))


@query("stepwise_moves", f"""WITH {BEST}, m AS (SELECT series_id, move, best.p + v.p AS p, best.q + v.q AS q, best.sp + v.sp AS sp, best.sq + v.sq AS sq, max_p, max_q, max_sp, max_sq,
 mean AND move < 17 AS mean, drift AND move < 17 AS drift, mean OR drift AS had FROM best, (VALUES {MOVES_VALUES}) v(move, p, q, sp, sq))
 SELECT series_id, move, p, q, sp, sq, mean, drift FROM m WHERE {MOVED.rsplit(' AND ', 1)[0]} AND (move < 17 OR had)""")  # fmt: skip
def moves_query(spark: SparkSession, sf: str) -> DataFrame:
    return S.moves(best_state(spark, sf)).select("series_id", "move", "p", "q", "sp", "sq", "mean", "drift")


# --- scoring and searches ---------------------------------------------------------------------------

CHOSEN = ["series_id", "model_id", "p", "d", "q", "sp", "sd", "sq", "c", "trend", "ar", "ma", "sar", "sma", "sigma2", "ic"]


def fitter_for(panel: DataFrame, s: int, pairs) -> S.Fitter:
    return S.Fitter(lambda spec: E.fit_models(panel, spec, s, pairs=pairs), s, "aicc", "mse", None, None, True, True)


# without a constant the two candidates are a random walk and an AR(1) of the differences
@query("score_candidates", f"""WITH {CROSS}, z AS (SELECT series_id, max(n) AS n, sum(w * w) AS ww FROM dif GROUP BY 1),
 tail AS (SELECT series_id, sum(w * w) AS ww1 FROM dif WHERE t > 2 GROUP BY 1),
 c AS (SELECT series_id, 0 AS p, (n - 1) * ln(ww / (n - 1)) + 2 + 4.0::DOUBLE / (n - 3) AS ic FROM z
   UNION ALL SELECT series_id, 1, (n - 1) * ln((ww1 - xy * xy / xx) / (n - 3)) + 4 + 12.0::DOUBLE / (n - 4) FROM z JOIN tail USING (series_id) JOIN m USING (series_id))
 SELECT series_id, CAST(arg_min(p, ic) AS INTEGER) AS p, {r('min(ic)')} AS ic FROM c GROUP BY 1""")  # fmt: skip
def score_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.supplier_months(spark, sf)
    flat = {"d": F.lit(1), "q": F.lit(0), "sp": F.lit(0), "sd": F.lit(0), "sq": F.lit(0), "mean": F.lit(False), "drift": F.lit(False)}
    rows = panel.select("series_id").distinct().withColumn("p", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns(flat)
    scored = fitter_for(panel, 1, [(1, 0)]).score(rows).where("admissible")
    best = scored.groupBy("series_id").agg(F.min(F.struct("ic", "p")).alias("b"))
    return rounded(best.select("series_id", F.col("b.p").alias("p"), F.col("b.ic").alias("ic")), "ic")


def _auto(panel, **options):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(S.auto_sarima(panel(spark, sf), **options).select(*CHOSEN), "ic", "sigma2", digits=4)

    return run


query("grid_search")(_auto(P.event_days, s=7, search="grid"))
query("stepwise_naive")(_auto(P.flag_months, s=12, search="stepwiseNaive"))
query("stepwise")(_auto(P.flag_months, s=12))
query("auto_sarima_nonseasonal")(_auto(P.nation_months, s=1, criterion="bic"))
query("auto_sarima_outliers")(_auto(P.flag_months, s=12, outliers=True))

# with one AR lag at most and no constant, every search ends at the better of a random walk and an AR(1)
SEARCH_AR1 = f"""WITH {CROSS}, z AS (SELECT series_id, max(n) AS n, sum(w * w) AS ww FROM dif GROUP BY 1),
 tail AS (SELECT series_id, sum(w * w) AS ww1 FROM dif WHERE t > 2 GROUP BY 1),
 c AS (SELECT series_id, 0 AS p, NULL AS phi, ww AS sse, (n - 1) * ln(ww / (n - 1)) + 2 + 4.0::DOUBLE / (n - 3) AS ic FROM z
   UNION ALL SELECT series_id, 1, xy / xx, ww1 - xy * xy / xx, (n - 1) * ln((ww1 - xy * xy / xx) / (n - 3)) + 4 + 12.0::DOUBLE / (n - 4) FROM z JOIN tail USING (series_id) JOIN m USING (series_id))
 SELECT series_id, CAST(arg_min(p, ic) AS INTEGER) AS p, {r('arg_min(phi, ic)', 5)} AS phi, {r('arg_min(sse, ic)', 5)} AS sse FROM c GROUP BY 1"""


def _search_ar1(search: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        panel = P.supplier_months(spark, sf)
        best = S.auto_sarima(panel, d=1, max_p=1, max_q=0, mean=False, drift=False, search=search)
        phi = F.when(F.col("p") == 1, F.try_element_at("ar", F.lit(1)))
        return rounded(best.select("series_id", F.col("p").cast("int").alias("p"), phi.alias("phi"), "sse"), "phi", "sse", digits=5)

    return run


for _search in ("grid", "stepwiseNaive", "stepwise"):
    query(f"search_ar1_{_search.lower()}", SEARCH_AR1)(_search_ar1(_search))


@query("is_constant_after_difference", f"WITH {SUP}, x AS (SELECT series_id, y - lag(y) OVER (PARTITION BY series_id ORDER BY t) AS w FROM p) SELECT series_id, min(w) = max(w) AS is_constant FROM x WHERE w IS NOT NULL GROUP BY 1")
def constant_difference_query(spark: SparkSession, sf: str) -> DataFrame:
    from panelwright.operators.differencing import difference

    return is_constant(difference(P.supplier_months(spark, sf), 1), ["w"])
