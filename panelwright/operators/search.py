"""Order selection for all series at once: candidates are rows, a search round is one job.

The driver loops over rounds, never over series.  Each round fits the candidates
of every series that is still searching; finished series drop out.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelwright.functions.criteria import log_likelihood, model_criterion, residual_variance
from panelwright.operators.differencing import difference_by_orders, order_pairs
from panelwright.operators.estimate import LINEAR_OBJECTIVES, SPEC_COLUMNS, fit_from_moments, fit_packed, is_linear, pack_series, series_moments, with_criteria
from panelwright.operators.longfit import fit_long
from panelwright.operators.outliers import detect_outliers
from panelwright.operators.panel import check_settings, is_constant, lengths, model_label
from panelwright.operators.unitroot import ndiffs, nsdiffs
from panelwright.plans.blocks import attach, block_rows, restrict
from panelwright.plans.session import checkpoint

MAX_MODELS = 94
MAX_ROUNDS = 100
#: How a search came to its end (column ``stopped_at``).
ENDED, AT_MODELS, AT_ROUNDS = "ended", "model limit", "round limit"
ORDERS = ("p", "q", "sp", "sq")

# The moves of the stepwise search in the order they are tried,
# as changes of (p, q, sp, sq); the last one drops the constant instead.
MOVES = [
    (0, 0, -1, 0),
    (0, 0, 0, -1),
    (0, 0, 1, 0),
    (0, 0, 0, 1),
    (0, 0, -1, -1),
    (0, 0, -1, 1),
    (0, 0, 1, -1),
    (0, 0, 1, 1),
    (-1, 0, 0, 0),
    (0, -1, 0, 0),
    (1, 0, 0, 0),
    (0, 1, 0, 0),
    (-1, -1, 0, 0),
    (-1, 1, 0, 0),
    (1, -1, 0, 0),
    (1, 1, 0, 0),
    (0, 0, 0, 0),
]
DROP_CONSTANT = len(MOVES)

# Start models of the naive search as (p, q, sp, sq); the first two
# are the null model without and with the constant, the last three are seasonal.
SEEDS = [(0, 0, 0, 0), (0, 0, 0, 0), (1, 0, 0, 0), (0, 1, 0, 0), (2, 2, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1), (2, 2, 1, 1)]


def _rows(options: Sequence[Sequence[int]], names: Sequence[str]) -> Column:
    """A literal list as an array to explode: candidates are made without a join."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, option)]) for option in options])


# --- orders and constants ----------------------------------------------------------------------------


def select_orders(
    panel: DataFrame,
    s: int = 1,
    d: int | None = None,
    D: int | None = None,
    maxd: int = 2,
    seasonal_test: str = "ocsb",
    exog: DataFrame | None = None,
    exog_columns: Sequence[str] = (),
    longest: int | None = None,
) -> DataFrame:
    """Differencing orders ``d, sd`` per series: given ones, or the tested ones.

    An order is lowered by one where it would make a regressor constant or leave no rows.
    """
    ends = lengths(panel)
    if s == 1:
        orders = ends.withColumn("sd", F.lit(0))
    elif D is not None:
        orders = ends.withColumn("sd", F.lit(D))
    else:
        tested = ends.join(nsdiffs(panel, s, seasonal_test), "series_id", "left")
        orders = tested.withColumn("sd", F.when(F.col("n") < 2 * s, 0).otherwise(F.coalesce("sd", F.lit(0))))
        orders = checkpoint(orders)
        if exog is not None:
            orders = _lower_for_exog(panel, orders.withColumn("d", F.lit(0)), "sd", s, exog, exog_columns).drop("d")
        orders = orders.withColumn("sd", F.when((F.col("sd") > 0) & (F.col("n") <= F.col("sd") * s), F.col("sd") - 1).otherwise(F.col("sd")))
    if d is not None:
        return orders.select("series_id", "n", F.lit(d).alias("d"), "sd")
    with_sd = attach(panel.select("series_id", "ts", "t", "y"), orders).drop("n", "blk")
    found = ndiffs(with_sd, maxd, "sd", s, "y", longest=longest, max_sd=max(1, D or 0))
    orders = checkpoint(orders.join(found, "series_id", "left").withColumn("d", F.coalesce("d", F.lit(maxd))))
    if exog is not None:
        orders = _lower_for_exog(panel, orders, "d", s, exog, exog_columns)
    gone = (F.col("d") > 0) & (F.col("n") <= F.col("d") + F.col("sd") * s)
    return orders.withColumn("d", F.when(gone, F.col("d") - 1).otherwise(F.col("d"))).select("series_id", "n", "d", "sd")


def _lower_for_exog(panel: DataFrame, orders: DataFrame, which: str, s: int, exog: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lower order ``which`` where any regressor is constant after differencing with the orders."""
    keys = ["series_id", "variable"]
    known = exog if "t" in exog.columns else exog.join(panel.select("series_id", "ts", "t"), ["series_id", "ts"])
    long = known.unpivot(["series_id", "t"], list(columns), "variable", "y").withColumn("y", F.col("y").cast("double"))
    rows = attach(long, orders.select("series_id", "n", "d", "sd"), ["series_id"]).drop("n", "blk")
    flat = is_constant(difference_by_orders(rows, order_pairs(orders), s, "y", "w", keys), ["w"], keys).where("is_constant")
    flagged = flat.select("series_id").distinct().withColumn("_flat", F.lit(True))
    lower = F.when(F.col("_flat") & (F.col(which) > 0), F.col(which) - 1).otherwise(F.col(which))
    return orders.join(flagged, "series_id", "left").withColumn(which, lower).drop("_flat")


def constant_rules(orders: DataFrame, mean: bool | None = None, drift: bool | None = None) -> DataFrame:
    """Add ``mean, drift, fix_constant`` from the orders and what the caller fixed."""
    total = F.col("d") + F.col("sd")
    return orders.withColumns(
        {
            "fix_constant": F.lit(mean is not None or drift is not None) | (total > 1),
            "mean": F.lit(mean) if mean is not None else total == 0,
            "drift": F.lit(drift) if drift is not None else total == 1,
        }
    )


def constant_series_model(panel: DataFrame, mean: bool | None = None) -> DataFrame:
    """Specification (0,0,0) with mean for constant series."""
    flat = is_constant(panel, ["y"]).where("is_constant").select("series_id")
    zero = {k: F.lit(0) for k in ("p", "d", "q", "sp", "sd", "sq")}
    return flat.withColumns(zero | {"mean": F.lit(True if mean is None else mean), "drift": F.lit(False)})


def constant_diff_model(orders: DataFrame, exog: bool = False) -> DataFrame:
    """Constants of a series that is constant after differencing by ``d, sd``."""
    d, sd = F.col("d"), F.col("sd")
    if exog:
        mean, drift = F.lit(False), F.lit(False)
    else:
        polynomial = F.raise_error(F.lit("data follow a simple polynomial and are not suitable for ARIMA modelling"))
        mean = (
            F.when(sd > 0, False).when(d == 2, False).when(d < 2, True).otherwise(polynomial.cast("boolean"))
        )
        drift = (sd > 0) & (d == 0)
    zero = {k: F.lit(0) for k in ("p", "q", "sp", "sq")}
    return orders.withColumns(zero | {"mean": mean, "drift": drift})


def order_bounds(orders: DataFrame, s: int, max_p: int = 5, max_q: int = 5, max_sp: int = 2, max_sq: int = 2) -> DataFrame:
    """Add the largest orders a series of ``n`` rows admits."""
    third = F.floor(F.col("n") / 3).cast("int")
    seasonal = F.floor(F.col("n") / 3 * s).cast("int")
    return orders.withColumns(
        {
            "max_p": F.least(F.lit(max_p), third),
            "max_q": F.least(F.lit(max_q), third),
            "max_sp": F.lit(0) if s == 1 else F.least(F.lit(max_sp), seasonal),
            "max_sq": F.lit(0) if s == 1 else F.least(F.lit(max_sq), seasonal),
        }
    )


# --- candidates --------------------------------------------------------------------------------------


def _within(*names: str) -> Column:
    ok = F.lit(True)
    for n in names:
        ok = ok & (F.col(n) >= 0) & (F.col(n) <= F.col(f"max_{n}"))
    return ok


def grid_candidates(state: DataFrame, max_order: int = 5) -> DataFrame:
    """All orders within the bounds with a sum of at most ``max_order``, with and without mean.

    ``candidate`` numbers them in loop order; 0 is the null model the search starts from.
    """
    constant = F.col("mean") | F.col("drift")
    null = state.withColumns({n: F.lit(0) for n in ORDERS} | {"candidate": F.lit(0)})
    grid = state
    for n in ORDERS:
        grid = grid.withColumn(n, F.explode(F.sequence(F.lit(0), F.col(f"max_{n}"))))
    grid = (
        grid.where(F.col("p") + F.col("q") + F.col("sp") + F.col("sq") <= max_order)
        .withColumn("_k", F.explode(F.sequence(F.lit(0), constant.cast("int"))))
        .withColumn("candidate", (1 + (((F.col("p") * 64 + F.col("q")) * 16 + F.col("sp")) * 16 + F.col("sq")) * 2 + F.col("_k")).cast("int"))
        .withColumns({"mean": F.col("_k") == 1, "drift": F.lit(False)})
        .drop("_k")
    )
    return null.unionByName(grid)


def seed_candidates(state: DataFrame, s: int) -> DataFrame:
    """Start models of the naive search inside the bounds; the seasonal ones only for s > 1."""
    seeds = [(i, *orders) for i, orders in enumerate(SEEDS if s > 1 else SEEDS[:5])]
    rows = state.withColumn("_seed", F.explode(_rows(seeds, ["candidate", *ORDERS]))).select("*", "_seed.*").drop("_seed")
    plain = F.col("candidate") == 0
    return rows.where(_within(*ORDERS)).withColumns(
        {"mean": F.when(plain, False).otherwise(F.col("mean")), "drift": F.when(plain, False).otherwise(F.col("drift"))}
    )


def _neighbours(best: DataFrame, offsets: Sequence[tuple[int, int, int, int]], max_order: int) -> DataFrame:
    names = [f"_{n}" for n in ORDERS]
    numbered = [(i, *o) for i, o in enumerate(offsets)]
    moved = best.withColumn("_move", F.explode(_rows(numbered, ["candidate", *names]))).select("*", "_move.*").drop("_move")
    moved = moved.withColumns({n: F.col(n) + F.col(f"_{n}") for n in ORDERS}).drop(*names)
    return moved.where(_within(*ORDERS) & (F.col("p") + F.col("q") + F.col("sp") + F.col("sq") <= max_order))


UNIT = (-1, 0, 1)


def neighbours_nonseasonal(best: DataFrame, max_order: int = 5) -> DataFrame:
    """p and q moved by at most one, not both zero."""
    return _neighbours(best, [(i, j, 0, 0) for i in UNIT for j in UNIT], max_order).where("p + q > 0")


def neighbours_seasonal(best: DataFrame, max_order: int = 5) -> DataFrame:
    """Seasonal orders moved by at most one, with a sum of 1 or 2."""
    return _neighbours(best, [(0, 0, i, j) for i in UNIT for j in UNIT], max_order).where("sp + sq BETWEEN 1 AND 2")


def neighbours_joint(best: DataFrame, max_order: int = 5) -> DataFrame:
    """All four orders moved by at most one at once."""
    offsets = [(i, j, k, m) for i in UNIT for j in UNIT for k in UNIT for m in UNIT]
    return _neighbours(best, offsets, max_order).where("p + q > 0 AND sp + sq BETWEEN 1 AND 2")


def toggle_constant(candidates: DataFrame) -> DataFrame:
    """The same orders with the constant switched; only where it is not fixed."""
    drift = F.col("d") + F.col("sd") == 1
    return candidates.where(~F.col("fix_constant")).withColumns(
        {"drift": drift & ~F.col("drift"), "mean": ~drift & ~F.col("mean")}
    )


def moves(state: DataFrame) -> DataFrame:
    """The 17 stepwise moves of every state row that stay inside the bounds, numbered from 1."""
    numbered = [(i, *m) for i, m in enumerate(MOVES, 1)]
    rows = state.withColumn("_m", F.explode(_rows(numbered, ["move", *[f"_{n}" for n in ORDERS]]))).select("*", "_m.*").drop("_m")
    rows = rows.withColumns({n: F.col(n) + F.col(f"_{n}") for n in ORDERS}).drop(*[f"_{n}" for n in ORDERS])
    drop = F.col("move") == DROP_CONSTANT
    rows = rows.where(_within(*ORDERS) & (~drop | F.col("mean") | F.col("drift")))
    return rows.withColumns({"mean": F.col("mean") & ~drop, "drift": F.col("drift") & ~drop})


# --- searches ----------------------------------------------------------------------------------------


@dataclass
class Fitter:
    """Fits candidate rows of the prepared panel and scores them."""

    fit: Callable[[DataFrame], DataFrame]
    s: int
    criterion: str
    objective: str
    lam: float | None
    alpha: float | None
    assert_stationary: bool
    assert_invertible: bool
    offsets: DataFrame | None = None

    def specs(self, candidates: DataFrame, penalty: bool = True) -> DataFrame:
        rows = candidates.withColumns(
            {
                "s": F.lit(self.s),
                "objective": F.lit(self.objective),
                "lambda": F.lit(self.lam if penalty else None).cast("double"),
                "alpha": F.lit(self.alpha).cast("double"),
            }
        )
        return rows.withColumn("model_id", model_label())

    def score(self, candidates: DataFrame, penalty: bool = True) -> DataFrame:
        """Fits of the distinct candidates with ``ic`` and ``admissible``; a fit that did not converge is not admissible."""
        spec = self.specs(candidates, penalty).select(*SPEC_COLUMNS).dropDuplicates(["series_id", "model_id"])
        fits = self.fit(spec)
        offset: Column | float = 0.0
        if self.offsets is not None:
            fits = fits.join(self.offsets, "series_id")
            offset = F.col("offset")
        scored = with_criteria(fits, self.s, offset)
        v = F.col("sigma2")
        ic = model_criterion(self.criterion)(F.col("n_t"), F.col("k"), v, offset)
        ok = F.coalesce("converged", F.lit(False))
        if self.assert_stationary:
            ok = ok & F.col("stationary")
        if self.assert_invertible:
            ok = ok & F.col("invertible")
        perfect = F.when(v == 0, F.lit(-math.inf))
        return scored.withColumn("ic", F.coalesce(perfect, ic, F.lit(math.inf))).withColumn("admissible", ok).drop("offset")


def grid_search(state: DataFrame, fitter: Fitter, max_order: int = 5) -> DataFrame:
    """Fit every candidate; lowest criterion wins, the earlier candidate on ties."""
    candidates = checkpoint(fitter.specs(grid_candidates(state, max_order)))
    fits = checkpoint(fitter.score(candidates))
    scored = candidates.select("series_id", "model_id", "candidate").join(fits, ["series_id", "model_id"])
    eligible = scored.where(F.col("admissible") | (F.col("candidate") == 0))
    best = eligible.groupBy("series_id").agg(F.min(F.struct(F.round("ic", 8).alias("ic"), "candidate", "model_id")).alias("_best"))
    return fits.join(best.select("series_id", F.col("_best.model_id").alias("model_id")), ["series_id", "model_id"]).withColumn("stopped_at", F.lit(ENDED))


def code(model: Column | None = None) -> Column:
    """Number of a model in a mixed radix of its orders and constants: what a search remembers of a candidate.

    The model is a struct, or the row itself.
    """
    value = F.col if model is None else lambda name: model[name]
    out = F.lit(0).cast("long")
    for name in ORDERS:
        out = out * 64 + value(name)
    return out * 4 + value("mean").cast("int") * 2 + value("drift").cast("int")


FITTED = "map<bigint,struct<ic:double,admissible:boolean>>"


def _by_code(scored: DataFrame, name: str = "_new") -> DataFrame:
    """One row a series: criterion and admissibility of its fitted models by their codes."""
    fits = scored.select("series_id", code().alias("code"), F.struct("ic", "admissible").alias("fit"))
    return fits.groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("code", "fit"))).alias(name))


def _chosen(state: DataFrame, best: DataFrame, fitter: Fitter, penalty: bool = True) -> DataFrame:
    """The fits of the best models (series_id, best struct of orders and constants, stopped_at)."""
    rows = state.drop(*ORDERS, "mean", "drift").join(best, "series_id").select("*", *[F.col(f"best.{n}").alias(n) for n in (*ORDERS, "mean", "drift")])
    return fitter.score(rows, penalty).join(best.select("series_id", "stopped_at"), "series_id")


def _best(scored: DataFrame) -> DataFrame:
    """The admissible model with the lowest criterion, the earlier candidate on ties: series_id, ic, best."""
    rank = F.struct(F.round("ic", 8).alias("ic"), F.col("candidate"), F.struct(*ORDERS, "mean", "drift").alias("best"))
    return scored.where("admissible").groupBy("series_id").agg(F.min(rank).alias("_b")).select("series_id", "_b.ic", "_b.best")


def stepwise_naive(state: DataFrame, fitter: Fitter, max_order: int = 5, joint: bool = False, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Rounds of neighbours around the best model until no round lowers the criterion.

    A series carries the codes of the models it has fitted, so a round reads one row a series, whatever went before.
    """
    base = state.drop(*ORDERS)
    seeds = checkpoint(fitter.specs(seed_candidates(base, fitter.s), penalty=False))
    scored = checkpoint(_scored(seeds, fitter))
    seen = scored.groupBy("series_id").agg(F.collect_set(code()).alias("seen"))
    search = checkpoint(base.select("series_id").join(_best(scored), "series_id").join(seen, "series_id").withColumn("active", F.lit(True)))
    for _ in range(max_rounds):
        centre = search.where("active").select("series_id", "seen", *[F.col(f"best.{n}").alias(n) for n in ORDERS]).join(base, "series_id")
        found = neighbours_nonseasonal(centre, max_order)
        if fitter.s > 1:
            found = found.unionByName(neighbours_seasonal(centre, max_order).withColumn("candidate", F.col("candidate") + 9))
            if joint:
                found = found.unionByName(neighbours_joint(centre, max_order).withColumn("candidate", F.col("candidate") + 18))
        found = found.withColumn("candidate", F.col("candidate") * 2)
        found = found.unionByName(toggle_constant(found).withColumn("candidate", F.col("candidate") + 1))
        fresh = checkpoint(fitter.specs(found.where(~F.array_contains("seen", code())).drop("seen"), penalty=False))
        if fresh.isEmpty():
            search = search.withColumn("active", F.lit(False))
            break
        scored = checkpoint(_scored(fresh, fitter))
        tried = scored.groupBy("series_id").agg(F.collect_set(code()).alias("_tried"))
        rows = search.join(tried, "series_id", "left").join(_best(scored).select("series_id", F.col("ic").alias("_ic"), F.col("best").alias("_best")), "series_id", "left")
        better = F.coalesce(F.col("active") & (F.col("_ic") <= F.col("ic")), F.lit(False))
        search = checkpoint(
            rows.select(
                "series_id", F.when(better, F.col("_ic")).otherwise(F.col("ic")).alias("ic"), F.when(better, F.col("_best")).otherwise(F.col("best")).alias("best"),
                F.array_union("seen", F.coalesce("_tried", F.array().cast("array<bigint>"))).alias("seen"), better.alias("active"),
            )
        )
        if search.where("active").isEmpty():
            break
    best = search.select("series_id", "best", F.when(F.col("active"), AT_ROUNDS).otherwise(ENDED).alias("stopped_at"))
    return _chosen(state, best, fitter, penalty=False)


def _scored(specs: DataFrame, fitter: Fitter) -> DataFrame:
    """Candidate rows with the criterion and admissibility of their fits; equal models of a series are fitted once."""
    fits = fitter.score(specs, penalty=False).select("series_id", "model_id", "ic", "admissible")
    return specs.select("series_id", "model_id", "candidate", *ORDERS, "mean", "drift").join(fits, ["series_id", "model_id"])


def open_moves() -> Column:
    """Stepwise moves of a state row that stay inside the bounds and were not visited, in their order."""
    listed = F.from_json(F.lit(json.dumps(MOVES)), "array<array<int>>")

    def moved(shift: Column, at: Column) -> Column:
        keeps = at + 1 != DROP_CONSTANT
        orders = [(F.col(n) + shift[i]).alias(n) for i, n in enumerate(ORDERS)]
        return F.struct((at + 1).alias("move"), *orders, (F.col("mean") & keeps).alias("mean"), (F.col("drift") & keeps).alias("drift"))

    def wanted(m: Column) -> Column:
        ok = (m["move"] != DROP_CONSTANT) | F.col("mean") | F.col("drift")
        for n in ORDERS:
            ok = ok & m[n].between(F.lit(0), F.col(f"max_{n}"))
        return ok & ~F.array_contains("visited", code(m))

    return F.filter(F.transform(listed, moved), wanted)


def stepwise(state: DataFrame, fitter: Fitter, start: tuple[int, int, int, int] = (2, 2, 1, 1), max_models: int = MAX_MODELS) -> DataFrame:
    """Hyndman-Khandakar search: from the best start model, the first improving move wins.

    A round fits all open moves of every series at once and takes the improving
    move with the lowest number; only moves up to it count as visited.  Fits are
    deterministic, so orders, visited set and model count equal those of trying
    the moves one at a time.

    A series' row holds the codes it has visited and the criteria of the models it has fitted; a round joins the new
    fits to that row and decides within it, so plan and tables stay the same from round to round.
    """
    base = state.drop(*ORDERS)
    constant = F.col("mean") | F.col("drift")
    bound = lambda n, v: F.least(F.lit(v), F.col(f"max_{n}"))
    one = lambda n: F.least(F.lit(1), F.col(f"max_{n}"))
    zero = F.lit(0)
    # number: orders, mean, drift, condition
    starts = [
        ([bound(n, v) for n, v in zip(ORDERS, start)], constant, F.lit(False), F.lit(True)),
        ([zero] * 4, constant, F.lit(False), F.lit(True)),
        ([one("p"), zero, one("sp"), zero], F.col("mean"), F.col("drift"), (F.col("max_p") > 0) | (F.col("max_sp") > 0)),
        ([zero, one("q"), zero, one("sq")], F.col("mean"), F.col("drift"), (F.col("max_q") > 0) | (F.col("max_sq") > 0)),
        ([zero] * 4, F.lit(False), F.lit(False), constant),
    ]
    options = F.array(
        *[
            F.struct(
                F.lit(i).alias("candidate"),
                *[o.cast("int").alias(n) for n, o in zip(ORDERS, orders)],
                mean.alias("mean"),
                drift.alias("drift"),
                condition.alias("wanted"),
            )
            for i, (orders, mean, drift, condition) in enumerate(starts, 1)
        ]
    )
    flags = base.withColumn("_o", F.explode(options)).drop("mean", "drift").select("*", "_o.*").drop("_o").where("wanted").drop("wanted")
    opened = checkpoint(fitter.specs(flags))
    scored = checkpoint(
        opened.select("series_id", "candidate", "model_id", *ORDERS, "mean", "drift").join(fitter.score(opened).select("series_id", "model_id", "ic", "admissible"), ["series_id", "model_id"])
    )
    model = F.struct(*ORDERS, "mean", "drift")
    by_number = scored.groupBy("series_id").agg(
        F.map_from_entries(F.collect_list(F.struct("candidate", F.struct("ic", "admissible", model.alias("model"))))).alias("_s"),
        F.count_distinct("candidate").cast("int").alias("k"),
        F.collect_set(code()).alias("visited"),
    )
    at = lambda i: F.try_element_at("_s", F.lit(i))
    best = F.when(at(1)["admissible"], at(1)).otherwise(at(2))
    centre = at(1)
    for i in range(2, 6):
        wins = F.coalesce(at(i)["admissible"] & (at(i)["ic"] < best["ic"]), F.lit(False))
        centre = F.when(wins, at(i)).otherwise(centre)
        best = F.when(wins, at(i)).otherwise(best)
    search = base.join(by_number, "series_id").join(_by_code(scored.dropDuplicates(["series_id", "model_id"]), "known"), "series_id").withColumns({"_best": best, "_centre": centre})
    search = search.select(
        *base.columns, "k", "visited", "known", F.col("_best.ic").alias("ic"), F.col("_best.model").alias("best"), F.lit(None).cast("string").alias("stopped_at"),
        *[F.col(f"_centre.model.{n}").alias(n) for n in ORDERS],
    )
    columns = search.columns
    search, finished = checkpoint(search), []
    while True:
        rows = search.withColumn("_left", open_moves()).withColumn("_open", F.slice("_left", F.lit(1), F.greatest(F.lit(max_models) - F.col("k"), F.lit(0))))
        missing = F.filter("_open", lambda m: ~F.map_contains_key("known", code(m)))
        fresh = fitter.specs(rows.select(*[c for c in base.columns if c not in ("mean", "drift")], F.explode(missing).alias("_m")).select("*", *[F.col(f"_m.{n}").alias(n) for n in (*ORDERS, "mean", "drift")]).drop("_m"))
        rows = rows.join(_by_code(fitter.score(fresh)), "series_id", "left")
        rows = rows.withColumn("known", F.when(F.col("_new").isNull(), F.col("known")).otherwise(F.map_concat("known", F.col("_new"))))
        ahead = lambda m: F.coalesce(F.try_element_at("known", code(m))["admissible"] & (F.try_element_at("known", code(m))["ic"] < F.col("ic")), F.lit(False))
        rows = rows.withColumn("_place", F.array_position(F.transform("_open", ahead), True).cast("int"))
        won, first = F.col("_place") > 0, F.greatest("_place", F.lit(1))
        winner = F.when(won, F.element_at("_open", first))
        rows = rows.withColumn("_winner", winner)
        tried = F.transform(F.when(won, F.slice("_open", F.lit(1), first)).otherwise(F.col("_open")), code)
        stopped = F.when(F.size("_left") > F.size("_open"), AT_MODELS).otherwise(ENDED)
        model = F.struct(*[F.col(f"_winner.{n}").alias(n) for n in (*ORDERS, "mean", "drift")])
        new = {n: F.coalesce(f"_winner.{n}", n) for n in ORDERS} | {
            "visited": F.array_union("visited", tried), "k": F.when(won, F.col("k") + F.col("_place")).otherwise(F.col("k")), "stopped_at": F.when(~won, stopped),
            "ic": F.when(won, F.try_element_at("known", code(F.col("_winner")))["ic"]).otherwise(F.col("ic")), "best": F.when(won, model).otherwise(F.col("best")),
        }
        moved = rows.select(*[new[c].alias(c) if c in new else c for c in columns])
        search = checkpoint(moved.select(*columns))
        finished.append(search.where("stopped_at IS NOT NULL").select("series_id", "best", "stopped_at"))
        search = search.where("stopped_at IS NULL")
        if search.isEmpty():
            break
    chosen = finished[0]
    for part in finished[1:]:
        chosen = chosen.unionByName(part)
    return _chosen(state, checkpoint(chosen), fitter)


def auto_sarima(
    panel: DataFrame,
    s: int = 1,
    exog: DataFrame | None = None,
    exog_columns: Sequence[str] = (),
    d: int | None = None,
    D: int | None = None,
    max_p: int = 5,
    max_d: int = 2,
    max_q: int = 5,
    max_sp: int = 2,
    max_sd: int = 1,
    max_sq: int = 2,
    max_order: int = 5,
    criterion: str = "aicc",
    mean: bool | None = None,
    drift: bool | None = None,
    seasonal_test: str = "ocsb",
    objective: str = "mse",
    assert_stationary: bool = True,
    assert_invertible: bool = True,
    outliers: bool = False,
    search: str = "stepwise",
    lam: float | None = None,
    alpha: float | None = None,
    longest: int | None = None,
    max_models: int = MAX_MODELS,
    max_rounds: int = MAX_ROUNDS,
) -> DataFrame:
    """Choose and fit a model for every series; one row of coefficients and criteria each."""
    check_settings(objective, criterion, "kpss", seasonal_test, search, s, lam, alpha, [max_p, max_d, max_q, max_sp, max_sd, max_sq])
    if (d is not None and not 0 <= d <= max_d) or (D is not None and not 0 <= D <= max_sd):
        raise ValueError("given orders must lie between 0 and their maximum")
    if objective != "elastic_net" and (lam is not None or alpha is not None):
        raise ValueError("lambda and alpha belong to the elastic_net objective")
    if mean and drift:
        raise ValueError("mean and drift are both an intercept of the differenced series: allow one of them")
    # every round reads the panel again: it is made once
    panel = checkpoint(panel)
    exog = None if exog is None else checkpoint(exog)
    flat = checkpoint(constant_series_model(panel, mean))
    varied = restrict(panel, lengths(panel).join(flat.select("series_id"), "series_id", "left_anti"))
    orders = checkpoint(select_orders(varied, s, d, D, max_d, seasonal_test, exog, exog_columns, longest))
    used = sorted({*order_pairs(orders), *order_pairs(flat)})
    rules = constant_rules(orders, mean, drift)
    rows = attach(varied.select("series_id", "ts", "t", "y"), orders.select("series_id", "n", "d", "sd")).drop("n", "blk")
    level = is_constant(difference_by_orders(rows, used, s), ["w"]).where("is_constant").select("series_id")
    level = checkpoint(level.join(orders.where("d + sd > 0"), "series_id", "left_semi"))
    state = checkpoint(order_bounds(rules.join(level, "series_id", "left_anti"), s, max_p, max_q, max_sp, max_sq))
    fixed = constant_diff_model(orders.join(level, "series_id").drop("n"), exog is not None).unionByName(flat)

    every = orders.select("series_id", "d", "sd").unionByName(flat.select("series_id", "d", "sd"))
    dummies = checkpoint(_dummy_positions(varied, orders, s, exog, exog_columns)) if outliers else None
    # candidates without MA terms are solved from moments, measured once; the others from arrays or, where a series is long, block passes
    moments, most_sp = None, max_sp if s > 1 else 0
    if exog is None and dummies is None:
        moments = checkpoint(series_moments(panel, every, s, max_p, most_sp, used))
    packed, any_long = None, False
    if moments is None or max_q > 0 or (s > 1 and max_sq > 0) or objective not in LINEAR_OBJECTIVES:
        packed = pack_series(panel, every, s, exog, exog_columns, used)
        packed = checkpoint(packed if dummies is None else packed.join(dummies, "series_id", "left"))
        any_long = not lengths(panel).where(F.col("n") > block_rows(panel)).isEmpty()

    def fit(spec: DataFrame) -> DataFrame:
        linear = is_linear() if moments is not None else F.lit(False)
        parts = [] if moments is None else [fit_from_moments(moments, spec.where(linear), max_p, most_sp, s)]
        if packed is not None:
            parts.append(fit_packed(packed, spec.where(~linear), s, exog_columns))
            long_fits = fit_long(panel, spec.where(~linear), s, exog, exog_columns, pairs_=used, dummies=dummies) if any_long else None
            parts += [] if long_fits is None else [long_fits]
        fits = parts[0]
        for part in parts[1:]:
            fits = fits.unionByName(part)
        return fits

    fitter = Fitter(fit, s, criterion, objective, lam, alpha, assert_stationary, assert_invertible)
    simple = Fitter(fit, s, criterion, "mse", None, None, False, False)
    null = state.withColumns({n: F.lit(0) for n in ORDERS} | {"mean": F.lit(True), "drift": F.lit(False)})
    base_fits = simple.fit(simple.specs(null).select(*SPEC_COLUMNS))
    sigma2 = residual_variance(F.col("sse"), F.col("n_resid"), F.col("k_var"))
    length = F.col("n_t") + F.col("d") + F.col("sd") * s
    offset = F.when(sigma2 > 0, -2.0 * log_likelihood(F.col("n_resid"), F.col("sse"), sigma2) - length * F.log(sigma2)).otherwise(0.0)
    fitter.offsets = checkpoint(base_fits.select("series_id", offset.alias("offset")))
    method = {"stepwise": stepwise, "stepwiseNaive": stepwise_naive, "grid": grid_search}[search]
    limits = {"stepwise": {"max_models": max_models}, "stepwiseNaive": {"max_order": max_order, "max_rounds": max_rounds}, "grid": {"max_order": max_order}}
    chosen = method(state, fitter, **limits[search])
    if not fixed.isEmpty():
        chosen = chosen.unionByName(simple.score(fixed).withColumn("stopped_at", F.lit(ENDED)).select(*chosen.columns))
    # positions of the dummies, whose coefficients follow those of the regressors in beta
    return chosen if dummies is None else chosen.join(dummies, "series_id", "left")


def _dummy_positions(panel: DataFrame, orders: DataFrame, s: int, exog: DataFrame | None, exog_columns: Sequence[str]) -> DataFrame:
    """Positions of outlying null-model residuals per series, one detection per pair of orders."""
    parts = []
    for d, D in order_pairs(orders):
        wanted = restrict(panel, orders.where((F.col("d") == d) & (F.col("sd") == D)))
        parts.append(detect_outliers(wanted, d, D, s, exog, exog_columns))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy("series_id").agg(F.sort_array(F.collect_list("dummy_t")).alias("dummies"))
