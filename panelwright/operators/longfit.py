"""Fits of series too long for one task: Gauss-Newton by passes over blocks.

The MA polynomial is a linear filter, so residuals and their derivatives come
from two filtered copies of the target and the linear regressors: once filtered
they combine to the residuals, twice filtered to the derivatives by the MA
coefficients.  A pass over the blocks from a zero start gives end states, which
are chained exactly over the blocks of a series; a second pass from the true
starts adds up the moments of residuals and derivatives.  Each iteration is a
constant number of jobs over all long series and candidates together.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.kernel import ROUNDS, Layout, _bounded_step, grid_minima, next_gain, start_points, step_is_small
from panelwright.operators.minimax import SETTLED, WORTH, chebyshev
from panelwright.operators.moments import full_matrix, pairs
from panelwright.operators.panel import lengths
from panelwright.operators.residuals import end_state, recurse, step_matrix
from panelwright.plans.blocks import attach, block_rows, restrict, with_lags
from panelwright.plans.session import checkpoint

SERIES = ["series_id", "d", "sd"]
PATH_STEPS = 10

# What each objective minimises in turn: the norm of the residuals, 1 or 2, or their extremes.
EXTREMES = 0
PHASES = {"mae": [2, 1], "stable": [2, EXTREMES]}

STATE = (
    "series_id string, model_id string, d int, sd int, p int, q int, sp int, sq int, mean boolean, drift boolean, objective string, "
    "alpha double, lambda double, n long, free array<boolean>, b array<double>, trial array<double>, value double, gram array<double>, "
    "sse double, sae double, worst double, n_resid long, n_w long, recent array<double>, mu double, calm int, phase int, ref double, last array<double>, gain double, done boolean, "
    "bound double, radius double, pool array<array<double>>"
)
FIELDS = [f.split()[0] for f in STATE.split(", ")]


def fit_long(
    panel: DataFrame,
    spec: DataFrame,
    s: int,
    exog: DataFrame | None = None,
    exog_columns: Sequence[str] = (),
    given: bool = False,
    pairs_: Sequence[tuple[int, int]] | None = None,
    df: str = "residuals",
    dummies: DataFrame | None = None,
) -> DataFrame | None:
    """Fits of the specification rows whose series exceed one block; None if there are none.

    ``dummies`` (series_id, dummies) lists positions that get a regressor of their own each.
    """
    from panelwright.operators.estimate import differenced

    limit = block_rows(panel)
    ends = lengths(panel).where(F.col("n") > limit)
    marks = ends.withColumn("dummies", F.array().cast("array<bigint>"))
    if dummies is not None:
        marks = ends.join(dummies, "series_id", "left").withColumn("dummies", F.coalesce("dummies", F.array().cast("array<bigint>")))
    wanted = spec.join(marks.withColumn("n_marks", F.size("dummies")).drop("dummies"), "series_id")
    most = wanted.agg(*[F.max(c).alias(c) for c in ("p", "sp", "q", "sq", "n_marks")]).first()
    if most is None or most["p"] is None:
        return None
    given_columns = list(exog_columns)
    exog_columns = [*given_columns, *[f"_mark{i}" for i in range(most["n_marks"])]]
    layout = Layout(len(exog_columns), most["p"], most["sp"], most["q"], most["sq"], s)
    rows = differenced(restrict(panel, ends), wanted, s, exog, pairs_).where("w IS NOT NULL")
    for c in given_columns:
        rows = rows.where(F.col(c).isNotNull())
    if most["n_marks"]:
        rows = attach(rows.drop("n", "blk"), marks)
        mark = lambda i: F.coalesce(F.try_element_at("dummies", F.lit(i + 1)) == F.col("t"), F.lit(False)).cast("double")
        rows = rows.withColumns({f"_mark{i}": mark(i) for i in range(most["n_marks"])}).drop("dummies")
    lags = {f"lag_{i}": ("w", i) for i in sorted(set(layout.ar_lags))}
    rows = with_lags(rows.select(*SERIES, "t", "tw", "w", *exog_columns), lags, SERIES).fillna(0.0, list(lags))
    # stored by block, so no pass has to shuffle the rows again
    spark = panel.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    rows = checkpoint(rows.repartition(tasks, *SERIES, "blk"))
    active = checkpoint(_start(wanted, panel, rows, layout, given, df))
    if not wanted.where("objective = 'bilevel_global' AND q + sq > 0").isEmpty():
        gridded = (F.col("objective") == "bilevel_global") & F.col("model_id").contains("#")
        measured = _measure(rows, active.where(gridded), layout, exog_columns, s, limit)
        active = checkpoint(active.where(~gridded).unionByName(_minima(active.where(gridded), measured, layout)))
    finished = []
    for _ in range(ROUNDS):
        state = checkpoint(_advance(active, _measure(rows, active, layout, exog_columns, s, limit), layout))
        finished.append(state.where("done"))
        active = state.where("NOT done")
        if active.isEmpty():
            break
    state = active
    for part in finished:
        state = state.unionByName(part)
    return _finish(state, layout, s, given, df, len(given_columns))


def _start(wanted: DataFrame, panel: DataFrame, rows: DataFrame, layout: Layout, given: bool, df: str) -> DataFrame:
    """State rows at the origin; an elastic net without a penalty becomes one row per step of its path, a global search one per start."""
    from panelwright.operators.estimate import GIVEN_COLUMNS, lambda_path_panel

    k = F.col("p") + F.col("q") + F.col("sp") + F.col("sq") + F.col("mean").cast("int") + F.col("drift").cast("int") + 1
    open_path = (F.col("objective") == "elastic_net") & F.col("lambda").isNull()
    wanted = wanted.withColumn("_k", k).withColumn("_path", open_path)
    most_marks = sum(c.startswith("_mark") for c in rows.columns)
    sizes = [r["_k"] for r in wanted.where("_path").select("_k").distinct().collect()]
    with_lambda = wanted.where("NOT _path")
    long_panel = restrict(panel, wanted.select("series_id", "n").distinct())
    for size in sizes:
        mine = wanted.where(F.col("_path") & (F.col("_k") == size)).drop("lambda")
        if size <= 1:
            # nothing to choose a penalty by: the default of a fit on as many rows
            fitted = rows.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_rows"))
            mine = mine.join(fitted, SERIES).withColumn("lambda", 1.0 / F.sqrt("_rows")).drop("_rows")
            with_lambda = with_lambda.unionByName(mine)
            continue
        steps = lambda_path_panel(long_panel, size, PATH_STEPS).select("series_id", "lambda", "step")
        named = mine.join(steps, "series_id").withColumn("model_id", F.concat("model_id", F.lit("#"), F.col("step").cast("string"))).drop("step")
        with_lambda = with_lambda.unionByName(named)
    carried = ["series_id", "model_id", "d", "sd", "p", "q", "sp", "sq", "mean", "drift", "objective", "alpha", "lambda", "n", "n_marks"]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                orders = np.array([(row["p"], row["q"], row["sp"], row["sq"], int(row["mean"] or row["drift"]))])
                free, b = layout.mask(orders)[0], np.zeros(layout.size)
                free[1 + layout.exog - most_marks + row["n_marks"] : 1 + layout.exog] = False
                if given:
                    constant = row["c"] if not _missing(row["c"]) else row["trend"]
                    at = {"beta": 1, "ar": 1 + layout.exog, "sar": 1 + layout.exog + layout.p, "ma": layout.linear, "sma": layout.linear + layout.q}
                    if not _missing(constant):
                        b[0], free[0] = constant, False
                    for name, place in at.items():
                        if row[name] is not None:
                            values = np.asarray(row[name], dtype=float)
                            b[place : place + len(values)] = values
                            free[place : place + len(values)] = False
                start = {
                    "free": free.tolist(), "value": np.inf, "gram": [], "sse": np.nan, "sae": np.nan,
                    "worst": np.nan, "n_resid": 0, "n_w": 0, "recent": [], "mu": 1e-4 if layout.ma_lags else 1e-12, "calm": 0, "phase": 0, "ref": 1.0, "last": [0.0] * layout.size, "gain": 1.0, "done": False,
                    "bound": 0.0, "radius": np.inf, "pool": [],
                }
                points = start_points(free, layout.linear) if row["objective"] == "bilevel_global" else np.zeros((1, layout.size - layout.linear))
                for i, point in enumerate(points):
                    at = np.concatenate([b[: layout.linear], b[layout.linear :] + point]).tolist()
                    name = row["model_id"] if len(points) == 1 else f"{row['model_id']}#{i}"
                    out.append({**{c: row[c] for c in carried if c != "n_marks"}, "model_id": name, **start, "b": at, "trial": at})
            yield pd.DataFrame(out, columns=FIELDS)

    return with_lambda.select(*carried, *(GIVEN_COLUMNS if given else [])).mapInPandas(run, STATE)


def _minima(active: DataFrame, measured: DataFrame, layout: Layout) -> DataFrame:
    """The start points of every global search that are minima of its grid, the rest solved exactly from the moments of one pass."""
    lower = np.full(layout.size, -np.inf)
    lower[1 + layout.exog :] = -1.0

    def run(starts: pd.DataFrame) -> pd.DataFrame:
        starts = starts.iloc[starts["model_id"].str.rsplit("#", n=1).str[1].astype(int).argsort()]
        values = []
        for row in starts.to_dict("records"):
            G = full_matrix(np.asarray(row["_gram"], dtype=float), layout.size + 1)
            free = np.asarray(row["free"], dtype=bool)
            inner = free & (np.arange(layout.size) < layout.linear)
            low = np.where(free, lower, -np.inf)
            step = _bounded_step(G[1:, 1:], G[1:, 0], np.asarray(row["b"]), inner, low, -low)
            values.append(G[0, 0] + 2 * G[1:, 0] @ step + step @ G[1:, 1:] @ step)
        points = start_points(np.asarray(starts.iloc[0]["free"], dtype=bool), layout.linear)
        return starts.iloc[grid_minima(points, np.array(values))][FIELDS]

    both = active.join(measured.select("series_id", "model_id", "_gram"), ["series_id", "model_id"])
    return both.groupBy("series_id", F.substring_index("model_id", "#", 1)).applyInPandas(run, STATE)


def _missing(value) -> bool:
    return value is None or (isinstance(value, float) and np.isnan(value))


def _phases(objective: str) -> list[int]:
    return PHASES.get(objective, [2])


def _block_columns(block: pd.DataFrame, layout: Layout, exog_columns: Sequence[str]) -> np.ndarray:
    lags = [block[f"lag_{i}"].to_numpy() for i in layout.ar_lags]
    return np.column_stack([block["w"].to_numpy(), np.ones(len(block)), *[block[c].to_numpy(dtype=float) for c in exog_columns], *lags])


def _first(row, s: int) -> int:
    return max(row["p"], row["q"], row["sp"] * s, row["sq"] * s)


def _measure(rows: DataFrame, active: DataFrame, layout: Layout, exog_columns: Sequence[str], s: int, limit: int) -> DataFrame:
    """Moments of residuals and derivatives at the trial parameters, one row per model."""
    group = [*SERIES, "blk"]
    m, L, C = max(layout.ma_lags, default=0), layout.linear, layout.linear + 1
    last = F.expr(f"(n - 1) div {limit}")
    watch = F.transform("pool", lambda line: line[0].cast("long")).alias("watch")
    models = active.select(*SERIES, "model_id", "p", "q", "sp", "sq", "objective", "phase", "ref", "trial", "n", "free", watch)
    models = models.withColumn("blk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))

    def theta(row) -> np.ndarray:
        return np.asarray(row["trial"])[L:]

    def masked(block: pd.DataFrame, row) -> np.ndarray:
        return _block_columns(block, layout, exog_columns) * (block["tw"].to_numpy() > _first(row, s))[:, None]

    def ends(block: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        block = block.sort_values("t")
        for row in wanted.to_dict("records"):
            zero = np.zeros((m, C))
            once = recurse(masked(block, row), layout.ma_lags, theta(row), zero)
            twice = recurse(once, layout.ma_lags, theta(row), zero)
            state = np.concatenate([end_state(once, zero), end_state(twice, zero)])
            out.append({"series_id": row["series_id"], "model_id": row["model_id"], "blk": row["blk"], "trial": row["trial"], "state": state.ravel()})
        return pd.DataFrame(out, columns=["series_id", "model_id", "blk", "trial", "state"])

    def chain(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("blk")
        step = step_matrix(layout.ma_lags, np.asarray(parts.iloc[0]["trial"])[L:], m)
        both = np.zeros((2 * m, 2 * m))
        both[:m, :m] = step
        both[m:, m:] = step
        both[m, :m] = step[0]  # the second filter also reads the newest once-filtered value
        whole = np.linalg.matrix_power(both, limit)
        state, starts = np.zeros((2 * m, C)), []
        for end in parts["state"]:
            state = np.asarray(end).reshape(2 * m, C) + whole @ state
            starts.append(state.ravel())
        return pd.DataFrame({"series_id": parts["series_id"], "model_id": parts["model_id"], "blk": parts["blk"] + 1, "start": starts})

    columns = ["series_id", "model_id", "blk", "gram", "value", "sse", "sae", "worst", "n_resid", "n_w", "recent", "top", "bottom", "watched"]

    def moments(block: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        block = block.sort_values("t")
        for row in wanted.to_dict("records") if len(block) else ():
            start = np.zeros((2 * m, C)) if row["start"] is None else np.asarray(row["start"]).reshape(2 * m, C)
            valid = (block["tw"].to_numpy() > _first(row, s)).astype(float)
            b = np.asarray(row["trial"])
            mix = np.concatenate([[1.0], -b[:L]])
            Z = masked(block, row)
            if m:
                once = recurse(Z, layout.ma_lags, theta(row), start[:m])
                twice = recurse(once, layout.ma_lags, theta(row), start[m:]) @ mix
                before = np.concatenate([(start[m:] @ mix)[::-1], twice])
                by_ma = [-before[m - lag : m - lag + len(block)] for lag in layout.ma_lags]
                e_start = start[:m] @ mix
            else:
                once, by_ma, e_start = Z, [], np.zeros(0)
            e = (once @ mix) * valid
            J = np.column_stack([-once[:, 1:], *by_ma]) * valid[:, None]
            J = J * np.asarray(row["free"], dtype=float)
            norm, ref = _phases(row["objective"])[row["phase"]], row["ref"]
            size = np.abs(e) / ref
            weight = 1.0 / np.maximum(size, 1e-7) / ref if norm == 1 else np.ones(len(e))
            columns_ = np.column_stack([e, J])
            G = (columns_ * weight[:, None]).T @ columns_
            value = float(np.abs(e).max(initial=0.0) if norm == EXTREMES else np.abs(e).sum() if norm == 1 else e @ e)
            top = bottom = None
            watched = []
            if norm == EXTREMES and valid.any():
                t = block["t"].to_numpy()
                line = lambda i, t=t, e=e, J=J: [float(t[i]), float(e[i]), *J[i].tolist()]
                top, bottom = line(int(np.where(valid > 0, e, -np.inf).argmax())), line(int(np.where(valid > 0, e, np.inf).argmin()))
                watched = [line(i) for i in np.flatnonzero(np.isin(t, row["watch"]))]
            recent = end_state(e, e_start) if m else np.zeros(0)
            out.append(
                {
                    "series_id": row["series_id"], "model_id": row["model_id"], "blk": row["blk"], "gram": [G[i, j] for i, j in pairs(len(G))],
                    "value": value, "sse": float(e @ e), "sae": float(np.abs(e).sum()), "worst": float(np.abs(e).max(initial=0.0)),
                    "n_resid": int(valid.sum()), "n_w": len(block), "recent": recent.tolist(), "top": top, "bottom": bottom, "watched": watched,
                }
            )
        return pd.DataFrame(out, columns=columns)

    data = rows.groupBy(*group)
    if m:
        inner = models.where(F.col("blk") < last)
        zero = data.cogroup(inner.groupBy(*group)).applyInPandas(ends, "series_id string, model_id string, blk long, trial array<double>, state array<double>")
        starts = zero.groupBy("series_id", "model_id").applyInPandas(chain, "series_id string, model_id string, blk long, start array<double>")
        models = models.join(starts, ["series_id", "model_id", "blk"], "left")
    else:
        models = models.withColumn("start", F.lit(None).cast("array<double>"))
    schema = (
        "series_id string, model_id string, blk long, gram array<double>, value double, sse double, sae double, worst double, "
        "n_resid long, n_w long, recent array<double>, top array<double>, bottom array<double>, watched array<array<double>>"
    )
    by_block = data.cogroup(models.groupBy(*group)).applyInPandas(moments, schema)
    size = len(pairs(layout.size + 1))
    return by_block.groupBy("series_id", "model_id").agg(
        F.array(*[F.sum(F.col("gram")[i]) for i in range(size)]).alias("_gram"),
        *[F.sum(c).alias(f"_{c}") for c in ("value", "sse", "sae", "n_resid", "n_w")],
        F.max("worst").alias("_worst"),
        F.max_by("recent", "blk").alias("_recent"),
        # two extreme rows a model, and those its pool asks for
        F.max_by("top", F.col("top")[1]).alias("_top"),
        F.min_by("bottom", F.col("bottom")[1]).alias("_bottom"),
        F.flatten(F.collect_list(F.when(F.size("watched") > 0, F.col("watched")))).alias("_watched"),
    )


def _advance(active: DataFrame, measured: DataFrame, layout: Layout) -> DataFrame:
    """Accept or reject the trial of every model and propose the next one."""
    low = np.full(layout.size, -np.inf)
    low[1 + layout.exog :] = -1.0

    def run(batches):
        for batch in batches:
            out = [_advance_row(row, layout, low) for row in batch.to_dict("records")]
            yield pd.DataFrame(out, columns=FIELDS)

    return active.join(measured, ["series_id", "model_id"]).mapInPandas(run, STATE)


def _advance_row(row: dict, layout: Layout, low: np.ndarray) -> dict:
    phases = _phases(row["objective"])
    if phases[row["phase"]] == EXTREMES:
        return _exchange_row(row, layout, low)
    penalty = row["objective"] == "elastic_net"
    lam = 0.0 if _missing(row["lambda"]) or not penalty else row["lambda"]
    alpha = 0.5 if _missing(row["alpha"]) else row["alpha"]
    b, trial, free = np.asarray(row["b"]), np.asarray(row["trial"]), np.asarray(row["free"], dtype=bool)
    used = np.where(free, trial, 0.0)
    new = row["_value"] + lam * (alpha * np.abs(used).sum() + (1 - alpha) * (used @ used))
    out = {c: row[c] for c in FIELDS}
    old, mu, calm = row["value"], row["mu"], row["calm"]
    better = new < old or not np.isfinite(old)
    moved = np.abs(trial - b).max(initial=0.0)
    if better:
        small = np.isfinite(old) and old - new <= 1e-11 * (abs(old) + 1e-300)
        out.update(b=trial.tolist(), value=float(new), gram=list(row["_gram"]), recent=list(row["_recent"]), n_w=int(row["_n_w"]))
        out.update({c: row[f"_{c}"] for c in ("sse", "sae", "worst", "n_resid")})
        mu, calm = max(mu * 0.2, 1e-12), calm + 1 if small else 0
        last, gain = np.asarray(row["last"]), row["gain"]
    else:
        if row["gain"] == 1.0:
            mu, calm = mu * 6.0, calm + 1 if moved < 1e-9 else calm
        last, gain = np.zeros(layout.size), 1.0
    G = full_matrix(np.asarray(out["gram"], dtype=float), layout.size + 1)
    now = np.asarray(out["b"])
    lower = np.where(free, low, -np.inf)
    A, g = G[1:, 1:], G[1:, 0]
    step = np.clip(now + _bounded_step(A, g, now, free, lower, -lower, lam, alpha, mu), lower, -lower) - now
    settled = bool(step_is_small(A, step, G[0, 0], mu))
    if calm >= 2 or mu > 1e9 or settled or not free.any():
        if row["phase"] + 1 < len(phases) and free.any():
            out.update(phase=row["phase"] + 1, ref=max(out["worst"], 1e-300), value=np.inf, trial=out["b"], mu=1e-4, calm=0, last=[0.0] * layout.size, gain=1.0)
        else:
            out.update(done=True, trial=out["b"], mu=mu, calm=calm, bound=out["worst"])
        return out
    gain = float(next_gain(A, step, last, gain))
    out.update(trial=np.clip(now + gain * step, lower, -lower).tolist(), mu=mu, calm=calm, last=step.tolist(), gain=gain)
    return out


def _exchange_row(row: dict, layout: Layout, low: np.ndarray) -> dict:
    """One exchange of extreme residuals: the pass gave the extremes at the trial, their programme gives the next trial.

    The pool holds lines (t, residual at b = 0, derivatives); without MA terms they are exact, and every trial is taken.  With MA
    terms they belong to the centre ``b`` and all are measured anew when it moves.
    """
    out = {c: row[c] for c in FIELDS}
    b, trial, free = np.asarray(row["b"]), np.asarray(row["trial"]), np.asarray(row["free"], dtype=bool)
    extremes = [np.asarray(row["_top"], dtype=float), np.asarray(row["_bottom"], dtype=float)]
    seen = [*extremes, *(np.asarray(x, dtype=float) for x in row["_watched"])]
    lines = {int(x[0]): np.concatenate([[x[0], x[1] - x[2:] @ trial], x[2:]]) for x in seen}
    pool = {int(x[0]): np.asarray(x, dtype=float) for x in row["pool"]}
    linear, radius, worst = not layout.mask(np.array([(0, row["q"], 0, row["sq"], 0)]))[0, layout.linear :].any(), row["radius"], row["_worst"]
    gain, promise, length = row["value"] - worst, row["value"] - row["bound"], float(np.abs(trial - b).max(initial=0.0))
    if linear or not np.isfinite(row["value"]) or length == 0 or gain > WORTH * promise:
        if np.isfinite(gain) and gain > 0.75 * promise:
            radius = max(radius, 2 * length)
        out.update(b=trial.tolist(), value=float(worst), recent=list(row["_recent"]), n_w=int(row["_n_w"]))
        out.update({c: row[f"_{c}"] for c in ("sse", "sae", "worst", "n_resid")})
        b, pool = trial, {**(pool if linear else {}), **lines}
    else:
        far = max(extremes, key=lambda x: abs(x[1]))
        if int(far[0]) in pool:  # the linearisation knew the row and was wrong about it
            radius = length / 4
        pool = {**lines, **pool}
    table = np.stack(list(pool.values()))
    lower = np.where(free, low, -np.inf)
    e, J = table[:, 1] + table[:, 2:] @ b, table[:, 2:][:, free]
    found = chebyshev(e, J, np.maximum(lower - b, -radius)[free], np.minimum(-lower - b, radius)[free])
    step = np.zeros(layout.size)
    step[free] = found.step
    met = out["value"] - found.height <= SETTLED * out["value"] or radius < 1e-13
    checked = linear or all(int(x) in lines for x in pool) and bool((trial == b).all())
    # lines of a refused trial are measured at the centre before they may settle the fit
    out.update(trial=(b if met and not checked else b + step).tolist(), bound=min(found.height, out["value"]), radius=radius)
    out.update(done=bool(met and checked), pool=[x.tolist() for x in pool.values()])
    return out


def _finish(state: DataFrame, layout: Layout, s: int, given: bool, df: str, exog: int) -> DataFrame:
    """The fit table of the finished state; of a penalty path, or the starts of a global search, the one with the lowest BIC."""
    from panelwright.operators.estimate import FIT_FIELDS, _row

    spec_fields = "series_id string, model_id string, p int, d int, q int, sp int, sd int, sq int, s int, mean boolean, drift boolean, objective string, alpha double"
    schema = f"{spec_fields}, {FIT_FIELDS}, n_t int, _bic double"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                orders = (row["p"], row["q"], row["sp"], row["sq"], int(row["mean"] or row["drift"]))
                whole = int(layout.mask(np.array([orders])).sum()) + 1
                marks = int(np.sum(row["free"][1 + exog : 1 + layout.exog]))
                k = whole - (layout.exog - exog - marks)
                beta_given = given and layout.exog > 0 and not row["free"][1]
                k_var = k if beta_given else whole - layout.exog
                parts = layout.split(np.asarray(row["b"]), orders)
                parts["beta"] = parts["beta"][: exog + marks]
                freedom = row["n_resid"] if df == "residuals" else int(np.count_nonzero(row["b"]))
                variance = row["sse"] / (row["n_w"] - k_var + 1)
                out.append(
                    {
                        **{c: row[c] for c in ("series_id", "p", "d", "q", "sp", "sd", "sq", "mean", "drift", "objective", "alpha", "sse", "sae", "worst", "n_resid", "n_w")},
                        "model_id": row["model_id"].split("#")[0], "s": s, **_row(parts, row["mean"], row["drift"]), "k": k, "k_var": k_var,
                        "lambda": row["lambda"], "bound": row["bound"] if row["objective"] == "stable" else None,
                        "recent": row["recent"], "converged": row["done"] and (row["objective"] != "stable" or row["worst"] - row["bound"] <= 2 * SETTLED * row["worst"]), "n_t": row["n"] - row["d"] - row["sd"] * s,
                        "_bic": row["n_w"] * np.log(max(variance, 1e-300)) + np.log(row["n_w"]) * freedom,
                    }
                )
            yield pd.DataFrame(out, columns=names)

    fits = state.mapInPandas(run, schema)
    best = fits.groupBy("series_id", "model_id").agg(F.min_by(F.struct(*names), "_bic").alias("_best"))
    return best.select("_best.*").drop("_bic")
