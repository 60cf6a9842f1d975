"""Windows over blocks of rows instead of whole series.

A window keyed by the series alone puts one series into one task, so a series
that holds a third of all rows would stall the job.  Here rows carry a position
``t`` (1, 2, ... per series) and are cut into blocks of equal length.  Windows,
joins of per-series values and block aggregates are all keyed by
``(keys..., blk)``: one shuffle serves them, and no group exceeds the block
length.  A row near the end of a block is copied into the next one (the halo),
which makes lags exact across the cut.  A series shorter than a block has one
block and no copies.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("series_id",)
BLOCK_ROWS = 65536
BLOCK_ROWS_SETTING = "panelwright.blockRows"


def block_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(BLOCK_ROWS_SETTING, str(BLOCK_ROWS)))


def number_rows(df: DataFrame, keys: Sequence[str] = KEYS, order: str = "ts", name: str = "t") -> DataFrame:
    """Add the position of every row within its series, in the order of ``order``.

    Rows are ranked inside calendar cells (a year for dates, a day for
    timestamps) and shifted by the number of rows in earlier cells.  The time
    step is at least a second, so the calendar bounds the rows of a cell and the
    cells of a series; only the small table of cell counts is keyed by series.
    """
    keys = list(keys)
    kind = df.schema[order].dataType
    if isinstance(kind, T.DateType):
        cell = F.year(order)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        cell = F.to_date(order)
    else:
        raise TypeError(f"{order} must be a date or a timestamp, not {kind.simpleString()}")
    missing = F.raise_error(F.lit(f"a row has no {order}"))
    cell = F.when(F.col(order).isNull(), missing.cast("int" if isinstance(kind, T.DateType) else "date")).otherwise(cell)
    rows = df.withColumn("_cell", cell)
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "_cell")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy(order)
    return (
        rows.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [*keys, "_cell"])
        .withColumn(name, F.col("_offset") + F.col("_rank"))
        .drop("_cell", "_rank", "_offset")
    )


def count_up(last: Column, name: str, spread: int = 4096) -> list[Column]:
    """Two steps that explode 0..last into rows through ranges of ``spread``, so that no row holds a long array."""
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(spread).cast("bigint"))).alias("_from")
    inside = F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (spread - 1), last))).alias(name)
    return [start, inside]


def own_block(df: DataFrame) -> Column:
    return F.expr(f"(t - 1) div {block_rows(df)}")


def blocked(df: DataFrame) -> DataFrame:
    """Add the block number of every row."""
    return df.withColumn("blk", own_block(df))


def with_halo(df: DataFrame, reach: int) -> DataFrame:
    """Block numbers, with the last ``reach`` rows of a block copied into the next."""
    rows = block_rows(df)
    if reach > rows:
        raise ValueError(f"a reach of {reach} rows needs {BLOCK_ROWS_SETTING} >= {reach}")
    if reach == 0:
        return blocked(df)
    own = own_block(df)
    copies = F.when(F.pmod(F.col("t") - 1, F.lit(rows)) >= rows - reach, 1).otherwise(0)
    return df.drop("blk").withColumn("blk", F.explode(F.sequence(own, own + copies)))


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(F.col("blk") == own_block(df))


def block_window(keys: Sequence[str] = KEYS):
    return Window.partitionBy(*keys, "blk").orderBy("t")


def with_lags(df: DataFrame, lags: Mapping[str, tuple[str, int]], keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``name -> (column, k)``: the value of ``column`` k rows earlier, null before the start."""
    if not lags:
        return blocked(df)
    return lags_of_halo(with_halo(df, max(k for _, k in lags.values())), lags, keys)


def lags_of_halo(halo: DataFrame, lags: Mapping[str, tuple[str, int]], keys: Sequence[str] = KEYS) -> DataFrame:
    """As ``with_lags`` for rows that carry a halo of at least the greatest lag; the halo drops out."""
    window = block_window(keys)
    return drop_halo(
        halo.withColumns({name: F.lag(source, k).over(window) if k else F.col(source) for name, (source, k) in lags.items()})
    )


def running_sums(df: DataFrame, sums: Mapping[str, str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``name -> column``: the running sum of ``column`` by ``t``, in two levels.

    Sums inside a block come from a block window; the totals of earlier blocks
    are added through a join on ``(keys, blk)``, which is already the partitioning.
    """
    keys = list(keys)
    if "blk" not in df.columns:
        df = blocked(df)
    totals = df.groupBy(*keys, "blk").agg(*[F.sum(source).alias(f"_{name}") for name, source in sums.items()])
    before = Window.partitionBy(*keys).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "blk", *[F.sum(f"_{n}").over(before).alias(f"_{n}_before") for n in sums]).where(
        F.col("blk") > 0
    )
    inside = block_window(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.withColumns({f"_{name}_inside": F.sum(source).over(inside) for name, source in sums.items()})
        .join(offsets, [*keys, "blk"], "left")
        .withColumns({n: F.col(f"_{n}_inside") + F.coalesce(F.col(f"_{n}_before"), F.lit(0.0)) for n in sums})
        .drop(*[f"_{n}_inside" for n in sums], *[f"_{n}_before" for n in sums])
    )


def attach(df: DataFrame, values: DataFrame, keys: Sequence[str] = KEYS, last: str = "n") -> DataFrame:
    """Join one row per series onto the panel without a hot key.

    ``values`` carries the last position of the series in ``last``; it is spread
    over the blocks of the series, so the join key is ``(keys, blk)``.
    """
    keys = list(keys)
    if "blk" not in df.columns:
        df = blocked(df)
    rows = block_rows(df)
    spread = values.withColumn("blk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"({last} - 1) div {rows}"))))
    return df.join(spread, [*keys, "blk"])


def restrict(df: DataFrame, series: DataFrame, keys: Sequence[str] = KEYS, last: str = "n") -> DataFrame:
    """Rows of the series listed in ``series`` (with their last position), without a hot join key."""
    return attach(df.drop("blk"), series.select(*keys, F.col(last).alias("_last")), keys, "_last").drop("_last", "blk")


def with_earlier(
    df: DataFrame, columns: Sequence[str], shift: Column, carry: Sequence[str], prefix: str = "earlier_", keys: Sequence[str] = KEYS
) -> DataFrame:
    """``columns`` at each position next to their values ``shift`` rows earlier, 0 outside the series.

    The shift may differ per series.  Every row is sent to its own position and
    to the one ``shift`` later, and the two meet in a hash aggregate: one shuffle
    on ``(keys, t)`` and no second read of the input.  Positions after the end of
    the series appear too; ``own`` tells them apart.
    """
    keys = list(keys)
    places = F.explode(
        F.array(
            F.struct(F.col("t").alias("t"), F.lit(True).alias("own")),
            F.struct((F.col("t") + shift).alias("t"), F.lit(False).alias("own")),
        )
    )
    sent = df.select(*keys, *columns, *carry, places.alias("_to")).withColumns({"t": F.col("_to.t"), "own": F.col("_to.own")})

    def side(column: str, own: bool) -> Column:
        return F.coalesce(F.sum(F.when(F.col("own") == own, F.col(column))), F.lit(0.0))

    return sent.groupBy(*keys, "t").agg(
        F.bool_or("own").alias("own"),
        *[F.max(c).alias(c) for c in carry],
        *[side(c, True).alias(c) for c in columns],
        *[side(c, False).alias(f"{prefix}{c}") for c in columns],
    )
