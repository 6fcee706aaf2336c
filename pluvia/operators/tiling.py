"""Windows over long series without one task per series.

A window partitioned by station alone puts a whole station into one task. Here a series
is cut into tiles of fixed width on its position axis (epoch hours or row numbers). Rows
near a tile edge are copied into the neighbouring tile as context, so that every frame up
to ``back``/``ahead`` positions is complete, and the copies are dropped afterwards. The
shuffle key is (station, tile), whose size is bounded by the tile width.

Frames that have no bounded reach (row numbers, previous non-null value) use the tile
edges instead: each tile is summarised to one row, the summaries are ordered per station,
and what comes from the tiles before is joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TILE = "_tile"
CORE = "_core"
HOURS_PER_TILE = 24 * 64


def tile_of(pos: Column, width: int) -> Column:
    return F.floor(pos / width).cast("long")


class Frames:
    """Window specs on the tiled position axis, all sharing one partitioning and order."""

    def __init__(self, keys: Sequence[str], pos: str):
        self._spec = Window.partitionBy(*keys, TILE).orderBy(pos)

    def at(self, offset: int) -> WindowSpec:
        """The row exactly ``offset`` positions away, if there is one."""
        return self._spec.rangeBetween(offset, offset)

    def last(self, n: int) -> WindowSpec:
        """The ``n`` positions that end here."""
        return self._spec.rangeBetween(-(n - 1), 0)

    def following(self, n: int) -> WindowSpec:
        """The ``n`` positions strictly after this one."""
        return self._spec.rangeBetween(1, n)


def over_series(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    columns: Callable[[Frames], dict[str, Column]],
    *,
    back: int = 0,
    ahead: int = 0,
    width: int = HOURS_PER_TILE,
) -> DataFrame:
    """Add window columns whose frames reach ``back`` and ``ahead`` positions.

    All columns share one exchange and one sort.
    """
    position = F.col(pos)
    home = tile_of(position, width)
    first = tile_of(position - ahead, width)
    last = tile_of(position + back, width)
    tiled = (
        df.withColumn(CORE, home)
        .withColumn(TILE, F.explode(F.sequence(first, last)))
        .withColumn(CORE, F.col(CORE) == F.col(TILE))
    )
    return tiled.withColumns(columns(Frames(keys, pos))).where(F.col(CORE)).drop(TILE, CORE)


def with_row_position(
    df: DataFrame, keys: Sequence[str], pos: str, name: str, width: int = HOURS_PER_TILE
) -> DataFrame:
    """Add the 0-based row number of each row within its series."""
    tiled = df.withColumn(TILE, tile_of(F.col(pos), width))
    local = tiled.withColumn(
        name, F.row_number().over(Window.partitionBy(*keys, TILE).orderBy(pos)).cast("long") - 1
    )
    before = Window.partitionBy(*keys).orderBy(TILE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tiled.groupBy(*keys, TILE)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, TILE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        local.join(offsets, [*keys, TILE])
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop(TILE, "_before")
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    column: str,
    name: str,
    width: int = HOURS_PER_TILE,
) -> DataFrame:
    """Add ``column`` of the previous row of the series, whatever the distance."""
    tiled = df.withColumn(TILE, tile_of(F.col(pos), width))
    inner = Window.partitionBy(*keys, TILE).orderBy(pos)
    local = tiled.withColumn(name, F.lag(F.struct(column)).over(inner))
    edges = (
        tiled.groupBy(*keys, TILE)
        .agg(F.max_by(F.struct(column), F.col(pos)).alias("_edge"))
        .select(
            *keys, TILE, F.lag("_edge").over(Window.partitionBy(*keys).orderBy(TILE)).alias("_edge")
        )
    )
    return (
        local.join(edges, [*keys, TILE])
        .withColumn(name, F.coalesce(F.col(name), F.col("_edge"))[column])
        .drop(TILE, "_edge")
    )


def with_run_id(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    flag: str,
    name: str,
    width: int = HOURS_PER_TILE,
) -> DataFrame:
    """Number the runs of equal ``flag`` values along each series, from 1."""
    first_row = F.row_number().over(Window.partitionBy(*keys, TILE).orderBy(pos)) == 1
    inner = Window.partitionBy(*keys, TILE).orderBy(pos)
    changed = ~F.lag(flag).over(inner).eqNullSafe(F.col(flag)) & ~first_row
    local = (
        df.withColumn(TILE, tile_of(F.col(pos), width))
        .withColumn("_start", changed.cast("long"))
        .withColumn(name, F.sum("_start").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    )
    by_tile = Window.partitionBy(*keys).orderBy(TILE)
    flag_of = F.struct(flag)
    tiles = local.groupBy(*keys, TILE).agg(
        F.min_by(flag_of, F.col(pos)).alias("_first"),
        F.max_by(flag_of, F.col(pos)).alias("_last"),
        F.sum("_start").alias("_inside"),
    )
    edge = (~F.lag("_last").over(by_tile).eqNullSafe(F.col("_first"))).cast("long")
    before = by_tile.rowsBetween(Window.unboundedPreceding, -1)
    offsets = tiles.withColumn("_edge", edge).select(
        *keys,
        TILE,
        (F.coalesce(F.sum(F.col("_inside") + F.col("_edge")).over(before), F.lit(0)) + F.col("_edge"))
        .alias("_before"),
    )
    return (
        local.join(offsets, [*keys, TILE])
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop(TILE, "_before", "_start")
    )


def fill_short_gaps(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    columns: Sequence[str],
    limit: int = 3,
    width: int = HOURS_PER_TILE,
) -> DataFrame:
    """Linear interpolation by row position, at most ``limit`` rows from either side.

    A NULL takes the line between the previous and the next value of its series when one
    of them is within ``limit`` rows; at a series end it takes the nearest value.
    """
    here = F.col
    inner = Window.partitionBy(*keys, TILE).orderBy(pos)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    # Looking back along the reversed order costs one pass; an unbounded following frame
    # would be evaluated anew for every row.
    backward = Window.partitionBy(*keys, TILE).orderBy(F.desc(pos))
    onward = backward.rowsBetween(Window.unboundedPreceding, 0)

    def point(c: str) -> Column:
        return F.when(here(c).isNotNull(), F.struct(here("_rn").alias("r"), here(c).alias("v")))

    local = (
        df.withColumn(TILE, tile_of(here(pos), width))
        .withColumn("_rn", F.row_number().over(inner).cast("long"))
        .withColumns(
            {f"_p_{c}": F.last(point(c), ignorenulls=True).over(upto) for c in columns}
            | {f"_n_{c}": F.last(point(c), ignorenulls=True).over(onward) for c in columns}
        )
    )
    tiles = local.groupBy(*keys, TILE).agg(
        F.max("_rn").alias("_size"),
        *[F.max(point(c)).alias(f"_l_{c}") for c in columns],
        *[F.min(point(c)).alias(f"_f_{c}") for c in columns],
    )
    by_tile = Window.partitionBy(*keys).orderBy(TILE)
    past = by_tile.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc(TILE))
    future = later.rowsBetween(Window.unboundedPreceding, -1)

    def shifted(p: Column) -> Column:
        """The same point, its row counted from the start of the series."""
        return F.when(
            p.isNotNull(), F.struct((p["r"] + here("_before")).alias("r"), p["v"].alias("v"))
        )

    carried = (
        tiles.withColumn("_before", F.coalesce(F.sum("_size").over(past), F.lit(0)))
        .withColumns({f"_{s}_{c}": shifted(here(f"_{s}_{c}")) for c in columns for s in "lf"})
        .select(
            *keys,
            TILE,
            "_before",
            *[F.last(f"_l_{c}", ignorenulls=True).over(past).alias(f"_cp_{c}") for c in columns],
            *[F.last(f"_f_{c}", ignorenulls=True).over(future).alias(f"_cn_{c}") for c in columns],
        )
    )

    def filled(c: str) -> Column:
        prev = F.coalesce(shifted(here(f"_p_{c}")), here(f"_cp_{c}"))
        nxt = F.coalesce(shifted(here(f"_n_{c}")), here(f"_cn_{c}"))
        row = here("_rn") + here("_before")
        since, until = row - prev["r"], nxt["r"] - row
        line = prev["v"] + (nxt["v"] - prev["v"]) * since / F.nullif(nxt["r"] - prev["r"], F.lit(0))
        return (
            F.when(here(c).isNotNull(), here(c))
            .when(prev.isNotNull() & nxt.isNotNull(), F.when((since <= limit) | (until <= limit), line))
            .when(since <= limit, prev["v"])
            .when(until <= limit, nxt["v"])
        )

    joined = local.join(carried, [*keys, TILE])
    kept = [filled(c).alias(c) if c in columns else F.col(c) for c in df.columns]
    return joined.select(*kept)
