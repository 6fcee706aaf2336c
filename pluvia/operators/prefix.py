"""Running totals, exact quantiles and dominance counts over very large orderings.

An ordered window without a partition key runs in one task. The functions here first
aggregate to distinct values, then split the value axis into buckets by a monotone
function of the value alone. Totals per bucket are small enough to be ordered in one
place; inside a bucket the order is local. No sampling and no driver round trip, so a
lost executor cannot change the split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.operators.storage import materialise

STEPS_PER_OCTAVE = 1 << 12
BUCKET = "_bucket"


def value_bucket(value: Column) -> Column:
    """Monotone bucket of a number: its binary octave cut into 2**12 equal steps."""
    x = value.cast("double")
    size = F.abs(x)
    octave = F.floor(F.log2(size))
    step = F.floor((size / F.pow(F.lit(2.0), octave) - 1) * STEPS_PER_OCTAVE)
    step = F.least(F.greatest(step, F.lit(0)), F.lit(STEPS_PER_OCTAVE - 1))
    code = (octave + 1100) * STEPS_PER_OCTAVE + step + 1
    return F.when(x > 0, code).when(x < 0, -code).otherwise(F.lit(0)).cast("long")


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    sums: Sequence[str],
    *,
    descending: bool = False,
    with_total: bool = False,
) -> DataFrame:
    """Add ``cum_<s>``: the total of ``s`` over all values up to and including this one.

    ``df`` holds one row per (group, value); group and value columns are not NULL.
    """
    bucketed = df.withColumn(BUCKET, value_bucket(F.col(value))).repartition(*group, BUCKET)

    def direction(c: str) -> Column:
        return F.desc(c) if descending else F.asc(c)

    by_bucket = Window.partitionBy(*group).orderBy(direction(BUCKET))
    before = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*group)
    sizes = bucketed.groupBy(*group, BUCKET).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    offsets = sizes.select(
        *group,
        BUCKET,
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums],
        *([F.sum(f"_t_{s}").over(everything).alias(f"total_{s}") for s in sums] if with_total else []),
    )
    inside = (
        Window.partitionBy(*group, BUCKET)
        .orderBy(direction(value))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        bucketed.withColumns({f"cum_{s}": F.sum(s).over(inside) for s in sums})
        .join(offsets, [*group, BUCKET])
        .withColumns({f"cum_{s}": F.col(f"cum_{s}") + F.col(f"_b_{s}") for s in sums})
        .drop(BUCKET, *[f"_b_{s}" for s in sums])
    )


def exact_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    probs: dict[str, float],
    *,
    count: str | None = None,
    total: str | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Works on counts of distinct values, so a group of any size is spread over tasks.
    ``count`` and ``total`` name optional columns for the number and sum of the values.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_totals(counts, group, "_v", ["_n"], with_total=True)
    start = F.col("cum__n") - F.col("_n")

    def at(index: Column) -> Column:
        return F.max(F.when((start <= index) & (index < F.col("cum__n")), F.col("_v")))

    picks, result = [], []
    if count:
        picks.append(F.sum("_n").alias(count))
    if total:
        picks.append(F.sum(F.col("_v") * F.col("_n")).alias(total))
    result += [F.col(c) for c in (count, total) if c]
    for name, p in probs.items():
        exact = F.lit(p) * (F.col("total__n") - 1)
        picks += [
            at(F.floor(exact)).alias(f"_lo_{name}"),
            at(F.ceil(exact)).alias(f"_hi_{name}"),
            F.max(exact - F.floor(exact)).alias(f"_fr_{name}"),
        ]
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        result.append((lo + (hi - lo) * F.col(f"_fr_{name}")).alias(name))
    return ranked.groupBy(*group).agg(*picks).select(*group, *result)


DIGIT_BITS = 6  # a summed-area table is 64 by 64


def rank_axes(points: DataFrame, queries: DataFrame, axes: Sequence[str]) -> DataFrame:
    """For each distinct value of each axis: how many distinct query values are <= the value.

    One row per (``_axis``, ``_v``) of the points and queries, numbered ``_r``; both axes in one pass.
    """

    def stacked(df: DataFrame, mark: int) -> DataFrame:
        each = F.array(*[F.struct(F.lit(i).alias("_axis"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(axes)])
        return df.select(F.inline(each)).where(F.col("_v").isNotNull()).withColumn("_m", F.lit(mark))

    values = stacked(points, 0).unionByName(stacked(queries, 1)).groupBy("_axis", "_v").agg(F.max("_m").alias("_m"))
    return running_totals(values, ["_axis"], "_v", ["_m"]).select("_axis", "_v", F.col("cum__m").cast("long").alias("_r"))


def count_dominating(
    points: DataFrame, queries: DataFrame, x: str, y: str, weight: str
) -> DataFrame:
    """Add ``n_ge``: total weight of points with ``px >= x`` and ``py >= y``, per query.

    ``points`` is aggregated (one row per x, y); ``queries`` holds distinct (x, y) without
    NULL. Both axes become ranks among the query values, so that points shrink to cells of
    the grid of queries. Ranks are read as digits of base 64: a rank above another agrees
    with it in the leading digits and has a greater one at the next, so a count is a sum over
    pairs of digit places (one pair while either axis has fewer than 64 values, four up to
    4,095), each an entry of a summed-area table of 64 by 64: totals down the columns, then
    along the rows. No table is larger than that, so no group grows with the data, and a
    column holds only the heights that are asked for.
    """
    ranks = materialise(rank_axes(points, queries, [x, y]), "ranks")
    top = {r["_axis"]: r["_r"] for r in ranks.groupBy("_axis").agg(F.max("_r").alias("_r")).collect()}  # two rows
    places = [max(1, -(-top.get(axis, 0).bit_length() // DIGIT_BITS)) for axis in (0, 1)]
    node = ["_lx", "_nx", "_ly", "_ny"]

    def ranked(df: DataFrame) -> DataFrame:
        for axis, (c, rank) in enumerate(((x, "_rx"), (y, "_ry"))):
            table = ranks.where((F.col("_axis") == axis) & (F.col("_r") > 0)).select(F.col("_v").alias(f"_v{axis}"), F.col("_r").alias(rank))
            df = df.join(table, F.col(c).cast("double") == F.col(f"_v{axis}")).drop(f"_v{axis}")
        return df

    def digits(rank: str, axis: int, above: bool) -> Column:
        """(place, leading digits, digit) for each place; for a query, the least digit that counts there."""
        return F.array(*[
            F.struct(
                F.lit(place).alias("_l"),
                F.shiftright(rank, DIGIT_BITS * (place + 1)).alias("_n"),
                (F.shiftright(rank, DIGIT_BITS * place).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)) + int(above and place > 0)).alias("_d"),
            )
            for place in range(places[axis])
        ])

    def placed(df: DataFrame, keep: Sequence[str], above: bool) -> DataFrame:
        return (
            df.select(*keep, "_ry", F.inline(digits("_rx", 0, above)).alias("_lx", "_nx", "_dx"))
            .select(*keep, "_lx", "_nx", "_dx", F.inline(digits("_ry", 1, above)).alias("_ly", "_ny", "_dy"))
        )

    small = ranked(points).groupBy("_rx", "_ry").agg(F.sum(weight).alias("_w"))
    cells = placed(small, ["_w"], False).groupBy(*node, "_dx", "_dy").agg(F.sum("_w").alias("_w"))
    cells = materialise(cells, "cells")
    asked = materialise(placed(ranked(queries), [x, y], True), "asked")

    zero, no, yes = F.lit(0).alias("_w"), F.lit(False).alias("_asked"), F.lit(True).alias("_asked")
    heights = asked.select(*node, "_dy").distinct()
    columns = cells.select(*node, "_dx").distinct()
    down = Window.partitionBy(*node, "_dx").orderBy(F.desc("_dy")).rangeBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy(*node, "_dy").orderBy(F.desc("_dx")).rangeBetween(Window.unboundedPreceding, 0)
    column_totals = (
        cells.select(*node, "_dx", "_dy", "_w", no)
        .unionByName(columns.join(heights, node).select(*node, "_dx", "_dy", zero, yes))
        .withColumn("_w", F.sum("_w").over(down))
        .where("_asked")
    )
    areas = (
        column_totals.select(*node, "_dx", "_dy", "_w", no)
        .unionByName(asked.select(*node, "_dx", "_dy").distinct().select("*", zero, yes))
        .withColumn("_w", F.sum("_w").over(along))
        .where("_asked")
        .drop("_asked")
    )
    counted = asked.join(areas, [*node, "_dx", "_dy"]).groupBy(x, y).agg(F.sum("_w").alias("n_ge"))
    return queries.join(counted, [x, y], "left").withColumn(
        "n_ge", F.coalesce("n_ge", F.lit(0)).cast("long")
    )
