"""Point-in-polygon join on grid cells that hold only the polygon edges crossing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.functions.geo import parse_geometry
from pluvia.operators.storage import materialise

COARSEST, FINEST = 5, -10
FEW_EDGES = 32  # up to here a cell carries all edges of its polygon; beyond, its own
SLACK = 1e-9  # degrees by which an edge is thought wider, far above rounding and far below a cell
_RING = "struct<part:int,ring:int>"
_EDGE = "struct<part:int,ring:int,px:double,py:double,qx:double,qy:double,p_east:boolean,q_east:boolean>"


def _readable(part: Column) -> Column:
    """Whether all coordinates of a part are there and it is at most as wide and as high as the globe."""

    def axis(i: int) -> Column:
        return F.flatten(F.transform(part, lambda ring: F.transform(ring, lambda p: F.get(p, i))))

    def fits(values: Column, most: int) -> Column:
        whole = values.isNotNull() & F.forall(values, lambda v: v.isNotNull())
        return whole & F.coalesce(F.array_max(values) - F.array_min(values) <= most, F.lit(True))

    return F.coalesce(fits(axis(0), 360) & fits(axis(1), 180), F.lit(False))


def _edges(parts: Column) -> Column:
    """Edges of all rings; each ends in the point before its own, the first in the last."""

    def of_ring(ring: Column, part: Column, number: Column) -> Column:
        n = F.size(ring)
        before = F.concat(F.slice(ring, F.greatest(n, F.lit(1)), F.lit(1)), F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))))
        return F.zip_with(ring, before, lambda p, q: F.struct(
            part.alias("part"), number.alias("ring"), F.get(p, 0).alias("px"), F.get(p, 1).alias("py"),
            F.get(q, 0).alias("qx"), F.get(q, 1).alias("qy"), F.lit(False).alias("p_east"), F.lit(False).alias("q_east")))

    return F.flatten(F.transform(parts, lambda rings, part: F.flatten(
        F.transform(rings, lambda ring, number: of_ring(ring, part, number)))))


def _boxes(parts: Column) -> Column:
    """Bounding boxes of the outlines that have points."""

    def of_outline(outline: Column) -> Column:
        x, y = F.transform(outline, lambda p: F.get(p, 0)), F.transform(outline, lambda p: F.get(p, 1))
        return F.struct(F.array_min(x).alias("x0"), F.array_max(x).alias("x1"), F.array_min(y).alias("y0"), F.array_max(y).alias("y1"))

    outlines = F.filter(F.transform(parts, lambda rings: F.get(rings, 0)), lambda o: F.size(o) > 0)
    return F.transform(outlines, of_outline)


def polygon_parts(polygons: DataFrame, geometry: str) -> DataFrame:
    """One row per polygon with its parts, their boxes, the number of its edges and its grid level.

    Rows whose geometry is missing or unreadable, or has a part with a missing coordinate or larger than the globe (a
    corrupt coordinate, which would be cut into any number of cells), vanish: they cover nothing. Cells are at least
    as wide as the largest part, so that one of few edges, which go into all its cells, has four at most; beyond, the
    narrower, the more edges there are: about as many cells as edges.
    """
    spread = F.array_max(F.transform("_boxes", lambda b: F.greatest(b.x1 - b.x0, b.y1 - b.y0, F.lit(1e-9))))
    finer = F.when(F.col("_n") > FEW_EDGES, F.floor(F.log2("_n") / 2)).otherwise(0)
    level = F.least(F.greatest(F.ceil(F.log2(spread)) - finer, F.lit(FINEST)), F.lit(COARSEST)).cast("int")
    number = F.aggregate(F.flatten("_parts"), F.lit(0), lambda n, ring: n + F.size(ring))
    outline = F.get(F.get("_parts", F.lit(0)), F.lit(0))

    def whole(parts: Column) -> Column:
        return F.forall(parts, _readable)

    # The outer form of explode keeps Spark from inferring a filter that would parse twice.
    parsed = polygons.select(
        *[c for c in polygons.columns if c != geometry],
        F.explode_outer(F.filter(F.array(parse_geometry(F.col(geometry))), whole)).alias("_parts"),
    )
    return (
        parsed.withColumns({"_boxes": _boxes(F.col("_parts")), "_n": number})
        .where(F.size("_boxes") > 0)
        .withColumns({"_level": level, "_simple": F.col("_n") == F.coalesce(F.size(outline), F.lit(0))})
    )


def with_edges(shapes: DataFrame) -> DataFrame:
    return shapes.withColumn("_edges", _edges(F.col("_parts"))).drop("_parts", "_n")


def polygon_edges(polygons: DataFrame, geometry: str) -> DataFrame:
    """One row per polygon that `polygon_parts` keeps, with its edges, the boxes of its parts and its grid level."""
    return with_edges(polygon_parts(polygons, geometry))


def _side() -> Column:
    return F.pow(F.lit(2.0), F.col("_level"))


def whole_cells(shapes: DataFrame) -> DataFrame:
    """Cells under the boxes of the parts, each with all edges of its polygon."""
    side = _side()

    def cells(b: Column) -> Column:
        def span(lo, hi):
            return F.sequence(F.floor(lo / side), F.floor(hi / side))

        return F.flatten(F.transform(span(b.x0, b.x1), lambda cx: F.transform(
            span(b.y0, b.y1), lambda cy: F.struct(cx.alias("_cx"), cy.alias("_cy")))))

    def outer(end, name):
        return end(F.transform("_boxes", lambda b: b[name]))

    box = F.struct(outer(F.array_min, "x0").alias("x0"), outer(F.array_max, "x1").alias("x1"),
                   outer(F.array_min, "y0").alias("y0"), outer(F.array_max, "y1").alias("y1"))
    exploded = shapes.withColumns(
        {"_box": box, "_cell": F.explode(F.array_distinct(F.flatten(F.transform("_boxes", cells))))})
    return exploded.select("*", "_cell.*", F.array().cast(f"array<{_RING}>").alias("_base")).drop("_cell", "_boxes")


def clipped_cells(shapes: DataFrame) -> DataFrame:
    """Cells of polygons with many edges, each with the edges that cross it and the rings around its corner.

    A ring holds a point if a ray to the east crosses it an odd number of times. Inside a row of cells the edges
    wholly east of a cell are crossed by every ray or by none but for the ends of their chains, so the cell needs
    only the parity of their crossings at its lower corner (``_base`` lists the rings where it is odd), and its own
    edges set right what the ends that lie east of it change (``p_east``, ``q_east``). The comparisons are those of
    the whole ring, so the result is the same to the last bit. One exchange, by polygon; an edge is copied once for
    each cell that it crosses.
    """
    side = _side()
    low, high = F.least("py", "qy"), F.greatest("py", "qy")
    y0, y1 = F.col("_cy") * side, (F.col("_cy") + 1) * side
    x_min, x_max = F.least("px", "qx"), F.greatest("px", "qx")

    def crossing(y: Column) -> Column:
        """Where the edge meets a height, within its own width; NULL if it is level."""
        x = (F.col("qx") - F.col("px")) * (y - F.col("py")) / F.nullif(F.col("qy") - F.col("py"), F.lit(0.0)) + F.col("px")
        return F.least(F.greatest(x, x_min), x_max)

    def end(x: str, y: str) -> Column:
        return F.when(F.col(y).between(y0, y1), F.col(x))

    reached = [crossing(F.greatest(low, y0)), crossing(F.least(high, y1)), end("px", "py"), end("qx", "qy")]

    def last_west(x: Column) -> Column:
        """The last column that lies wholly west of x."""
        return F.ceil((x - SLACK) / side) - 2

    rows = (
        shapes.select("_pid", "_level", "_edges").repartition("_pid").select("_pid", "_level", F.inline("_edges"))
        .withColumn("_cy", F.explode(F.sequence(F.floor(low / side), F.floor(high / side))))
        .withColumns({"_west": last_west(F.least(*reached)), "_last": F.floor((F.greatest(*reached) + SLACK) / side)})
    )
    place = ["_pid", "_level", "_cx", "_cy"]
    crossed = rows.withColumn("_cx", F.explode(F.sequence(F.col("_west") + 1, F.col("_last")))).select(
        *place,
        F.struct("part", "ring", "px", "py", "qx", "qy", (last_west(F.col("px")) >= F.col("_cx")).alias("p_east"),
                 (last_west(F.col("qx")) >= F.col("_cx")).alias("q_east")).alias("_edge"),
        F.lit(None).cast(_RING).alias("_ring"),
    )
    ring = ["_pid", "_level", "part", "ring", "_cy"]
    turns = (
        rows.where((F.col("py") > y0) != (F.col("qy") > y0))
        .groupBy(*ring, "_west").agg(F.count("*").alias("_n")).where("_n % 2 = 1")
        .groupBy(*ring).agg(F.sort_array(F.collect_list("_west")).alias("_turns"))  # at most the columns of the grid
    )
    pairs = F.sequence(F.lit(0), F.floor(F.size("_turns") / 2) - 1).cast("array<int>")
    runs = F.transform(pairs, lambda i: F.sequence(F.get("_turns", 2 * i) + 1, F.get("_turns", 2 * i + 1)))
    around = turns.withColumn("_cx", F.explode(F.flatten(runs))).select(
        *place, F.lit(None).cast(_EDGE).alias("_edge"), F.struct("part", "ring").alias("_ring"))
    return (
        crossed.unionByName(around).groupBy(*place)
        .agg(F.collect_list("_edge").alias("_edges"), F.collect_list("_ring").alias("_base"))
        .join(shapes.drop("_edges", "_boxes", "_level"), "_pid")
    )


def _holds(x: Column, y: Column, y0: Column) -> Column:
    """Whether the point lies in a part of the polygon: in its outline and in none of its holes.

    Even-odd ray rule: west and south edges belong to a ring, east and north do not. A cell with a box has all
    edges of its polygon, and none of them ends east of it.
    """

    def crossed(e: Column) -> Column:
        reach = (e.qx - e.px) * (y - e.py) / F.nullif(e.qy - e.py, F.lit(0.0)) + e.px
        return F.coalesce(((e.py > y) != (e.qy > y)) & (x < reach), F.lit(False))

    def flips(e: Column) -> Column:
        p_ends = e.p_east & ((e.py > y) != (e.py > y0))
        q_ends = e.q_east & ((e.qy > y) != (e.qy > y0))
        return (crossed(e) != p_ends) != q_ends

    flipped = F.when(F.col("_box").isNotNull(), F.filter("_edges", crossed)).otherwise(F.filter("_edges", flips))
    hits = F.concat("_base", F.transform(flipped, lambda e: F.struct(e.part.alias("part"), e.ring.alias("ring"))))

    def odd(all_hits: Column) -> Column:
        return F.filter(F.array_distinct(all_hits), lambda r: F.size(F.filter(all_hits, lambda h: h == r)) % 2 == 1)

    def in_part(rings: Column) -> Column:
        return F.exists(rings, lambda o: (o.ring == 0) & ~F.exists(rings, lambda h: (h.part == o.part) & (h.ring > 0)))

    # A lambda over one list evaluates the hits once for all their uses.
    several = F.exists(F.array(hits), lambda found: F.exists(F.array(odd(found)), in_part))
    return F.when(F.col("_simple"), (F.size("_base") + F.size(flipped)) % 2 == 1).otherwise(several)


def points_in_polygons(polygons: DataFrame, points: DataFrame, *, geometry="poligono",
                       lat="lat", lon="lon") -> DataFrame:
    """All (polygon, point) pairs in which the polygon contains the point, each once.

    Both sides keep their columns (the geometry text is dropped). A polygon is cut into cells, a point goes into its
    cell on every level that a polygon has, and equal cells meet; all parts of a polygon share a cell's row, so a
    point in two parts is one pair. Polygons of few edges carry them all into each cell; those of many carry an edge
    only into the cells that it crosses, and cells inside need no test. Polygons are spread over tasks before they
    are parsed, since a few input splits may hold most of the vertices; their points are written once, which
    are fewer values than their edges, and edges are made where they are read.

    Arriving polygons (a stream) can neither be written first nor grouped: their points take all levels, and every
    cell carries all edges of its polygon.
    """
    keys = [c for c in polygons.columns if c != geometry]
    shapes = polygon_parts(polygons.repartition(*keys), geometry)
    levels = list(range(FINEST, COARSEST + 1))
    if polygons.isStreaming:
        covered = whole_cells(with_edges(shapes))
    else:
        shapes = materialise(shapes.withColumn("_pid", F.monotonically_increasing_id()), "shapes")
        few = F.col("_n") <= FEW_EDGES
        found = shapes.select("_level", few.alias("_few")).distinct().collect()  # of 16 levels at most
        levels = sorted({r["_level"] for r in found})
        covered = whole_cells(with_edges(shapes.where(few)))
        if not all(r["_few"] for r in found):
            covered = covered.unionByName(clipped_cells(with_edges(shapes.where(~few))), allowMissingColumns=True)
        covered = covered.drop("_pid")
    side = _side()
    located = (
        points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
        .withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
        .withColumns({"_cx": F.floor(F.col(lon) / side), "_cy": F.floor(F.col(lat) / side)})
    )
    x, y = F.col(lon), F.col(lat)
    in_box = x.between(F.col("_box.x0"), F.col("_box.x1")) & y.between(F.col("_box.y0"), F.col("_box.y1"))
    return (
        covered.join(located, ["_level", "_cx", "_cy"])
        .where(F.coalesce(in_box, F.lit(True)))
        .where(_holds(x, y, F.col("_cy") * side))
        .drop("_level", "_cx", "_cy", "_edges", "_base", "_box", "_simple")
    )
