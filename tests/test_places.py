"""Neighbours and polygons."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.functions.geo import geometry_contains, parse_geometry
from pluvia.operators import climatology, neighbours, spatial, warnings


def brute(points, k, radius):
    lat, lon = np.radians(points[:, 1]), np.radians(points[:, 2])
    a = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    d = 2 * 6371 * np.arcsin(np.sqrt(a))
    found = {}
    for i in range(len(points)):
        near = sorted((round(d[i, j], 9), int(points[j, 0])) for j in range(len(points)) if j != i)
        found[int(points[i, 0])] = [c for dist, c in near if radius is None or dist <= radius][:k]
    return found


@pytest.mark.parametrize("radius", [None, 150.0, 5.0])
def test_nearest_equals_brute_force(spark, radius):
    rng = np.random.default_rng(5)
    wide = np.column_stack([rng.uniform(-33, -27, 60), rng.uniform(-57, -49, 60)])
    crowd = np.column_stack([-30 + rng.normal(scale=0.01, size=80), -51 + rng.normal(scale=0.01, size=80)])
    copies = np.repeat([[-29.5, -53.0]], 30, axis=0)
    far = np.array([[80.0, 179.9], [80.0, -179.9], [-89.9, 10.0], [0.0, 0.0]])
    xy = np.vstack([wide, crowd, copies, far])
    points = np.column_stack([np.arange(len(xy)), xy])
    df = spark.createDataFrame([(int(i), float(a), float(b)) for i, a, b in points], "station long, lat double, lon double")
    got = {}
    for r in neighbours.nearest(df, df, 5, radius).collect():
        got.setdefault(r.station, {})[r.posicao] = r.viz
    want = brute(points, 5, radius)
    for station, expected in want.items():
        found = got.get(station, {})
        assert [found[i] for i in sorted(found)] == expected


def test_searches_are_dealt_by_places(spark, monkeypatch):
    """The pairs of a few places would fit into one task by their bytes; the more places, the more tasks."""
    monkeypatch.setattr(neighbours, "PLACES_PER_TASK", 8)
    df = spark.range(60).selectExpr("id as station", "-30e0 - id / 10 as lat", "-51e0 - id % 7 as lon")
    plan = neighbours.nearest(df, df)._jdf.queryExecution().executedPlan().toString()
    assert ", 8), REPARTITION_BY_NUM" in plan and neighbours.nearest(df, df).count() == 300


def test_inheritance_reads_its_table_once(spark, tmp_path):
    stations = spark.createDataFrame([(i, -30.0 - i / 10, -51.0) for i in range(8)], "station long, lat double, lon double")
    spark.range(7).selectExpr("id as station", "id * 1e0 as c").write.parquet(str(tmp_path / "given"))
    out = climatology.inherit(spark.read.parquet(str(tmp_path / "given")), stations, ["c"])
    assert str(tmp_path / "given") not in " ".join(out.inputFiles())
    assert out.count() == 8


def test_inheritance_keeps_known_rows_and_months(spark):
    stations = spark.createDataFrame([(i, -30.0 - i / 10, -51.0) for i in range(8)], "station long, lat double, lon double")
    table = spark.createDataFrame([(i, m, float(i * m)) for i in range(7) for m in (1, 2) if not (i == 3 and m == 2)], "station long, mes int, c double")
    out = {(r.station, r.mes): r.c for r in climatology.inherit(table, stations, ["c"], ["mes"]).collect()}
    assert out[(7, 1)] == np.mean([2, 3, 4, 5, 6])
    assert out[(7, 2)] == np.mean([4, 8, 10, 12])
    assert (3, 2) not in out and len(out) == 15


SQUARE = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
HOLE = [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]
OTHER = [[20, 20], [22, 20], [22, 22], [20, 22], [20, 20]]
SHAPES = [
    (1, json.dumps({"type": "Polygon", "coordinates": [SQUARE]})),
    (2, json.dumps({"type": "Polygon", "coordinates": [SQUARE, HOLE]})),
    (3, json.dumps({"type": "MultiPolygon", "coordinates": [[SQUARE], [OTHER]]})),
    (4, None), (5, "junk"), (6, json.dumps({"type": "Point", "coordinates": [1, 1]})),
    (7, json.dumps({"type": "Polygon", "coordinates": []})),
    (8, json.dumps({"type": "MultiPolygon", "coordinates": [[SQUARE], [SQUARE]]})),
    (9, json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [4, 8], [8, 0], [4, 3]]]})),
]
POINTS = [(1, 5.0, 5.0), (2, 1.0, 1.0), (3, 21.0, 21.0), (4, 50.0, 50.0), (5, 0.0, 5.0), (6, 10.0, 5.0), (7, 5.0, 0.0), (8, 5.0, 10.0), (9, None, 1.0)]


def inside(x, y, rings):
    def ring(points):
        hit = False
        for i in range(len(points)):
            (xi, yi), (xj, yj) = points[i], points[i - 1]
            if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi:
                hit = not hit
        return hit

    return ring(rings[0]) and not any(ring(r) for r in rings[1:])


def test_points_in_polygons(spark):
    polygons = spark.createDataFrame(SHAPES, "id int, poligono string")
    points = spark.createDataFrame(POINTS, "station int, lon double, lat double")
    got = sorted((r.id, r.station) for r in spatial.points_in_polygons(polygons, points).collect())
    want = []
    for ident, text in SHAPES:
        try:
            shape = json.loads(text)
        except (TypeError, ValueError):
            continue
        parts = {"Polygon": [shape["coordinates"]], "MultiPolygon": shape["coordinates"]}.get(shape["type"], [])
        for s, x, y in POINTS:
            if x is not None and any(p and inside(x, y, p) for p in parts):
                want.append((ident, s))
    assert got == sorted(want)
    assert (2, 1) not in got and (3, 3) in got and (1, 5) in got and (1, 6) not in got


def test_contains_expression_is_false_for_unreadable_geometry(spark):
    df = spark.createDataFrame(SHAPES, "id int, poligono string").select(
        "id", geometry_contains(F.lit(1.0), F.lit(1.0), parse_geometry(F.col("poligono"))).alias("c"))
    assert {r.id for r in df.collect() if r.c} == {1, 2, 3, 8, 9}


def test_validity_touches_two_anchored_days(spark):
    df = spark.sql("""select timestamp'2025-03-10 06:00:00' as a, timestamp'2025-03-11 06:00:00' as b union all
      select timestamp'2025-03-10 12:00:00', timestamp'2025-03-10 13:00:00' union all select timestamp'2025-03-10 12:00:00', timestamp'2025-03-01 00:00:00'""")
    days = [sorted(str(x) for x in r.d) for r in df.select(warnings.touched_days(F.col("a"), F.col("b")).alias("d")).collect()]
    assert days == [["2025-03-09", "2025-03-10"], ["2025-03-10"], ["2025-03-10"]]


def test_corrupt_coordinates_are_refused(spark):
    """A polygon with a part larger than the globe covers nothing, also where its other parts would."""
    good = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    bad = [[[0, 0], [1e9, 0], [1e9, 2], [0, 0]]]
    shapes = [
        (1, {"type": "Polygon", "coordinates": good}), (2, {"type": "Polygon", "coordinates": bad}),
        (3, {"type": "MultiPolygon", "coordinates": [good, bad]}), (4, {"type": "MultiPolygon", "coordinates": [good, []]}),
    ]
    polygons = spark.createDataFrame([(i, json.dumps(x)) for i, x in shapes], "id int, poligono string")
    points = spark.createDataFrame([("p", 1.0, 1.0)], "station string, lat double, lon double")
    assert sorted(r.id for r in spatial.points_in_polygons(polygons, points).collect()) == [1, 4]


def ragged(rng, n, cx, cy, size, jump):
    """A ring around a centre whose radius jumps, with some vertices on cell borders and level edges."""
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    radius = size * (1 - jump * rng.uniform(0, 1, n))
    ring = np.column_stack([cx + radius * np.cos(angle), cy + radius * np.sin(angle)])
    snapped = rng.uniform(0, 1, n) < 0.2
    ring[snapped] = np.round(ring[snapped] * 4) / 4
    flat = np.flatnonzero(rng.uniform(0, 1, n - 1) < 0.1)
    ring[flat + 1, 1] = ring[flat, 1]
    return ring.tolist()


@pytest.mark.parametrize("seed", range(3))
def test_polygons_of_many_edges_equal_brute_force(spark, seed):
    """Rings that cross themselves, holes, overlapping parts; points on vertices, edges and cell borders."""
    rng = np.random.default_rng(seed)
    shapes = []
    for i in range(8):
        n = int(rng.integers(40, 400))
        parts = [[ragged(rng, n, 0, 0, 8, rng.uniform(0, 0.9)), ragged(rng, 30, 1, 1, 3, 0.5)]]
        if i % 2:
            parts.append([ragged(rng, n, 4, -2, 6, 0.7)])
        if i % 3 == 0:
            parts.append([rng.uniform(-9, 9, (n, 2)).tolist(), ragged(rng, 8, -3, 0, 2, 0.1)])
        shapes.append((i, parts))
    grid = [(x / 4, y / 4) for x in range(-38, 39, 3) for y in range(-38, 39, 3)]
    corners = [tuple(p) for _, parts in shapes for rings in parts for p in rings[0][::7]]
    spots = grid + corners[:300] + [tuple(p) for p in rng.uniform(-10, 10, (400, 2))]
    polygons = spark.createDataFrame(
        [(i, json.dumps({"type": "MultiPolygon", "coordinates": parts})) for i, parts in shapes], "id int, poligono string")
    points = spark.createDataFrame([(j, float(x), float(y)) for j, (x, y) in enumerate(spots)], "station int, lon double, lat double")
    got = sorted((r.id, r.station) for r in spatial.points_in_polygons(polygons, points).collect())

    def ring_holds(ring):
        p, q = np.array(ring), np.roll(np.array(ring), 1, axis=0)
        x, y = np.array(spots)[:, :1], np.array(spots)[:, 1:]
        with np.errstate(all="ignore"):
            reach = (q[:, 0] - p[:, 0]) * (y - p[:, 1]) / (q[:, 1] - p[:, 1]) + p[:, 0]
        return (((p[:, 1] > y) != (q[:, 1] > y)) & (x < reach)).sum(axis=1) % 2 == 1

    want = []
    for i, parts in shapes:
        held = np.zeros(len(spots), bool)
        for rings in parts:
            inside_part = ring_holds(rings[0])
            for hole in rings[1:]:
                inside_part &= ~ring_holds(hole)
            held |= inside_part
        want += [(i, int(j)) for j in np.flatnonzero(held)]
    assert len(want) > 1000 and got == sorted(want)


def test_an_edge_is_carried_only_where_it_crosses(spark):
    """50,000 vertices give cells and edge copies of the same order, not edges x cells; cells inside carry none."""
    angle = np.linspace(0, 2 * np.pi, 50_000, endpoint=False)
    ring = np.column_stack([3 * np.cos(angle), 2 * np.sin(angle)]).tolist()
    polygons = spark.createDataFrame([(1, json.dumps({"type": "Polygon", "coordinates": [ring]}))], "id int, poligono string")
    shapes = spatial.polygon_edges(polygons, "poligono").withColumn("_pid", F.lit(1))
    row = spatial.clipped_cells(shapes).agg(
        F.count("*").alias("cells"), F.sum(F.size("_edges")).alias("edges"), F.count_if(F.size("_edges") == 0).alias("inner")).first()
    assert row.cells < 50_000 and row.edges < 120_000 and row.inner > row.cells / 2


def test_missing_coordinates_are_refused(spark):
    shapes = [(1, '{"type":"Polygon","coordinates":[[[0,0],[2,null],[2,2],[0,2]]]}'), (2, '{"type":"Polygon","coordinates":[[[0,0],[2],[2,2],[0,2]]]}'),
              (3, '{"type":"Polygon","coordinates":[[[0,0,7],[2,0,7],[2,2,7],[0,2,7]]]}'), (4, '{"type":"Polygon"}')]
    points = spark.createDataFrame([("p", 1.0, 1.0)], "station string, lat double, lon double")
    found = spatial.points_in_polygons(spark.createDataFrame(shapes, "id int, poligono string"), points).collect()
    assert [r.id for r in found] == [3]


def test_small_polygons_go_into_few_cells(spark):
    """A square carries its edges into four cells at most, wherever it lies."""
    squares = spark.range(60).selectExpr("id", "id * 0.37 - 9 as x", "id * 0.53 - 11 as y", "0.8 + id % 5 * 0.2 as w").selectExpr(
        "id", """concat('{"type":"Polygon","coordinates":[[[', x, ',', y, '],[', x + w, ',', y, '],[', x + w, ',', y + w, '],[', x, ',', y + w, '],[',
        x, ',', y, ']]]}') as poligono""")
    cells = spatial.whole_cells(spatial.polygon_edges(squares, "poligono")).groupBy("id").count()
    assert cells.count() == 60 and cells.agg({"count": "max"}).first()[0] <= 4


def test_the_written_shapes_hold_points_not_edges(spark, monkeypatch):
    written = []
    monkeypatch.setattr(spatial, "materialise", lambda df, name: written.append(df.columns) or df)
    square = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1],[0,0]]]}'
    hollow = '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4]],[[1,1],[3,1],[3,3],[1,3]]]}'
    polygons = spark.createDataFrame([(1, square), (2, hollow), (3, None), (4, "{")], "id int, poligono string")
    points = spark.createDataFrame([(7, 0.5, 0.5), (8, 2.0, 2.0), (9, 3.5, 0.5)], "station int, lat double, lon double")
    got = spatial.points_in_polygons(polygons, points).select("id", "station").collect()
    assert sorted(map(tuple, got)) == [(1, 7), (2, 7), (2, 9)]
    (columns,) = written
    assert "_parts" in columns and "_edges" not in columns
