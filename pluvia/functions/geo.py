"""Geometry expressions: great-circle distance and point in polygon."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pluvia.config import EARTH_RADIUS_KM


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = (
        F.pow(F.sin((p2 - p1) / 2), 2)
        + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    )
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(a))


def parse_geometry(geojson: Column) -> Column:
    """Polygons of a GeoJSON text as ``array<polygon<ring<point>>>``.

    A Polygon becomes a list of one. Missing, unreadable or other geometries give NULL.
    """
    kind = F.get_json_object(geojson, "$.type")
    one = F.from_json(geojson, "coordinates array<array<array<double>>>")["coordinates"]
    many = F.from_json(geojson, "coordinates array<array<array<array<double>>>>")["coordinates"]
    return F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)


def _ring_contains(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd ray rule: west and south edges belong to the ring, east and north do not."""
    n = F.size(ring)
    before = F.concat(F.slice(ring, F.greatest(n, F.lit(1)), F.lit(1)), F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))))

    def crosses(p: Column, q: Column) -> Column:
        px, py, qx, qy = F.get(p, 0), F.get(p, 1), F.get(q, 0), F.get(q, 1)
        reach = (qx - px) * (y - py) / F.nullif(qy - py, F.lit(0.0)) + px
        return F.coalesce(((py > y) != (qy > y)) & (x < reach), F.lit(False))

    crossings = F.size(F.filter(F.zip_with(ring, before, crosses), lambda c: c))
    return (n > 0) & (crossings % 2 == 1)


def polygon_contains(x: Column, y: Column, rings: Column) -> Column:
    """First ring is the outline, the others are holes."""
    inside = F.coalesce(_ring_contains(x, y, F.get(rings, 0)), F.lit(False))
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return (F.size(rings) > 0) & inside & ~F.exists(holes, lambda h: _ring_contains(x, y, h))


def geometry_contains(x: Column, y: Column, polygons: Column) -> Column:
    return F.coalesce(F.exists(polygons, lambda p: polygon_contains(x, y, p)), F.lit(False))
