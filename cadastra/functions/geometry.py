"""Column functions over arrays of struct<lon,lat>: boxes, rings, lines. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0088


def bbox(ring: Column) -> Column:
    """struct(west, south, east, north)."""
    lon, lat = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return F.struct(F.array_min(lon).alias("west"), F.array_min(lat).alias("south"), F.array_max(lon).alias("east"), F.array_max(lat).alias("north"))


def boxes_cross(a: Column, b: Column) -> Column:
    """Whether two boxes have a point in common."""
    return (a["west"] <= b["east"]) & (b["west"] <= a["east"]) & (a["south"] <= b["north"]) & (b["south"] <= a["north"])


def _pairs(points: Column) -> Column:
    """Consecutive points as struct(a, b)."""
    n = F.size(points)
    return F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _cross(p: Column) -> Column:
    return p["a"]["lon"] * p["b"]["lat"] - p["b"]["lon"] * p["a"]["lat"]


def _from_first(ring: Column) -> Column:
    """The ring with its first point at the origin, where products lose no digits."""
    return F.transform(ring, lambda p: F.struct((p["lon"] - ring[0]["lon"]).alias("lon"), (p["lat"] - ring[0]["lat"]).alias("lat")))


def centroid(ring: Column) -> Column:
    """struct(lon, lat) by the area formula; the mean of the vertices where the ring has no area."""
    near = _from_first(ring)
    area = _sum(F.transform(_pairs(near), _cross))
    by_area = F.struct(
        (ring[0]["lon"] + F.try_divide(_sum(F.transform(_pairs(near), lambda p: (p["a"]["lon"] + p["b"]["lon"]) * _cross(p))), 3 * area)).alias("lon"),
        (ring[0]["lat"] + F.try_divide(_sum(F.transform(_pairs(near), lambda p: (p["a"]["lat"] + p["b"]["lat"]) * _cross(p))), 3 * area)).alias("lat"),
    )
    mean = F.struct(F.try_divide(_sum(F.transform(ring, lambda p: p["lon"])), F.size(ring)).alias("lon"), F.try_divide(_sum(F.transform(ring, lambda p: p["lat"])), F.size(ring)).alias("lat"))
    return F.when(F.abs(area) > 1e-15, by_area).otherwise(mean)


def area_km2(ring: Column) -> Column:
    """Area on a local plane at the ring's mean latitude."""
    lat = F.radians(F.try_divide(_sum(F.transform(ring, lambda p: p["lat"])), F.size(ring)))
    scale = F.radians(F.lit(1.0)) * RADIUS_KM
    return F.abs(_sum(F.transform(_pairs(_from_first(ring)), _cross))) / 2 * scale * scale * F.cos(lat)


def polygon_area_km2(rings: Column) -> Column:
    """Area of the first ring without that of the others, its holes."""
    return area_km2(rings[0]) - _sum(F.transform(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), area_km2))


def haversine_km(a: Column, b: Column) -> Column:
    """Great-circle distance of two points."""
    h = F.pow(F.sin(F.radians(b["lat"] - a["lat"]) / 2), 2) + F.cos(F.radians(a["lat"])) * F.cos(F.radians(b["lat"])) * F.pow(F.sin(F.radians(b["lon"] - a["lon"]) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(h))


def length_km(line: Column) -> Column:
    return _sum(F.transform(_pairs(line), lambda p: haversine_km(p["a"], p["b"])))


def midpoint(line: Column) -> Column:
    """The point at half the length of a line."""
    half = length_km(line) / 2
    start = F.struct(F.lit(0.0).alias("walked"), line[0].alias("at"))
    def walk(acc: Column, p: Column) -> Column:
        step = haversine_km(p["a"], p["b"])
        share = F.coalesce(F.try_divide(half - acc["walked"], step), F.lit(0.0))
        here = F.struct((p["a"]["lon"] + share * (p["b"]["lon"] - p["a"]["lon"])).alias("lon"), (p["a"]["lat"] + share * (p["b"]["lat"] - p["a"]["lat"])).alias("lat"))
        return F.struct((acc["walked"] + step).alias("walked"), F.when((acc["walked"] < half) & (acc["walked"] + step >= half), here).otherwise(acc["at"]).alias("at"))
    return F.aggregate(_pairs(line), start, walk)["at"]


def contains(ring: Column, point: Column) -> Column:
    """Whether a point lies in a ring; its border counts as inside."""
    def crosses(p: Column) -> Column:
        a, b = p["a"], p["b"]
        at = F.try_divide((b["lon"] - a["lon"]) * (point["lat"] - a["lat"]), b["lat"] - a["lat"]) + a["lon"]
        return F.coalesce(((a["lat"] > point["lat"]) != (b["lat"] > point["lat"])) & (point["lon"] < at), F.lit(False))
    def on(p: Column) -> Column:
        a, b = p["a"], p["b"]
        cross = (b["lon"] - a["lon"]) * (point["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (point["lon"] - a["lon"])
        return (F.abs(cross) < 1e-12) & point["lon"].between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & point["lat"].between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))
    return F.exists(_pairs(ring), on) | (F.size(F.filter(_pairs(ring), crosses)) % 2 == 1)


def in_polygon(rings: Column, point: Column) -> Column:
    """In the first ring and in none of its holes."""
    return contains(rings[0], point) & ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: contains(r, point))


def ring_errors(ring: Column) -> Column:
    """Names of what is wrong with a ring."""
    return F.array_compact(F.array(
        F.when(F.size(ring) < 4, "few_positions"),
        F.when((F.size(ring) > 0) & (ring[0] != F.element_at(ring, -1)), "not_closed"),
        F.when(F.size(F.array_distinct(ring)) < 3, "few_distinct"),
        F.when(F.exists(ring, lambda p: ~p["lon"].between(-180, 180) | ~p["lat"].between(-90, 90)), "out_of_range"),
    ))


def rounded(points: Column, digits: int) -> Column:
    return F.transform(points, lambda p: F.struct(F.bround(p["lon"], digits).alias("lon"), F.bround(p["lat"], digits).alias("lat")))


def fingerprint(points: Column, digits: int = 6) -> Column:
    """sha256 of the rounded points."""
    return F.sha2(F.to_json(rounded(points, digits)), 256)


def square(lon: Column, lat: Column, side: float | Column) -> Column:
    """A closed ring with (lon, lat) at its south-west corner."""
    at = lambda dx, dy: F.struct((lon + dx).alias("lon"), (lat + dy).alias("lat"))
    side = side if isinstance(side, Column) else F.lit(float(side))
    zero = F.lit(0.0)
    return F.array(at(zero, zero), at(side, zero), at(side, side), at(zero, side), at(zero, zero))
