"""Joins and groups over geometry columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions import geometry as G
from cadastra.session import ship

TILE = 1.0


def _tiles(box: Column, tile: float) -> Column:
    """Keys of all tiles that a box meets."""
    span = lambda a, b: F.sequence(F.floor(box[a] / tile), F.floor(box[b] / tile))
    return F.flatten(F.transform(span("west", "east"), lambda x: F.transform(span("south", "north"), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def assign_regions(points: DataFrame, regions: DataFrame, key: str, tile: float = TILE) -> DataFrame:
    """Every point with the first region (lowest region_no) that holds it, or NULL.

    ``points(key, point)``, ``regions(region_no, rings)``. Both meet on the tiles of a grid, an equi-join
    that doesn't need either side to be small; box and ray tests follow for regions of the point's tile.
    """
    tiled = regions.select("region_no", "rings", G.bbox(F.col("rings")[0]).alias("box")).withColumn("tile", F.explode(_tiles(F.col("box"), tile)))
    p = F.col("point")
    placed = points.withColumn("tile", F.struct(F.floor(p["lon"] / tile).alias("x"), F.floor(p["lat"] / tile).alias("y")))
    inside = p["lon"].between(F.col("box.west"), F.col("box.east")) & p["lat"].between(F.col("box.south"), F.col("box.north")) & G.in_polygon(F.col("rings"), p)
    found = placed.select(key, "point", "tile").join(tiled, "tile").filter(inside).groupBy(key).agg(F.min("region_no").alias("region_no"))
    return points.join(found, key, "left")


def boxes_meeting(left: DataFrame, right: DataFrame, tile: float = TILE) -> DataFrame:
    """Pairs of ``left(.., box)`` and ``right(.., area)`` whose boxes meet; each pair in its lowest common tile."""
    a = left.withColumn("tile", F.explode(_tiles(F.col("box"), tile)))
    b = right.withColumn("tile", F.explode(_tiles(F.col("area"), tile)))
    first = (F.col("tile.x") == F.floor(F.greatest("box.west", "area.west") / tile)) & (F.col("tile.y") == F.floor(F.greatest("box.south", "area.south") / tile))
    return a.join(b, "tile").filter(G.boxes_cross(F.col("box"), F.col("area")) & first).drop("tile")


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Closed, counter-clockwise; two points go there and back, a single one stays as it is."""
    points = sorted(set(points))
    if len(points) < 3:
        return [*points, points[0]] if len(points) == 2 else points
    sides = []
    for order in (points, points[::-1]):
        side: list[tuple[float, float]] = []
        for p in order:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) - (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]) <= 0:
                side.pop()
            side.append(p)
        sides.append(side[:-1])
    ring = sides[0] + sides[1]
    return [*ring, ring[0]]


def hulls(rows: DataFrame, parent: str, point: str) -> DataFrame:
    """Hull of the points of each parent. Equal points are dropped first, and every parent's points are
    first reduced in up to 64 parts, so that no task holds the points of a large parent."""
    ship(rows.sparkSession)
    flat = rows.select(F.col(parent).cast("string").alias(parent), F.col(f"{point}.lon").alias("lon"), F.col(f"{point}.lat").alias("lat")).distinct()
    schema = f"{parent} string, ring array<struct<lon:double,lat:double>>"
    pairs = F.collect_list(F.struct("lon", "lat")).alias("points")
    part = flat.groupBy(parent, F.pmod(F.xxhash64("lon", "lat"), F.lit(64)).alias("part")).agg(pairs).select(parent, "points").mapInArrow(_rings, schema)
    joined = part.groupBy(parent).agg(F.flatten(F.collect_list("ring")).alias("points"))
    return joined.mapInArrow(_rings, schema)


def _rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (parent, points) to (parent, ring): many small groups a batch, as a frame for each would cost far more than its hull."""
    for batch in batches:
        own = batch.column(1)
        flat, ends = own.flatten(), np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy())])
        lon, lat = (flat.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("lon", "lat"))
        rings = [_hull(list(zip(lon[a:b], lat[a:b], strict=True))) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        places = np.array([p for ring in rings for p in ring], float).reshape(-1, 2)
        sizes = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rings])]), pa.int32())
        xy = pa.StructArray.from_arrays([pa.array(places[:, 0]), pa.array(places[:, 1])], names=["lon", "lat"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(sizes, xy)], names=[batch.schema.names[0], "ring"])


def _kept(x: np.ndarray, y: np.ndarray, ends: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices of many lines stay; line ``i`` has those from ``ends[i]`` to ``ends[i + 1]``. All lines are cut at once, a round a depth."""
    sizes = np.diff(ends)
    if tolerance <= 0:
        return np.ones(len(x), bool)
    keep = np.zeros(len(x), bool)
    some = sizes > 0
    keep[ends[:-1][some]] = keep[ends[1:][some] - 1] = True
    a, b = ends[:-1][sizes > 2], ends[1:][sizes > 2] - 1
    while len(a):
        n = b - a - 1
        first = np.cumsum(n) - n
        of = np.repeat(np.arange(len(a)), n)
        at = np.arange(len(of)) - first[of] + a[of] + 1
        dx, dy = (x[b] - x[a])[of], (y[b] - y[a])[of]
        rx, ry = x[at] - x[a][of], y[at] - y[a][of]
        square = dx * dx + dy * dy
        along = np.clip(np.divide(rx * dx + ry * dy, square, out=np.zeros(len(of)), where=square != 0), 0.0, 1.0)
        far = np.hypot(rx - along * dx, ry - along * dy)  # from the segment, not from the line through it
        most = np.maximum.reduceat(far, first)
        far_at = np.minimum.reduceat(np.where(far == most[of], at, len(x)), first)
        split = most > tolerance
        mid = far_at[split]
        keep[mid] = True
        a, b = np.concatenate([a[split], mid]), np.concatenate([mid, b[split]])
        wide = b - a > 1
        a, b = a[wide], b[wide]
    return keep


def simplified(df: DataFrame, line: str, tolerance: float) -> DataFrame:
    """``df`` with ``simple``, the line without vertices nearer than the tolerance, and whether any was lost."""
    ship(df.sparkSession)

    @F.arrow_udf("array<int>")
    def stay(lons: pa.Array, lats: pa.Array) -> pa.Array:
        sizes = lons.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        x, y = (c.flatten().to_numpy(zero_copy_only=False) for c in (lons, lats))
        keep = _kept(x, y, ends, tolerance)
        place = (np.arange(len(x)) - np.repeat(ends[:-1], sizes))[keep]
        offsets = np.concatenate([[0], np.cumsum(keep)])[ends]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(place, pa.int32()))

    of = lambda axis: F.transform(line, lambda p: p[axis].cast("double"))
    out = df.withColumn("_stay", stay(of("lon"), of("lat")))
    place = lambda i: F.struct(F.get(line, i)["lon"].cast("double").alias("lon"), F.get(line, i)["lat"].cast("double").alias("lat"))
    return out.withColumn("simple", F.when(F.col(line).isNotNull(), F.transform("_stay", place))).withColumn("lost", F.size("simple") < F.size(line)).drop("_stay")
