"""Tiles by density: a quadtree whose leaves hold a bounded number of points.

Points are counted by the smallest cell first. From the root down, a tile with more points than the bound is
split into sixteen (two levels at a time, from the smallest tile that holds all points); a tile at the greatest depth that still has more, as very many points lie at one place, is
dealt to as many parts as it needs. Regions go down the same tree with their boxes, so a region meets only
leaves that its box touches, and no leaf's part is larger than the bound whatever the points' density.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions import geometry as G
from cadastra.session import cut

#: Points of a leaf's part, the greatest depth, levels a split, and the frame that all tiles lie in.
BOUND, DEPTH, STEP = 50_000, 14, 2
WEST, SOUTH, SPAN = -180.0, -180.0, 360.0
#: Cells whose points are dealt out before they learn their leaf: the HOT largest of more than BOUND points.
HOT = 10_000


def _cell(at: Column, low: float) -> Column:
    """The number of the smallest cell along an axis; what lies outside of the frame is in the outermost."""
    side = 1 << DEPTH
    return F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor((at - low) / (SPAN / side)).cast("int")))


def _tile(depth: int) -> list[Column]:
    return [F.shiftright(c, DEPTH - depth).alias(c[1:]) for c in ("cx", "cy")]


def leaves(cells: DataFrame, start: int, bound: int = BOUND) -> DataFrame:
    """``cx, cy, depth, x, y, n`` of every cell of ``cells(cx, cy, n)``: the leaf that it lies in and the leaf's points."""
    open_, found = cells, None
    for depth in range(start, DEPTH + 1, STEP):
        tiles = open_.groupBy(*_tile(depth)).agg(F.sum("n").alias("total"))
        done = F.col("total") <= bound if depth < DEPTH else F.lit(True)
        placed = cut(open_.select("*", *_tile(depth)).join(tiles, ["x", "y"]).withColumn("done", done))
        own = placed.filter("done").select("cx", "cy", F.lit(depth).alias("depth"), "x", "y", F.col("total").alias("n"))
        found = own if found is None else found.unionByName(own)
        open_ = placed.filter("not done").select("cx", "cy", "n")
        if open_.isEmpty():
            break
    return found


def _start(cells: DataFrame) -> tuple[int, int, int]:
    """Depth, x and y of the smallest tile (of the depths that are looked at) that holds all cells."""
    a, b, c, d = cells.agg(F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy")).first()
    if a is None:
        return DEPTH, 0, 0
    depth = DEPTH - max((a ^ b).bit_length(), (c ^ d).bit_length())
    depth -= (DEPTH - depth) % STEP
    return max(depth, 0), a >> (DEPTH - max(depth, 0)), c >> (DEPTH - max(depth, 0))


def _met(boxes: DataFrame, tiles: DataFrame, root: tuple[int, int, int]) -> DataFrame:
    """``boxes`` with the leaves of ``tiles(depth, x, y, parts)`` that their box touches, found from the root down."""
    start, x, y = root
    deepest = tiles.agg(F.max("depth")).first()[0]
    if deepest is None:
        return boxes.limit(0).select("*", *(F.lit(0).alias(c) for c in ("depth", "x", "y", "part")))
    spans = lambda c, low, a, b, d: F.col(c).between(F.shiftright(_cell(F.col(f"box.{a}"), low), DEPTH - d), F.shiftright(_cell(F.col(f"box.{b}"), low), DEPTH - d))
    going = boxes.select("*", F.lit(start).alias("depth"), F.lit(x).alias("x"), F.lit(y).alias("y")).filter(spans("x", WEST, "west", "east", start) & spans("y", SOUTH, "south", "north", start))
    out = None
    for depth in range(start, deepest + 1, STEP):
        at = tiles.filter(F.col("depth") == depth).select("x", "y", "parts")
        below = tiles.filter(F.col("depth") > depth).selectExpr(f"shiftright(x, depth - {depth}) AS x", f"shiftright(y, depth - {depth}) AS y").distinct()
        leaf = going.join(at, ["x", "y"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").withColumn("depth", F.lit(depth))
        out = leaf if out is None else out.unionByName(leaf)
        if depth < deepest:
            side = 1 << STEP
            inner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(side) for j in range(side))))
            down = going.join(below, ["x", "y"], "left_semi").withColumn("q", inner)
            down = down.select(*boxes.columns, F.lit(depth + STEP).alias("depth"), (F.col("x") * side + F.col("q.i")).alias("x"), (F.col("y") * side + F.col("q.j")).alias("y"))
            going = cut(down.filter(spans("x", WEST, "west", "east", depth + STEP) & spans("y", SOUTH, "south", "north", depth + STEP)))
    return out


def assign_by_density(points: DataFrame, regions: DataFrame, key: str, bound: int = BOUND) -> DataFrame:
    """Every point with the first region (lowest region_no) that holds it, or NULL.

    ``points(key, point)`` with distinct keys, ``regions(region_no, rings)``. A point without a place, or
    with a null key, has no region.
    """
    p = F.col("point")
    placed = points.filter(F.col(key).isNotNull() & p["lon"].isNotNull() & p["lat"].isNotNull()).select(key, "point", _cell(p["lon"], WEST).alias("cx"), _cell(p["lat"], SOUTH).alias("cy"))
    cells = cut(placed.groupBy("cx", "cy").agg(F.count("*").alias("n")))
    root = _start(cells)
    of = cut(leaves(cells, root[0], bound).withColumn("parts", F.ceil(F.col("n") / bound).cast("int")))
    boxed = regions.select("region_no", "rings", G.bbox(F.col("rings")[0]).alias("box")).filter("box is not null")
    met = _met(boxed, of.select("depth", "x", "y", "parts").distinct(), root)
    # points learn their leaf by their cell; a cell with more points than the bound is dealt out
    rows = cells.filter(F.col("n") > bound).orderBy(F.desc("n"), "cx", "cy").limit(HOT).select("cx", "cy", F.ceil(F.col("n") / bound).cast("int").alias("of"))
    hot = F.broadcast(rows)
    dealt = placed.join(hot, ["cx", "cy"], "left").withColumn("salt", F.pmod(F.xxhash64(key), F.coalesce("of", F.lit(1))).cast("int")).drop("of")
    where = of.join(hot, ["cx", "cy"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("of", F.lit(1)) - 1))).select("cx", "cy", "salt", "depth", "x", "y", "parts")
    at = dealt.join(where, ["cx", "cy", "salt"]).withColumn("part", F.pmod(F.xxhash64(key, F.lit("part")), F.col("parts")).cast("int")).select(key, "point", "depth", "x", "y", "part")
    inside = p["lon"].between(F.col("box.west"), F.col("box.east")) & p["lat"].between(F.col("box.south"), F.col("box.north")) & G.in_polygon(F.col("rings"), p)
    found = at.join(met, ["depth", "x", "y", "part"]).filter(inside).groupBy(key).agg(F.min("region_no").alias("region_no"))
    return points.join(found, key, "left")
