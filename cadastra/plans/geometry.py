"""Geometry over tables: squares and lines made from keys by fixed arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions import geometry as G
from cadastra.operators.quadtree import assign_by_density
from cadastra.operators.spatial import assign_regions, boxes_meeting, hulls, simplified
from cadastra.registry import dealt, query, table


def _at(key: str, mod: int, scale: float, base: float) -> Column:
    return F.pmod(F.col(key), F.lit(mod)) * scale + base


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square of side 1 for every nation, five in a row; the nations of a row touch."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(k.alias("region_no"), F.array(G.square((k % 5).cast("double"), F.floor(k / 5).cast("double"), 1.0)).alias("rings"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for every customer; some lie on borders and some outside."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.struct((_at("c_custkey", 23, 0.25, 0.0)).alias("lon"), _at("c_custkey", 29, 0.2, -0.4).alias("lat")).alias("point"))


POINTS_SQL = "SELECT c_custkey, (c_custkey % 23) * 0.25::DOUBLE AS lon, (c_custkey % 29) * 0.2::DOUBLE + -0.4::DOUBLE AS lat FROM customer"


@query(f"""WITH p AS ({POINTS_SQL}) SELECT c_custkey, CAST(min(n_nationkey) AS INTEGER) AS region_no FROM p LEFT JOIN nation
  ON lon BETWEEN n_nationkey % 5 AND n_nationkey % 5 + 1 AND lat BETWEEN n_nationkey // 5 AND n_nationkey // 5 + 1 GROUP BY c_custkey""")
def pip_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_regions(points(spark, sf_dir), regions(spark, sf_dir), "c_custkey").select("c_custkey", "region_no")


@query("""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 6 THEN 1.3 ELSE (o_orderkey % 797) * 0.007::DOUBLE END AS lon, CASE WHEN o_orderkey % 10 < 6 THEN 2.7 ELSE (o_orderkey % 613) * 0.009::DOUBLE END AS lat FROM orders)
SELECT o_orderkey, CAST(min(n_nationkey) AS INTEGER) AS region_no FROM p LEFT JOIN nation ON lon BETWEEN n_nationkey % 5 AND n_nationkey % 5 + 1 AND lat BETWEEN n_nationkey // 5 AND n_nationkey // 5 + 1 GROUP BY o_orderkey""")
def pip_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for every order, six in ten of them at one place, against regions met by tiles of bounded counts."""
    k = F.col("o_orderkey")
    lon, lat = F.when(k % 10 < 6, 1.3).otherwise((k % 797) * 0.007), F.when(k % 10 < 6, 2.7).otherwise((k % 613) * 0.009)
    at = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(lon.alias("lon"), lat.alias("lat")).alias("point"))
    return assign_by_density(at, regions(spark, sf_dir), "o_orderkey", bound=2_000).select("o_orderkey", "region_no")


@query("""WITH b AS (SELECT s_suppkey, (s_suppkey % 17) * 0.3::DOUBLE AS w, (s_suppkey % 13) * 0.4::DOUBLE AS s FROM supplier)
SELECT s_suppkey, n_nationkey AS region_no FROM b JOIN nation ON w <= n_nationkey % 5 + 1 AND n_nationkey % 5 <= w + 0.5 AND s <= n_nationkey // 5 + 1 AND n_nationkey // 5 <= s + 0.5""")
def bbox_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "supplier").select("s_suppkey", G.bbox(G.square(_at("s_suppkey", 17, 0.3, 0.0), _at("s_suppkey", 13, 0.4, 0.0), 0.5)).alias("box"))
    areas = regions(spark, sf_dir).select("region_no", G.bbox(F.col("rings")[0]).alias("area"))
    return boxes_meeting(boxes, areas).select("s_suppkey", "region_no")


@query("""WITH r AS (SELECT p_partkey, -48 + (p_partkey % 100) / 100.0 AS lon, -16 + (p_partkey % 70) / 100.0 AS lat, p_size / 1000.0 AS side FROM part)
SELECT p_partkey, round(side * side * pow(radians(1.0) * 6371.0088, 2) * cos(radians((5 * lat + 2 * side) / 5)), 5) AS km2,
  round(lon + side / 2, 6) AS lon, round(lat + side / 2, 6) AS lat, CAST(0 AS INTEGER) AS errors FROM r""")
def ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ring = G.square(-48 + (k % 100) / 100.0, -16 + (k % 70) / 100.0, F.col("p_size") / 1000.0)
    rows = table(spark, sf_dir, "part").select("p_partkey", ring.alias("ring"))
    c = G.centroid(F.col("ring"))
    return rows.select("p_partkey", F.round(G.area_km2(F.col("ring")), 5).alias("km2"), F.round(c["lon"], 6).alias("lon"), F.round(c["lat"], 6).alias("lat"), F.size(G.ring_errors(F.col("ring"))).alias("errors"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, -48 + (l_partkey % 100) / 100.0 AS lon, -16 + (l_suppkey % 50) / 100.0 AS lat, l_quantity / 1000.0 AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(d) / 2), 2))) + 2 * 6371.0088 * asin(sqrt(pow(cos(radians(lat + d)), 2) * pow(sin(radians(d) / 2), 2))), 6) AS km FROM e""")
def line_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat, d = -48 + (F.col("l_partkey") % 100) / 100.0, -16 + (F.col("l_suppkey") % 50) / 100.0, F.col("l_quantity") / 1000.0
    p = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    return dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).select("l_orderkey", "l_linenumber", F.round(G.length_km(F.array(p(lon, lat), p(lon, lat + d), p(lon + d, lat + d))), 6).alias("km"))


@query("""SELECT s_suppkey, round((s_suppkey % 50) / 10.0 + 0.5, 6) AS lon, CAST(s_suppkey % 30 AS DOUBLE) AS lat FROM supplier""")
def line_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    p = lambda dx: F.struct(((k % 50) / 10.0 + dx).alias("lon"), (k % 30).cast("double").alias("lat"))
    m = G.midpoint(F.array(p(0.0), p(0.25), p(1.0)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(m["lon"], 6).alias("lon"), m["lat"].alias("lat"))


@query("""WITH v AS (SELECT n_nationkey, CAST(n_nationkey % 4 AS INTEGER) AS kind FROM nation)
SELECT n_nationkey, CASE kind WHEN 0 THEN '' WHEN 1 THEN 'few_positions,few_distinct' WHEN 2 THEN 'not_closed' ELSE 'out_of_range' END AS errors FROM v""")
def ring_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    ring = G.square(F.when(k % 4 == 3, 200.0).otherwise(1.0), F.lit(2.0), 1.0)
    ring = F.when(k % 4 == 1, F.array(ring[0], ring[1], ring[0])).when(k % 4 == 2, F.slice(ring, 1, 4)).otherwise(ring)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(G.ring_errors(ring), ",").alias("errors"))


@query()
def hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convex hull of the points of every nation's customers, dealt out by 25 (no hull function in SQL)."""
    rows = table(spark, sf_dir, "customer").select(F.concat_ws("_", "c_nationkey", F.floor(F.col("c_custkey") / 25)).alias("parent"), F.struct(_at("c_custkey", 23, 0.25, 0.0).alias("lon"), _at("c_custkey", 29, 0.2, 0.0).alias("lat")).alias("point"))
    return hulls(rows, "parent", "point")


@query()
def simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the prices of each order, simplified (no such function in SQL)."""
    steps = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("double").alias("lon"), (F.col("l_quantity") / 10).alias("lat")))).alias("line"))
    return simplified(steps, "line", 0.5).select("l_orderkey", F.size("line").alias("before"), F.size("simple").alias("after"), "lost")
