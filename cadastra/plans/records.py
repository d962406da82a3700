"""Records of several entities, declared types, directions of traffic, and rankings with a reference row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators import records as R
from cadastra.operators import traffic as T
from cadastra.plans import traffic
from cadastra.registry import query, table


@query("""SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_totalprice AS price, o_orderkey % 2 = 0 AS sold, CAST(floor(o_totalprice) AS BIGINT) AS units, o_totalprice > 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS has_site,
  CASE WHEN o_orderkey % 4 = 0 THEN 1900 ELSE year(o_orderdate) END AS year, CAST(month(o_orderdate) AS INTEGER) AS month_number, strftime(o_orderdate, '%Y-%m') AS period, year(o_orderdate) || '-T' || quarter(o_orderdate) AS quarter FROM orders WHERE o_orderkey % 7 <> 0""")
def coerced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to declared types on a month axis; a year that the table brings stays; a row without a month goes."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    month = F.when(k % 7 == 0, "soon").when(k % 3 == 0, F.date_format(d, "dd/MM/yyyy")).when(k % 3 == 1, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "MM/yyyy"))
    price = F.format_string("%.2f", "o_totalprice")
    texts = table(spark, sf_dir, "orders").select(
        k.alias("o_orderkey"), month.alias("month"), F.translate(price, ".", ",").alias("price"), F.when(k % 2 == 0, "sim").otherwise("não").alias("sold"), price.alias("units"),
        F.when(k % 3 == 0, "ftp://x").when(k % 5 == 0, "").otherwise("https://X.org/a?b").alias("site"), F.when(k % 4 == 0, "1900").alias("year"),
    )
    schema = {"o_orderkey": "integer", "price": "number", "sold": "flag", "units": "integer", "site": "url", "year": "integer", "absent": "number"}
    return R.coerced(texts, schema, "month").withColumn("has_site", F.col("site") == "https://x.org/a").withColumn("has_site", F.coalesce("has_site", F.lit(False))).drop("site")


@query("""WITH r AS (SELECT 'listing' AS kind, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'L' || p_partkey END AS id, p_brand AS locality, p_retailprice AS price FROM part UNION ALL SELECT 'development', 'D' || s_suppkey, CAST(s_nationkey AS VARCHAR), NULL FROM supplier
UNION ALL SELECT 'anchor', 'A' || n_nationkey, n_name, NULL FROM nation)
SELECT kind, locality, count(*) FILTER (id IS NOT NULL) AS n, count(*) FILTER (id IS NULL) AS dropped, round(max(price) FILTER (id IS NOT NULL), 4) AS price FROM r GROUP BY 1, 2""")
def record_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings, developments and anchors as one set; records without an id are counted apart."""
    part, supplier, nation = (table(spark, sf_dir, t) for t in ("part", "supplier", "nation"))
    listings = R.shaped(part, "listing", {"id": F.when(F.col("p_partkey") % 9 == 0, "  ").otherwise(F.concat(F.lit("L"), "p_partkey")), "title": F.col("p_name"), "category": F.col("p_type"), "locality": F.col("p_brand"), "price": F.col("p_retailprice"), "area": F.col("p_size")})
    developments = R.shaped(supplier, "development", {"id": F.concat(F.lit("D"), "s_suppkey"), "title": F.col("s_name"), "locality": F.col("s_nationkey")})
    anchors = R.shaped(nation, "anchor", {"id": F.concat(F.lit("A"), "n_nationkey"), "title": F.col("n_name"), "locality": F.col("n_name")})
    out = R.record_set([listings, developments, anchors])
    return out.groupBy("kind", "locality").agg(F.count_if(~F.col("dropped")).alias("n"), F.count_if("dropped").alias("dropped"), F.round(F.max(F.when(~F.col("dropped"), F.col("price"))), 4).alias("price"))


@query("""WITH y AS (SELECT c_nationkey AS region, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), s AS (SELECT s_nationkey AS code, round(sum(s_acctbal), 2) AS income FROM supplier GROUP BY 1)
SELECT region, y.year, n, region % 6 = 5 AS blocked, CASE WHEN region % 6 <> 5 AND y.year % 2 = 0 THEN income END AS income FROM y LEFT JOIN s ON code = region""")
def index_with_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions outside the bridge are blocked; incomes are of even years only."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("region"))
    y = table(spark, sf_dir, "orders").join(c, "o_custkey").groupBy("region", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    s = table(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("c"), "s_nationkey").alias("code")).agg(F.round(F.sum("s_acctbal"), 2).alias("income"))
    scalars = s.crossJoin(y.filter("year % 2 = 0").select("year").distinct())  # a row a region and year
    bridge = table(spark, sf_dir, "nation").filter("n_nationkey % 6 <> 5").select(F.col("n_nationkey").alias("region"), F.concat(F.lit("c"), "n_nationkey").alias("code"))
    return R.with_index(y, scalars, bridge).select("region", "year", "n", "blocked", "income")


@query("""WITH m AS (SELECT c_nationkey AS locality, strftime(o_orderdate, '%Y-%m') AS month, round(max(o_totalprice), 2) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), g AS (SELECT *, CASE WHEN locality % 5 <> 0 THEN round(v / 100000 - 1.5, 6) END AS gap FROM m)
SELECT locality, month, v AS value, gap, CASE WHEN gap < 0 THEN 'below' WHEN gap >= 0 THEN 'above' END AS side FROM g QUALIFY row_number() OVER (PARTITION BY locality ORDER BY month DESC) = 1""")
def latest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("locality"))
    m = table(spark, sf_dir, "orders").join(c, "o_custkey").groupBy("locality", F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg(F.round(F.max("o_totalprice"), 2).alias("v"))
    return R.latest_gap(m.withColumn("g", F.when(F.col("locality") % 5 != 0, F.round(F.col("v") / 100000 - 1.5, 6))), "locality", "m", "v", "g")


@query("""WITH m AS (SELECT o_orderpriority AS band, strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN c_nationkey = 0 THEN 'TOTAL' ELSE n_name END AS name, CASE WHEN c_nationkey % 6 <> 1 THEN round(sum(o_totalprice), 2) END AS value
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3, c_nationkey), n AS (SELECT * FROM m WHERE month = (SELECT max(x.month) FROM m x WHERE x.band = m.band))
SELECT band, name, month, value, name = 'TOTAL' AS reference, name <> 'TOTAL' AND value IS NULL AS unranked, CASE WHEN name <> 'TOTAL' AND value IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY band, name <> 'TOTAL' AND value IS NOT NULL ORDER BY value DESC, name) AS INTEGER) END AS place FROM n""")
def ranking_with_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_nationkey") == 0, "TOTAL").otherwise(F.col("n_name")).alias("name"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(n, "c_nationkey")
    m = table(spark, sf_dir, "orders").join(c, "o_custkey").groupBy(F.col("o_orderpriority").alias("band"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), "name", "c_nationkey").agg(F.sum("o_totalprice").alias("s"))
    m = m.select("band", "month", "name", F.when(F.col("c_nationkey") % 6 != 1, F.round("s", 2)).alias("value"))
    return R.ranked_with_reference(m, "name", "band", "month", "value", "TOTAL")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.records(spark, sf_dir).withColumn("code", F.concat(F.lit("k"), F.col("event_id") % 11)).withColumn("day", F.to_date("ts"))


@query(f"""WITH {traffic._E.replace("user_id % 5 AS segment", "'k' || (event_id % 11) AS code")}, f AS (SELECT code, count(DISTINCT day) AS days, round(sum(value), 2) AS flow FROM e GROUP BY 1)
SELECT code, days, flow, CASE WHEN substr(code, 2)::INT % 3 <> 0 THEN 'road' || substr(code, 2) END AS road FROM f WHERE substr(code, 2)::INT >= 5""")
def unmatched_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes k5 to k10 are in no register; the direction map knows some of their roads."""
    days = _points(spark, sf_dir).groupBy("code", "day").agg(F.sum("value").alias("flow"))
    codes = spark.range(11).select(F.concat(F.lit("k"), "id").alias("code"), "id")
    directions = codes.filter("id % 3 <> 0").select("code", F.concat(F.lit("road"), "id").alias("road"))
    return T.unmatched(days, codes.filter("id < 5"), directions).withColumn("flow", F.round("flow", 2))


@query(f"""WITH {traffic._E.replace("user_id % 5 AS segment", "event_id % 11 AS k")}
SELECT 'k' || k AS code, direction, CASE WHEN k < 3 THEN 'own' WHEN k < 8 AND direction = 'north' THEN 'inbound' WHEN k < 8 AND k <> 5 THEN 'outbound' END AS project, CASE WHEN k < 3 THEN 'c1' WHEN k < 8 THEN 'c2' END AS corridor, count(*) AS n FROM e GROUP BY k, direction""")
def direction_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direction map first, then the corridor's record; codes in no corridor have no project direction."""
    codes = spark.range(11).select(F.concat(F.lit("k"), "id").alias("code"), "id")
    directions = codes.filter("id < 3").select("code", F.explode(F.array(F.lit("north"), F.lit("south"))).alias("direction"), F.lit("own").alias("project"), F.lit("c1").alias("corridor"))
    corridors = codes.filter("id < 8").select("code", F.lit("c2").alias("corridor"), F.lit("north").alias("toward_a"), F.when(F.col("id") != 5, "south").alias("toward_b"))
    out = T.project_direction(_points(spark, sf_dir), directions, corridors, ("inbound", "outbound"))
    return out.groupBy("code", "direction", "project", "corridor").agg(F.count("*").alias("n"))


@query(f"""WITH {traffic._E.replace("user_id % 5 AS segment", "event_id % 11 AS k, user_id % 2 AS role")}, d AS (SELECT k, role, day, round(sum(value) FILTER (direction = 'north')) AS a, round(sum(value) FILTER (direction = 'south')) AS b FROM e WHERE k <> 2 OR role = 0 GROUP BY 1, 2, 3)
SELECT 'k' || k AS code, count(DISTINCT role) > 1 AS mixed, count(DISTINCT day) AS days, CASE WHEN count(DISTINCT role) = 1 THEN sum(a) END AS a, CAST(NULL AS DOUBLE) AS b, CAST(NULL AS DOUBLE) AS two_way, count(*) FILTER (k % 4 = 2 AND a + b IS NOT NULL) AS mismatch_days FROM d GROUP BY k""")
def corridor_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measuring points with one side shown; a code of two roles has no totals."""
    side = lambda d: F.round(F.sum(F.when(F.col("direction") == d, F.col("value"))))
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 2).alias("role"), "event_id")
    days = _points(spark, sf_dir).join(e, "event_id").filter("code <> 'k2' or role = 0").groupBy("code", "role", "day").agg(side("north").alias("a"), side("south").alias("b"))
    days = days.withColumn("two_way", F.col("a") + F.col("b") + F.when(F.substring("code", 2, 2).cast("int") % 4 == 2, 1).otherwise(0))
    return T.point_summary(days, "a").drop("first", "last")
