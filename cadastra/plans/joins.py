"""Editions, bridges, pairs and versions over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions.scalar import ratio
from cadastra.operators import joins as J
from cadastra.registry import query, table


def _year(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter(F.year("o_orderdate") == year)
    return o.groupBy("o_custkey").agg(F.count("*").alias("pop"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_EDITIONS = """a AS (SELECT o_custkey, count(*) AS pop, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1),
b AS (SELECT o_custkey, count(*) AS pop, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1)"""


@query(f"""WITH {_EDITIONS} SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.pop AS pop_1996, b.pop AS pop_1998, b.pop - a.pop AS pop_delta,
  round_even((b.pop - a.pop) / CAST(a.pop AS DOUBLE), 4) AS pop_change, CASE WHEN a.pop IS NULL THEN 'missing_1996' WHEN b.pop IS NULL THEN 'missing_1998' ELSE '' END AS flags FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def edition_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = J.editions(_year(spark, sf_dir, 1996), _year(spark, sf_dir, 1998), "o_custkey", ["pop"], ("1996", "1998"))
    return out.withColumn("flags", F.array_join("flags", ","))


@query(f"""WITH {_EDITIONS} SELECT b.o_custkey, round(b.total - a.total, 2) AS delta, round((b.total - a.total) / nullif(a.total, 0), 6) AS change, a.total IS NULL AS no_base FROM b LEFT JOIN a ON a.o_custkey = b.o_custkey""")
def previous_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _year(spark, sf_dir, 1996).select("o_custkey", F.col("total").alias("before"))
    out = _year(spark, sf_dir, 1998).join(a, "o_custkey", "left")
    return out.select("o_custkey", F.round(F.col("total") - F.col("before"), 2).alias("delta"), F.round(ratio(F.col("total") - F.col("before"), F.col("before")), 6).alias("change"), F.col("before").isNull().alias("no_base"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 5 = 4 THEN NULL ELSE c_nationkey END AS canonical FROM customer""")
def bridge_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("ra", F.format_string("RA_%02d", "n_nationkey"))
    code = F.when(F.col("c_nationkey") % 5 == 4, "unknown").when(F.col("c_custkey") % 2 == 0, F.lower(F.format_string(" RA_%02d", "c_nationkey"))).otherwise(F.col("c_nationkey").cast("string"))
    c = table(spark, sf_dir, "customer").select("c_custkey", code.alias("code"))
    return J.translate(c, "code", n, ["ra", "n_nationkey", "n_name"], "n_nationkey").select("c_custkey", "canonical")


@query("""WITH s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_nationkey % 4 <> 0 GROUP BY 1), c AS (SELECT c_nationkey AS k, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_nationkey % 6 <> 0 GROUP BY 1)
SELECT n_nationkey, suppliers, customers, round(1000.0 * suppliers / customers, 4) AS per_1000, concat_ws(',', CASE WHEN suppliers IS NULL THEN 'jobs_missing' END, CASE WHEN customers IS NULL THEN 'households_missing' END) AS missing
  FROM nation LEFT JOIN s ON s.k = n_nationkey LEFT JOIN c ON c.k = n_nationkey""")
def region_wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").filter("s_nationkey % 4 <> 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    c = table(spark, sf_dir, "customer").filter("c_nationkey % 6 <> 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    out = J.with_blocks(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", {"jobs": s, "households": c})
    return out.select("n_nationkey", "suppliers", "customers", F.round(ratio(1000.0 * F.col("suppliers"), F.col("customers")), 4).alias("per_1000"), F.array_join("missing", ",").alias("missing"))


@query("""WITH t AS (SELECT coalesce(CASE WHEN c_nationkey % 5 <> 0 THEN 'R' || c_nationkey END, 'SEM_RA') AS region, c_acctbal FROM customer)
SELECT region, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM t GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*), round(sum(c_acctbal), 2) FROM t""")
def lenient_sum_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = F.coalesce(F.when(F.col("c_nationkey") % 5 != 0, F.concat(F.lit("R"), "c_nationkey")), F.lit("SEM_RA"))
    out = table(spark, sf_dir, "customer").withColumn("region", region).rollup("region").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return out.withColumn("region", F.coalesce("region", F.lit("TOTAL")))


@query("""WITH p AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, s_nationkey, l_returnflag, round(sum(l_extendedprice), 2) AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE NOT (l_returnflag = 'R' AND s_nationkey % 6 = 0) GROUP BY 1, 2, 3)
SELECT month, s_nationkey, max(v) FILTER (l_returnflag = 'A') AS sale, max(v) FILTER (l_returnflag = 'R') AS rent, round(max(v) FILTER (l_returnflag = 'R') / max(v) FILTER (l_returnflag = 'A'), 6) AS monthly,
  CASE WHEN max(v) FILTER (l_returnflag = 'R') IS NULL THEN 'partial_sale_only' WHEN max(v) FILTER (l_returnflag = 'A') IS NULL THEN 'partial_rent_only' ELSE 'ok' END AS quality FROM p WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2""")
def pair_sale_rent(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    p = li.filter("not (l_returnflag = 'R' and s_nationkey % 6 = 0)").groupBy(F.trunc("l_shipdate", "month").alias("month"), "s_nationkey", "l_returnflag").agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    return J.paired(p, ["month", "s_nationkey"], "l_returnflag", "v", "A", "R").drop("yearly").withColumn("monthly", F.round("monthly", 6))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return J.latest(o, ["o_custkey"], F.struct("o_orderdate", "o_orderkey")).drop("o_orderdate")


@query("""SELECT o_custkey, year(o_orderdate)::INT AS year, min(o_orderkey) AS o_orderkey, count(*) - 1 AS dropped FROM orders GROUP BY 1, 2""")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_orderkey")
    kept, report = J.first_wins(o, ["o_custkey", "year"], F.col("o_orderkey"))
    return kept.join(report, ["o_custkey", "year"], "left").withColumn("dropped", F.coalesce("dropped", F.lit(0)))


@query("""SELECT c_custkey FROM customer WHERE (c_nationkey * 100 + c_custkey % 97) NOT IN (SELECT c_nationkey * 100 + c_custkey % 97 FROM customer GROUP BY 1 HAVING count(*) > 1) AND c_acctbal NOT IN (SELECT c_acctbal FROM customer GROUP BY 1 HAVING count(*) > 1)""")
def conflict_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") * 100 + F.col("c_custkey") % 97).alias("code"), "c_acctbal")
    return J.without_conflicts(c, ["code", "c_acctbal"]).select("c_custkey")


@query("""SELECT o_orderkey, lead(o_orderkey) OVER w AS next_key, lead(o_orderkey) OVER w IS NULL AS active FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def scd2_valid_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return J.valid_to(o, "o_custkey", "o_orderkey").select("o_orderkey", F.col("valid_to").alias("next_key"), "active")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey WHEN o_orderkey % 3 = 1 THEN CASE WHEN o_custkey + 1 IN (SELECT c_custkey FROM customer) THEN o_custkey + 1 END END AS existing FROM orders""")
def match_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda k: F.concat(F.lit("k"), k)
    k, c = F.col("o_orderkey") % 3, F.col("o_custkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, name(c)).alias("a"), F.when(k <= 1, name(c + 1)).alias("b"))
    return J.match_existing(o, "o_orderkey", ["a", "b"], table(spark, sf_dir, "customer").select("c_custkey", name(F.col("c_custkey")).alias("key")), "key", "c_custkey").select("o_orderkey", "existing")


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '://[^/?#]*?([^./?#]+[.][^./?#]+)(?:[/?#]|$)', 1) AS portal, regexp_replace(url, '[?#].*$', '') AS address FROM pages),
old AS (SELECT page_id AS known, portal, CASE WHEN page_id % 3 <> 0 THEN 'x' || (page_id // 4) END AS token, address FROM p WHERE page_id % 2 = 0),
hits AS (SELECT n.page_id, o.known AS existing, 0 AS rank FROM p n JOIN old o ON o.portal = n.portal AND o.token = 'x' || (n.page_id // 2) WHERE n.page_id % 5 <> 0
  UNION ALL SELECT n.page_id, o.known, 1 FROM p n JOIN old o ON o.address = n.address WHERE n.page_id % 7 <> 0)
SELECT page_id, existing, CASE rank WHEN 0 THEN 'token' ELSE 'address' END AS matched_by FROM hits QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rank, existing) = 1""")
def known_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against those of even id: by portal (written otherwise) and token, then by address with another query."""
    p, k = table(spark, sf_dir, "pages"), F.col("page_id")
    site = F.regexp_extract("url", "://[^/?#]*?([^./?#]+[.][^./?#]+)(?:[/?#]|$)", 1)
    token = lambda by: F.concat(F.lit("x"), F.floor(k / by))
    old = p.filter(k % 2 == 0).select("page_id", site.alias("portal"), F.when(k % 3 != 0, token(4)).alias("token"), "url")
    new = p.select("page_id", F.concat(F.lit(" "), F.upper(site)).alias("portal"), F.when(k % 5 != 0, token(2)).otherwise(" ").alias("token"), F.when(k % 7 != 0, F.concat("url", F.lit("?from=list"))).otherwise("ftp://none").alias("url"))
    return J.known_listings(new, "page_id", old, "page_id")


@query("""WITH n AS (SELECT l_suppkey, l_returnflag, count(*) AS n, min(l_orderkey) AS f FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_returnflag FROM n QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, f, l_returnflag DESC) = 1""")
def dominant_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.dominant(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey"), "l_suppkey", "l_returnflag", "l_orderkey")


@query("""SELECT p_partkey FROM part WHERE p_size >= 20 AND p_brand LIKE '%1'""")
def attribute_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    eav = p.select("p_partkey", F.explode(F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))).alias("attribute", "value"))
    return J.all_of(eav, "p_partkey", "attribute", {"size": F.col("value").try_cast("int") >= 20, "brand": F.col("value").endswith("1")})


@query("""SELECT p_partkey, CAST(p_size AS VARCHAR) AS size, p_brand AS brand, p_type AS type FROM part""")
def attribute_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    eav = p.select("p_partkey", F.explode(F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))).alias("attribute", "value"))
    return J.attributes(eav, "p_partkey", "attribute", "value", ["size", "brand", "type"])
