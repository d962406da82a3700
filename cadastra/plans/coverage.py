"""Coverage of part as listings: brand = region, type = type, size = area, supplier parity = portal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions.scalar import band
from cadastra.operators import coverage as C
from cadastra.registry import query, table

_BANDS = "CASE WHEN p_size < 10 THEN 's' WHEN p_size < 30 THEN 'm' ELSE 'l' END AS beds, CASE WHEN p_retailprice < 1200 THEN 'low' ELSE 'high' END AS price, p_partkey % 3 AS portal"


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice",
        band(F.col("p_size"), [10, 30], ["s", "m", "l"], "sem_info").alias("beds"), band(F.col("p_retailprice"), [1200], ["low", "high"], "sem_preco").alias("price"), (F.col("p_partkey") % 3).alias("portal"),
    )


@query(f"""WITH l AS (SELECT *, {_BANDS} FROM part)
SELECT p_brand, p_type, beds, price, count(*) AS n, count(DISTINCT portal) AS sources FROM l GROUP BY 1, 2, 3, 4 UNION ALL SELECT p_brand, p_type, 'TODOS', 'TODOS', count(*), count(DISTINCT portal) FROM l GROUP BY 1, 2""")
def coverage_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cube(listings(spark, sf_dir), ["p_brand", "p_type"], ["beds", "price"], "portal")


@query("""WITH b AS (SELECT DISTINCT p_brand FROM part), t AS (SELECT DISTINCT p_type FROM part), c AS (SELECT p_brand, p_type, count(*) AS n, count(DISTINCT p_partkey % 3) AS sources FROM part WHERE p_size < 6 GROUP BY 1, 2)
SELECT p_brand, p_type, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'single' WHEN n < 3 THEN 'thin' WHEN sources <= 1 THEN 'single_portal' ELSE 'ok' END AS status FROM b CROSS JOIN t LEFT JOIN c USING (p_brand, p_type)""")
def coverage_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    n = rows.filter("p_size < 6").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.count_distinct("portal").alias("sources"))
    out = C.with_spine(n, rows.select("p_brand").distinct(), rows.select("p_type").distinct())
    return out.select("p_brand", "p_type", "n", C.status(F.col("n"), F.col("sources")).alias("status"))


@query("""WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS active, count(DISTINCT o_custkey % 4) AS sources,
  quantile_cont(o_totalprice, 0.5) FILTER (o_orderstatus <> 'F') AS median FROM orders GROUP BY 1, 2)
SELECT a.month, a.o_orderpriority, a.n, a.active, a.sources, round(a.median, 4) AS median, round((a.median - b.median) / b.median, 6) AS median_change, round((a.active - b.active) / CAST(nullif(b.active, 0) AS DOUBLE), 6) AS active_change
FROM m a LEFT JOIN m b ON b.o_orderpriority = a.o_orderpriority AND b.month + INTERVAL 1 MONTH = a.month""")
def monthly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("month", F.trunc("o_orderdate", "month")).withColumn("portal", F.col("o_custkey") % 4)
    out = C.monthly(o, ["o_orderpriority"], "month", "o_totalprice", "portal", F.col("o_orderstatus") != "F")
    return out.select("month", "o_orderpriority", "n", "active", "sources", F.round("median", 4).alias("median"), F.round("median_change", 6).alias("median_change"), F.round("active_change", 6).alias("active_change"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) <= '1998-06-30' THEN 'inactive' WHEN date_trunc('month', o_orderdate) = '1998-06-01' THEN 'active' ELSE 'unverified' END AS status FROM orders""")
def history_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    o = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("seen"), F.when(F.col("o_orderstatus") == "F", day).alias("gone"))
    return C.history(o, F.lit("1998-06-30").cast("date"), "gone", "seen").select("o_orderkey", "status")


@query("""SELECT count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS active, count(*) FILTER (CAST(o_orderdate AS DATE) BETWEEN '1998-06-23' AND '1998-06-30') AS recent, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last FROM orders""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("seen", F.col("o_orderdate").cast("date"))
    return C.freshness(o, F.lit("1998-06-30").cast("date"), "seen", F.col("o_orderstatus") != "F")


@query("""WITH o AS (SELECT c_nationkey AS region, c_mktsegment AS indicator, c_custkey % 7 AS category, c_custkey % 2 = 0 AS suppressed FROM customer WHERE NOT (c_nationkey = 3 AND c_mktsegment LIKE 'A%')),
own AS (SELECT region, indicator, count(DISTINCT category) AS loaded, count(*) FILTER (suppressed) AS hidden FROM o GROUP BY 1, 2), e AS (SELECT indicator, max(loaded) AS expected FROM own GROUP BY 1)
SELECT n_nationkey AS region, e.indicator, coalesce(loaded, 0) AS loaded, expected, CASE WHEN loaded IS NULL THEN 'missing' WHEN hidden >= loaded THEN 'suppressed_source' WHEN loaded < expected THEN 'partial' ELSE 'complete' END AS state
FROM nation CROSS JOIN e LEFT JOIN own ON own.region = n_nationkey AND own.indicator = e.indicator""")
def survey_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    o = table(spark, sf_dir, "customer").filter("not (c_nationkey = 3 and c_mktsegment like 'A%')").select(F.col("c_nationkey").alias("region"), F.col("c_mktsegment").alias("indicator"), (k % 7).alias("category"), (k % 2 == 0).alias("suppressed"))
    return C.expected_categories(o, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("region")), o.select("indicator").distinct())


@query("""WITH x AS (SELECT l_suppkey % 20 AS region, l_returnflag AS indicator, l_linenumber AS category, l_quantity AS v, l_orderkey % 4 = 0 AS suppressed, l_orderkey * 100 + l_linenumber AS pos FROM lineitem)
SELECT region, indicator, category, v AS value FROM x QUALIFY row_number() OVER (PARTITION BY region, indicator, category ORDER BY suppressed, pos, v) = 1""")
def survey_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value wins, but a suppressed one yields to a later one that isn't."""
    x = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("region"), F.col("l_returnflag").alias("indicator"), F.col("l_linenumber").alias("category"), F.col("l_quantity").alias("v"), (F.col("l_orderkey") % 4 == 0).alias("hidden"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"))
    return x.groupBy("region", "indicator", "category").agg(F.min_by("v", F.struct("hidden", "pos", "v")).alias("value"))


@query("""WITH a AS (SELECT c_nationkey AS region, CASE WHEN c_custkey % 17 < 3 THEN '0-14' WHEN c_custkey % 17 < 6 THEN '15-29' WHEN c_custkey % 17 < 12 THEN '30-59' ELSE '60+' END AS band, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT region, band, n, round(100.0 * n / sum(n) OVER (PARTITION BY region), 6) AS share FROM a""")
def age_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("region"), band(F.col("c_custkey") % 17, [3, 6, 12], ["0-14", "15-29", "30-59", "60+"], "").alias("band")).agg(F.count("*").alias("n"))
    total = c.groupBy("region").agg(F.sum("n").alias("all"))
    return c.join(total, "region").select("region", "band", "n", F.round(100.0 * F.col("n") / F.col("all"), 6).alias("share"))


@query("""WITH y AS (SELECT c_nationkey AS region, max(c_custkey % 4) AS year FROM customer GROUP BY 1), r AS (SELECT c_nationkey AS region, c_custkey % 4 AS year, count(*) AS n, count(*) FILTER (c_acctbal < -950) AS bad, count(DISTINCT c_mktsegment) AS kinds, count(*) FILTER (c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')) AS wrong FROM customer GROUP BY 1, 2)
SELECT region, year, n FROM r JOIN y USING (region, year) WHERE bad = 0 AND kinds = 5 AND wrong = 0""")
def complete_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest year of each region, only if it holds exactly the declared kinds and no bad row."""
    declared = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    r = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("region"), (F.col("c_custkey") % 4).alias("year")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < -950).alias("bad"), F.array_sort(F.collect_set("c_mktsegment")).alias("kinds"))
    latest = r.groupBy("region").agg(F.max("year").alias("year"))
    return r.join(latest, ["region", "year"]).filter((F.col("bad") == 0) & (F.col("kinds") == F.array(*map(F.lit, declared)))).select("region", "year", "n")


@query("""SELECT c_mktsegment, round(avg(v) FILTER (c_nationkey % 5 = 0), 4) AS r0, round(avg(v) FILTER (c_nationkey % 5 = 1), 4) AS r1, round(avg(v) FILTER (c_nationkey % 5 = 2), 4) AS r2
  FROM (SELECT c_mktsegment, c_nationkey, round(sum(c_acctbal), 2) AS v FROM customer GROUP BY 1, 2) GROUP BY 1""")
def comparison_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("v"))
    out = v.withColumn("r", F.concat(F.lit("r"), F.col("c_nationkey") % 5)).groupBy("c_mktsegment").pivot("r", ["r0", "r1", "r2"]).agg(F.round(F.avg("v"), 4))
    return out


@query("""SELECT c_nationkey, c_mktsegment, round(stddev_pop(c_acctbal) / avg(c_acctbal), 4) AS cv FROM customer GROUP BY 1, 2 HAVING round(stddev_pop(c_acctbal) / avg(c_acctbal), 4) > 0.7""")
def variation_caution(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = F.try_divide(F.stddev_pop("c_acctbal"), F.avg("c_acctbal"))
    return table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.round(cv, 4).alias("cv")).filter("cv > 0.7")


@query("""WITH v AS (SELECT o_custkey AS city, year(o_orderdate)::INT AS year, o_orderpriority AS source, round(sum(o_totalprice), 2) AS nominal FROM orders GROUP BY 1, 2, 3)
SELECT city, year, arg_min(nominal, source) AS nominal, round(arg_min(nominal, source) / pow(1.05, year - 1995), 4) AS real FROM v GROUP BY 1, 2""")
def preferred_source_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value a city and year from the first of the preferred sources, nominal and deflated."""
    o = table(spark, sf_dir, "orders")
    v = o.groupBy(F.col("o_custkey").alias("city"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("source")).agg(F.round(F.sum("o_totalprice"), 2).alias("nominal"))
    one = v.groupBy("city", "year").agg(F.min_by("nominal", "source").alias("nominal"))
    return one.withColumn("real", F.round(F.col("nominal") / F.pow(F.lit(1.05), F.col("year") - 1995), 4))
