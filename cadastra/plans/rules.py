"""Rule sets of the datasets over the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators import rules as R
from cadastra.registry import query, spread, table

_SHARES = [f"s{i}" for i in range(5)]


@query("""WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS income, list_transform(range(5), lambda i: CAST((c_custkey * (i + 3)) % 41 AS DOUBLE)) AS s FROM customer),
b AS (SELECT id, income, s, list_sum(s) AS total FROM p)
SELECT id, 'invalid_income' AS code, 'error' AS severity FROM b WHERE income < 0
UNION ALL SELECT id, 'invalid_percentage:s4', 'error' FROM b WHERE s[5] > 100 OR s[5] < 0
UNION ALL SELECT id, 'share_sum', 'warning' FROM b WHERE abs(total - 100) > 2 AND abs(total - 1) > 0.02""")
def profile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    p = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")).select(k.alias("id"), F.when(k % 11 != 0, F.col("c_acctbal").cast("string")).alias("income"), *(((k * (i + 3)) % 41).cast("string").alias(f"s{i}") for i in range(5)))
    return R.profile_findings(p, "id", "income", _SHARES)


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of a monthly price index, with what can be wrong in one."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    local = c % 3 != 0
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), k.alias("line"), F.when(k % 97 == 0, "?").otherwise(F.date_format(F.add_months("o_orderdate", 276), "yyyy-MM")).alias("month"),
        F.when(F.col("o_orderstatus") == "F", "COMERCIAL").when(k % 89 == 0, "RURAL").otherwise("RESIDENCIAL").alias("segment"), F.when(F.col("o_orderpriority") < "3", "VENDA").otherwise("LOCACAO").alias("deal"),
        F.when(local, "LOCALIDADE").otherwise("DF_TOTAL").alias("area"), F.when(local, F.concat(F.lit("L"), c % 40)).alias("locality"), F.when(k % 83 == 0, -1.0).otherwise(F.col("o_totalprice")).alias("price"),
        F.concat(F.lit("S"), k % 23).alias("source"), F.when(k % 2 == 0, F.concat(F.lit("N"), k % 19)).alias("note"), F.when(local, F.concat(F.lit("R"), c % 37)).alias("region"),
    )


def _ids(spark: SparkSession, letter: str, n: int) -> DataFrame:
    return spark.range(n).select(F.concat(F.lit(letter), "id").alias("id"))


@query("""WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 97 <> 0 THEN strftime(o_orderdate + INTERVAL 276 MONTH, '%Y-%m') END AS month,
  CASE WHEN o_orderstatus = 'F' THEN 'COMERCIAL' WHEN o_orderkey % 89 = 0 THEN 'RURAL' ELSE 'RESIDENCIAL' END AS segment, CASE WHEN o_orderpriority < '3' THEN 'VENDA' ELSE 'LOCACAO' END AS deal,
  o_custkey % 3 <> 0 AS local, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 40 END AS locality, CASE WHEN o_orderkey % 83 = 0 THEN -1 ELSE o_totalprice END AS price, o_custkey FROM orders),
m AS (SELECT DISTINCT month FROM x WHERE month IS NOT NULL AND NOT local AND segment = 'RESIDENCIAL' AND deal = 'VENDA'),
d AS (SELECT id, row_number() OVER (PARTITION BY month, segment, deal, local, locality ORDER BY id) AS i FROM x WHERE month IS NOT NULL)
SELECT CAST(id AS VARCHAR) AS id, 'invalid_month' AS code, 'error' AS severity FROM x WHERE month IS NULL
UNION ALL SELECT CAST(id AS VARCHAR), 'invalid_segment', 'error' FROM x WHERE segment = 'RURAL' UNION ALL SELECT CAST(id AS VARCHAR), 'invalid_price', 'error' FROM x WHERE price <= 0
UNION ALL SELECT CAST(id AS VARCHAR), 'early_commercial', 'warning' FROM x WHERE segment = 'COMERCIAL' AND month < '2019-01' UNION ALL SELECT CAST(id AS VARCHAR), 'early_locality', 'warning' FROM x WHERE local AND month < '2019-03'
UNION ALL SELECT CAST(id AS VARCHAR), 'missing_source', 'error' FROM x WHERE id % 23 >= 20 UNION ALL SELECT CAST(id AS VARCHAR), 'missing_note', 'warning' FROM x WHERE id % 2 = 0 AND id % 19 >= 18
UNION ALL SELECT CAST(id AS VARCHAR), 'region_not_mapped', 'error' FROM x WHERE local AND o_custkey % 37 >= 35 UNION ALL SELECT CAST(id AS VARCHAR), 'locality_not_mapped', 'warning' FROM x WHERE local AND locality >= 39
UNION ALL SELECT CAST(id AS VARCHAR), 'repeated_observation', 'error' FROM d WHERE i > 1
UNION ALL SELECT strftime(g, '%Y-%m'), 'month_gap', 'warning' FROM (SELECT unnest(generate_series((SELECT min(month) || '-01' FROM m)::DATE, (SELECT max(month) || '-01' FROM m)::DATE, INTERVAL 1 MONTH)) AS g) WHERE strftime(g, '%Y-%m') NOT IN (SELECT month FROM m)""")
def price_index_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index_rows(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    return R.index_findings(rows, _ids(spark, "S", 20), _ids(spark, "N", 18), _ids(spark, "R", 35), _ids(spark, "L", 39))


@query("""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE l_suppkey % 19 END AS region, l_linenumber AS b, strftime(l_shipdate, '%Y-%m') AS month, l_quantity AS offered,
  CASE WHEN l_returnflag = 'A' THEN l_discount * 100 ELSE floor(l_quantity * l_discount) END AS sold, round(l_discount * 100, 2) + CASE WHEN l_tax > 0.07 THEN 95 ELSE 0 END AS published, round(l_tax * 100, 2) AS alias FROM lineitem),
d AS (SELECT id, rank() OVER (PARTITION BY month, region, b ORDER BY id) AS i FROM x WHERE region IS NOT NULL)
SELECT id, 'missing_region' AS code, 'error' AS severity FROM x WHERE region IS NULL UNION ALL SELECT id, 'invalid_band', 'error' FROM x WHERE b > 5
UNION ALL SELECT id, 'invalid_sold', 'error' FROM x WHERE round(sold, 6) <> floor(round(sold, 6)) UNION ALL SELECT id, 'scale', 'error' FROM x WHERE published > 100
UNION ALL SELECT id, 'alias_mismatch', 'warning' FROM x WHERE abs(published - alias) > 0.05 UNION ALL SELECT id, 'rate_mismatch', 'warning' FROM x WHERE offered > 0 AND abs(100 * round(sold, 6) / offered - published) > 0.05
UNION ALL SELECT id, 'repeated', 'error' FROM d WHERE i > 1""")
def regional_rate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.element_at(F.array(*map(F.lit, (*R.BANDS, "5Q", "6Q"))), F.col("l_linenumber").cast("int"))
    sold = F.when(F.col("l_returnflag") == "A", F.round(F.col("l_discount") * 100, 6)).otherwise(F.floor(F.round(F.col("l_quantity") * F.col("l_discount"), 9)).cast("double"))
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.date_format("l_shipdate", "yyyy-MM").alias("month"),
        F.when(F.col("l_suppkey") % 17 != 0, (F.col("l_suppkey") % 19).cast("string")).alias("region"), band.alias("band"), F.col("l_quantity").alias("offered"), sold.alias("sold"),
        (F.round(F.col("l_discount") * 100, 2) + F.when(F.col("l_tax") > 0.07, 95).otherwise(0)).alias("published"), F.round(F.col("l_tax") * 100, 2).alias("alias"),
    )
    return R.rate_findings(rows)


@query("""WITH l AS (SELECT CASE WHEN o_custkey % 13 = 0 THEN '(none)' ELSE 'portal' || (o_custkey % 5) END AS portal, o_orderstatus, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') > 30 AS stale, o_orderkey, o_orderdate FROM orders)
SELECT portal AS ident, 'stale' AS code, count(*) AS n FROM l WHERE o_orderstatus <> 'F' AND (stale OR o_orderkey % 29 = 0) GROUP BY 1 UNION ALL SELECT portal, 'blocked', count(*) FROM l WHERE o_orderstatus <> 'F' AND o_orderkey % 7 = 0 GROUP BY 1
UNION ALL SELECT strftime(o_orderdate, '%Y-%m'), 'history_unverified', count(*) FROM l WHERE o_orderstatus <> 'F' AND (o_orderkey % 29 = 0 OR day(o_orderdate) < 8) GROUP BY 1""")
def routine_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(F.col("o_orderstatus") == "F", "inactive").when(k % 2 == 0, "active").otherwise("")
    o = table(spark, sf_dir, "orders")
    listings = o.select(F.when(c % 13 == 0, " ").otherwise(F.concat(F.lit("portal"), c % 5)).alias("portal"), status.alias("status"), F.when(k % 29 != 0, F.to_date("o_orderdate")).alias("seen"), F.when(k % 7 == 0, "blocked").otherwise("ok").alias("check"))
    seen = F.when(k % 29 != 0, F.date_sub(F.to_date("o_orderdate"), F.when(F.dayofmonth("o_orderdate") < 8, 8).otherwise(0)))
    history = o.select(F.when(F.col("o_orderstatus") == "F", "inactive").otherwise("active").alias("status"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), seen.alias("seen"))
    return R.routine_findings(listings, history, F.lit("1998-08-02").cast("date"))


@query("""WITH f AS (SELECT p_partkey, p_partkey - CASE WHEN p_size = 7 THEN 1 ELSE 0 END AS code, p_type, p_brand FROM part WHERE p_size <> 9), n AS (SELECT code, count(*) AS n FROM f GROUP BY 1), t AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45)
SELECT code AS ident, 'wrong_type' AS code, 'error' AS severity FROM f WHERE p_type NOT LIKE '%BRASS' AND p_type LIKE 'E%' UNION ALL SELECT code, 'no_source', 'warning' FROM f WHERE p_brand = 'Brand#1' OR p_brand = 'Brand#11'
UNION ALL SELECT p_partkey, 'absent', 'error' FROM part WHERE p_partkey NOT IN (SELECT code FROM f) UNION ALL SELECT code, 'duplicate', 'error' FROM n WHERE n > 1 UNION ALL SELECT code, 'no_traffic', 'info' FROM n WHERE code NOT IN (SELECT l_partkey FROM t)""")
def layer_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    odd = F.col("p_type").startswith("E") & ~F.col("p_type").endswith("BRASS")
    layer = p.filter("p_size <> 9").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - F.when(F.col("p_size") == 7, 1).otherwise(0)).alias("code"), F.when(odd, "point").otherwise("line").alias("type"), F.when(~F.col("p_brand").isin("Brand#1", "Brand#11"), F.col("p_brand")).alias("source"))
    return R.layer_findings(layer, p.select(F.col("p_partkey").alias("code")), table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("code")), "line")


@query("""WITH c AS (SELECT CASE WHEN p_size % 2 = 0 THEN '200ME' || p_partkey ELSE '1KME' || p_partkey END AS cell, CAST(CASE WHEN p_size % 2 = 0 THEN 0.04 ELSE 1.0 END AS DOUBLE) AS nominal, 1 + (p_retailprice % 20 - 10) / 100 AS f FROM part)
SELECT cell, nominal, round(abs(f - 1), 6) AS apart FROM c WHERE round(abs(f - 1), 6) > 0.05""")
def nominal_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("p_size") % 2 == 0
    factor = 1 + (F.col("p_retailprice") % 20 - 10) / 100
    cells = table(spark, sf_dir, "part").select(F.concat(F.when(even, "200ME").otherwise("1KME"), "p_partkey").alias("cell"), (F.when(even, 0.04).otherwise(1.0) * factor).alias("km2"))
    return R.area_findings(cells, "cell", "km2", 0.0).select("cell", F.round("nominal", 6).alias("nominal"), F.round("apart", 6).alias("apart")).filter("apart > 0.05")


@query("""SELECT p_partkey, p_size % 4 = 0 AND p_size > 0 AS filled, CASE WHEN p_size % 4 = 0 AND p_size > 0 THEN round(p_retailprice / p_size, 4) WHEN p_size % 4 = 0 THEN NULL ELSE round(p_retailprice, 4) END AS per_area FROM part""")
def fill_only_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("per_area", F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice")))
    out = R.fill_blank(p, "per_area", F.when(F.col("p_size") > 0, F.col("p_retailprice") / F.col("p_size")))
    return out.select("p_partkey", "filled", F.round("per_area", 4).alias("per_area"))


def _findings(o: DataFrame) -> DataFrame:
    k: Column = F.col("o_orderkey")
    return o.select(F.concat(F.lit("t"), k % 3).alias("table"), F.col("o_orderpriority").alias("code"), F.when(k % 2 == 0, "error").otherwise("info").alias("severity"), k.alias("ident"), F.col("o_orderdate").alias("created"), F.when(k % 5 == 0, F.col("o_orderdate")).alias("resolved"))


@query("""SELECT o_orderkey AS ident, o_orderpriority AS code FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 ORDER BY o_orderdate DESC, o_orderkey, o_orderpriority LIMIT 200""")
def findings_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 open errors of a table (the limit is the request's)."""
    return R.findings_view(_findings(table(spark, sf_dir, "orders")), 200, open_only=True, table="t1", severity="error").select("ident", "code")


@query("""SELECT 'orders' AS ident, 'column:o_missing' AS code UNION ALL SELECT 'absent', 'absent' UNION ALL SELECT 'nobody', 'empty'""")
def refresh_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return R.refresh_findings({"orders": o, "customer": c, "nobody": c.filter("c_custkey < 0")}, {"orders": ["o_orderkey", "o_missing"], "customer": ["c_custkey"], "nobody": ["c_name"], "absent": ["x"]})


@query("""WITH n AS (SELECT 'nation' AS ident, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier)
SELECT ident, 'row_count' AS code, 'warning' AS severity FROM n WHERE (ident = 'nation' AND n <> 25) OR (ident = 'region' AND n <> 7)""")
def expected_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = None
    for name in ("nation", "region", "supplier"):
        one = table(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("ident"), "n")
        counts = one if counts is None else counts.union(one)
    return R.row_count_findings(counts, {"nation": 25, "region": 7})
