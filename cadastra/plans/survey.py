"""Survey shares, fallbacks, aliases, sanitation, runs and panels over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastra.operators import survey as S
from cadastra.operators.selection import with_percentiles
from cadastra.registry import query, table


@query("""WITH n AS (SELECT c_nationkey, c_mktsegment, c_custkey % 3 AS dest, count(*) AS n FROM customer GROUP BY 1, 2, 3)
SELECT c_nationkey, c_mktsegment, dest, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY c_nationkey, c_mktsegment), 6) AS share,
  round(sum(n) OVER (PARTITION BY c_nationkey, c_mktsegment) / sum(n) OVER (PARTITION BY c_nationkey), 6) AS group_share FROM n""")
def nested_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", (F.col("c_custkey") % 3).alias("dest"), F.lit(1).alias("w"))
    return S.group_shares(c, "c_mktsegment", "dest", "w", "c_nationkey").withColumns({x: F.round(x, 6) for x in ("share", "group_share")})


@query("""WITH r AS (SELECT year(o_orderdate)::INT AS year, o_custkey % 10 AS region, CASE WHEN o_custkey % 10 <> 4 THEN round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 4) END AS pct, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT year, round(avg(pct), 4) AS mean, CAST(sum(n) AS BIGINT) AS total, count(pct) AS regions FROM r GROUP BY 1""")
def multi_region_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    r = o.groupBy(F.year("o_orderdate").alias("year"), (F.col("o_custkey") % 10).alias("region")).agg(F.round(100.0 * F.count_if(F.col("o_orderstatus") == "F") / F.count("*"), 4).alias("pct"), F.count("*").alias("n"))
    r = r.withColumn("pct", F.when(F.col("region") != 4, F.col("pct")))
    return S.region_series(r, "year", "pct", "n").withColumn("mean", F.round("mean", 4))


@query("""WITH n AS (SELECT s_nationkey, round(sum(s_acctbal), 2) AS x FROM supplier GROUP BY 1), c AS (SELECT c_nationkey, round(sum(c_acctbal), 2) AS y FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1)
SELECT n_name, x, y, round((y - x) / nullif(x, 0), 6) AS gap, x IS NULL OR y IS NULL AS missing FROM nation LEFT JOIN n ON s_nationkey = n_nationkey LEFT JOIN c ON c_nationkey = n_nationkey""")
def two_axis_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.round(F.sum("s_acctbal"), 2).alias("a"))
    c = table(spark, sf_dir, "customer").filter("c_nationkey % 3 <> 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.round(F.sum("c_acctbal"), 2).alias("b"))
    rows = table(spark, sf_dir, "nation").join(n, "n_nationkey", "left").join(c, "n_nationkey", "left")
    return S.scatter(rows, "n_name", F.col("a"), F.col("b")).withColumn("gap", F.round("gap", 6))


@query("""SELECT c_mktsegment, least(min(c_acctbal), 0) AS least, greatest(max(c_acctbal), 0) AS most FROM customer GROUP BY 1""")
def axis_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.axis_ranges(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'a' || c_custkey WHEN c_custkey % 3 = 1 THEN 'b' || c_custkey END AS shape, CASE WHEN c_custkey % 3 = 0 THEN 'first' WHEN c_custkey % 3 = 1 THEN 'second' ELSE 'none' END AS origin FROM customer""")
def geometry_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    first = c.filter("c_custkey % 3 = 0").withColumn("shape", F.concat(F.lit("a"), "c_custkey"))
    second = c.filter("c_custkey % 3 <= 1").withColumn("shape", F.concat(F.lit("b"), "c_custkey"))
    return S.with_fallback(c, "c_custkey", first, second, "shape")


@query("""SELECT p_partkey, count(*) OVER (PARTITION BY p_name) > 1 AS ambiguous FROM part""")
def ambiguous_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ambiguous_names(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name").select("p_partkey", "ambiguous")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size * 1.0 WHEN 1 THEN p_size / 100.0 END AS rate FROM part""")
def alias_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical column where it isn't blank, else an old one in percentage points."""
    k, size = F.col("p_partkey") % 3, F.col("p_size")
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, size.cast("string")).otherwise(" ").alias("rate"), F.when(k == 1, F.format_string("%d,0", size)).alias("rate_pct"))
    return S.resolve_aliases(p, {"rate": ["rate_pct/100"]}).select("p_partkey", F.col("rate").try_cast("double").alias("rate"))


@query("""SELECT p_partkey, 'price' AS field, CAST(p_size * 1000.0 AS DOUBLE) AS after FROM part WHERE p_partkey % 4 <> 0""")
def sanitation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money texts become numbers, each with a row in the log; what can't be read stays."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 4 == 0, "a combinar").otherwise(F.concat(F.lit("R$ "), F.col("p_size"), F.lit(".000,00"))).alias("price"))
    _, log = S.sanitised(p, "p_partkey", ["price"])
    return log.select("p_partkey", "field", F.col("after").try_cast("double").alias("after"))


@query("""WITH r AS (SELECT CAST(ts AS DATE) AS day, user_id % 4 AS portal, count(*) AS checks, count(*) FILTER (event_type IN ('click', 'purchase')) AS read, count(*) FILTER (event_type = 'error' AND user_id % 4 = 1) AS errors FROM events WHERE NOT (user_id % 4 = 2 AND event_type IN ('click', 'purchase')) GROUP BY 1, 2)
SELECT day, portal, checks, read, errors, CASE WHEN read = 0 THEN 'failed' WHEN errors > 0 THEN 'partial' ELSE 'success' END AS status FROM r""")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("not (user_id % 4 = 2 and event_type in ('click', 'purchase'))")
    outcome = F.when(F.col("event_type").isin("click", "purchase"), "ok").when((F.col("event_type") == "error") & (F.col("user_id") % 4 == 1), "error").otherwise("blocked")
    rows = e.select(F.struct(F.to_date("ts").alias("day"), (F.col("user_id") % 4).alias("portal")).alias("run"), outcome.alias("outcome"))
    return S.run_status(rows, "run", "outcome").select("run.day", "run.portal", "checks", "read", "errors", "status")


@query("""SELECT c_custkey, 'balance' AS variable, c_acctbal AS value, 'crm' AS source FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS DOUBLE), 'crm' FROM customer WHERE c_nationkey <> 0""")
def long_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.nullif("c_nationkey", F.lit(0)).alias("nation"))
    return S.long_panel(c, ["c_custkey"], ["balance", "nation"], "crm")


@query("""WITH l AS (SELECT c_nationkey AS loc, c_mktsegment AS kind, c_acctbal AS v, c_custkey % 5 = 0 AS centroid, c_custkey % 100 / 10.0 AS lat FROM customer)
SELECT loc, kind, count(*) AS n, round(quantile_cont(v, 0.5), 4) AS median, round(coalesce(quantile_cont(CASE WHEN centroid THEN lat END, 0.5), quantile_cont(lat, 0.5)), 4) AS lat FROM l GROUP BY 1, 2""")
def locality_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median value by locality and type, and a median point that prefers centroids."""
    k = F.col("c_custkey")
    lat = k % 100 / 10.0
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("loc"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("v"), lat.alias("lat"), F.when(k % 5 == 0, lat).alias("centroid"))
    keys, out = ["loc", "kind"], c.groupBy("loc", "kind").agg(F.count("*").alias("n"))
    for name in ("v", "lat", "centroid"):
        out = with_percentiles(out, c, keys, F.col(name), (0.5,), (f"mid_{name}",))
    return out.select(*keys, "n", F.round("mid_v", 4).alias("median"), F.round(F.coalesce("mid_centroid", "mid_lat"), 4).alias("lat"))


@query("""SELECT c_nationkey % 5 AS grp, c_mktsegment AS type, count(*) AS n, min(c_custkey) AS sample, min(c_acctbal) AS least, max(c_acctbal) AS most FROM customer GROUP BY 1, 2""")
def legend_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") % 5).alias("grp"), F.col("c_mktsegment").alias("type")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("sample"), F.min("c_acctbal").alias("least"), F.max("c_acctbal").alias("most"))


@query("""WITH v AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 0)
SELECT CAST(c_nationkey AS VARCHAR) AS place, count(*) AS n FROM v WHERE (SELECT count(*) FROM v) > 500 GROUP BY 1 UNION ALL SELECT 'point ' || c_custkey, 1 FROM v WHERE (SELECT count(*) FROM v) <= 500""")
def counts_above_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points up to a number of 500, beyond it a count a locality."""
    v = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    if v.count() > 500:
        return v.groupBy(F.col("c_nationkey").cast("string").alias("place")).agg(F.count("*").alias("n"))
    return v.select(F.concat(F.lit("point "), "c_custkey").alias("place"), F.lit(1).cast("long").alias("n"))


@query("""SELECT c_nationkey, c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) <= 3""")
def trailing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three rows of each nation."""
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_custkey"))
    return table(spark, sf_dir, "customer").withColumn("i", F.row_number().over(w)).filter("i <= 3").select("c_nationkey", "c_custkey", "c_acctbal")
