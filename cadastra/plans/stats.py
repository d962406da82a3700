"""Statistics over part, lineitem and customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions.scalar import class_index, ratio
from cadastra.operators import stats as S
from cadastra.operators.selection import with_percentiles
from cadastra.registry import query, table

M2 = "CASE WHEN p_partkey % 8 <> 0 THEN round(p_retailprice / p_size, 4) END"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("m2", F.expr(M2))


@query(f"""SELECT p_brand, count(*) AS n, count({M2}) AS n_value, count(*) FILTER (p_size > 10) AS n_active, count(*) FILTER (p_size <= 45 AND p_size >= 0) AS n_recent, min({M2}) AS least,
  round(quantile_cont({M2}, 0.25), 6) AS p25, round(quantile_cont({M2}, 0.5), 6) AS median, round(quantile_cont({M2}, 0.75), 6) AS p75, max({M2}) AS most FROM part GROUP BY 1""")
def comparable_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    today = F.lit("2024-06-30").cast("date")
    out = S.comparables(_parts(spark, sf_dir), ["p_brand"], "m2", F.col("p_size") > 10, F.date_sub(today, F.col("p_size") * 2), today)
    return out.withColumns({c: F.round(c, 6) for c in ("p25", "median", "p75")})


@query("""WITH g AS (SELECT p_partkey % 300 AS grp, p_retailprice AS v FROM part)
SELECT grp, count(v) AS n, CASE WHEN count(v) >= 5 THEN round(quantile_cont(v, 0.5), 6) END AS median, CASE WHEN count(v) >= 10 THEN round(quantile_cont(v, 0.25), 6) END AS p25,
  CASE WHEN count(v) >= 10 THEN round(quantile_cont(v, 0.75), 6) END AS p75, CASE WHEN count(v) < 5 THEN 'few_for_median' WHEN count(v) < 10 THEN 'few_for_quartiles' END AS reason FROM g GROUP BY 1""")
def suppressed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 300).alias("grp"), F.col("p_retailprice").alias("v"))
    return S.suppressed(p, ["grp"], "v").withColumns({c: F.round(c, 6) for c in ("median", "p25", "p75")})


@query("""SELECT p_partkey, CASE WHEN v IS NULL THEN NULL ELSE round(100.0 * (rank() OVER (ORDER BY v) - 1 + (count(*) OVER (PARTITION BY v) - 1) / 2.0) / (count(v) OVER () - 1), 6) END AS rank_pct
  FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN p_size END AS v FROM part)""")
def midrank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.col("p_size")).alias("v"))
    return S.midrank(p, "v").select("p_partkey", F.round("rank_pct", 6).alias("rank_pct"))


@query("""WITH s AS (SELECT p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice) - 1 AS i, count(*) OVER () AS n FROM part),
b AS (SELECT list(v ORDER BY i) AS bs FROM s WHERE i IN (1 * n // 5, 2 * n // 5, 3 * n // 5, 4 * n // 5))
SELECT p_partkey, CAST(len(list_filter(bs, lambda x: p_retailprice >= x)) AS INTEGER) AS class FROM part, b""")
def class_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", class_index(F.col("p_retailprice"), S.quantile_breaks(p, "p_retailprice", 5)).alias("class"))


@query("""WITH m AS (SELECT p_brand, round(quantile_cont(p_retailprice, 0.25), 6) AS p25, quantile_cont(p_retailprice, 0.5) AS median, round(quantile_cont(p_retailprice, 0.75), 6) AS p75, count(*) AS n FROM part GROUP BY 1)
SELECT p_partkey, round(p_retailprice / median - 1, 6) AS position, n, round(greatest(0, least(1, (p_retailprice - p25) / (p75 - p25))), 6) AS ruler FROM part JOIN m USING (p_brand)""")
def rank_vs_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    m = with_percentiles(p.groupBy("p_brand").agg(F.count("*").alias("n")), p, ["p_brand"], F.col("p_retailprice"), (0.25, 0.5, 0.75), ("p25", "median", "p75"))
    v = F.col("p_retailprice")
    return p.join(m, "p_brand").select("p_partkey", F.round(ratio(v, F.col("median")) - 1, 6).alias("position"), "n", F.round(S.ruler(v, F.round("p25", 6), F.round("p75", 6)), 6).alias("ruler"))


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, round(avg(c_acctbal), 2) AS v FROM customer GROUP BY 1, 2)
SELECT c_nationkey, c_mktsegment, v, rank() OVER w AS place, count(*) OVER (PARTITION BY c_mktsegment) AS of_n, round(v - quantile_cont(v, 0.5) OVER (PARTITION BY c_mktsegment), 6) AS gap FROM c WINDOW w AS (PARTITION BY c_mktsegment ORDER BY v DESC)""")
def region_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.round(F.avg("c_acctbal"), 2).alias("v"))
    out = S.ranked(c, "v", "c_mktsegment")
    return out.select("c_nationkey", "c_mktsegment", "v", F.col("place").cast("long").alias("place"), F.col("of").alias("of_n"), F.round("gap", 6).alias("gap"))


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS v FROM customer GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY v DESC, c_mktsegment) AS i FROM c)
SELECT c_nationkey, max(c_mktsegment) FILTER (i = 1) AS leader, max(c_mktsegment) FILTER (i = 2) AS runner_up, max(v) FILTER (i = 1) - max(v) FILTER (i = 2) AS gap FROM r WHERE i <= 2 GROUP BY 1""")
def top2_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("v"))
    return S.top_two(c, "v", "c_mktsegment", "c_nationkey")


@query("""SELECT l_returnflag, l_shipmode_no, n, CASE WHEN n >= 3 THEN round(cov / nullif(sx * sy, 0), 5) END AS r FROM (
  SELECT l_returnflag, l_linenumber % 3 AS l_shipmode_no, count(*) FILTER (l_orderkey % 4 <> 0) AS n, covar_pop(l_quantity, l_extendedprice) FILTER (l_orderkey % 4 <> 0) AS cov,
    stddev_pop(l_quantity) FILTER (l_orderkey % 4 <> 0) AS sx, stddev_pop(l_extendedprice) FILTER (l_orderkey % 4 <> 0) AS sy FROM lineitem GROUP BY 1, 2)""")
def scatter_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_quantity"), F.when(F.col("l_orderkey") % 4 != 0, F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", (F.col("l_linenumber") % 3).alias("l_shipmode_no")).agg(F.count(y).alias("n"), F.round(S.correlation(x, y), 5).alias("r"))


@query("""WITH s AS (SELECT c_nationkey, c_mktsegment, 110.0 * count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey) AS share FROM customer GROUP BY 1, 2)
SELECT c_nationkey, c_mktsegment, round(least(100.0, sum(share) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment ROWS UNBOUNDED PRECEDING)), 6) AS cumulative FROM s""")
def cumulative_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    total = c.groupBy("c_nationkey").agg(F.sum("n").alias("all"))
    s = c.join(total, "c_nationkey").withColumn("share", 110.0 * F.col("n") / F.col("all"))
    return S.cumulative_share(s, "share", "c_mktsegment", "c_nationkey").select("c_nationkey", "c_mktsegment", F.round("cumulative", 6).alias("cumulative"))


@query("""SELECT l_orderkey, CAST(count(*) AS BIGINT) AS lines, CASE WHEN count(*) = count(v) THEN sum(v) END AS strict, sum(v) AS lenient, count(*) - count(v) AS missing
  FROM (SELECT l_orderkey, CASE WHEN l_partkey % 10 <> 0 THEN l_quantity END AS v FROM lineitem) GROUP BY 1""")
def strict_sum_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("l_partkey") % 10 != 0, F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), S.strict_sum(v).alias("strict"), F.sum(v).alias("lenient"), (F.count("*") - F.count(v)).alias("missing"))


@query("""WITH g AS (SELECT CASE WHEN l_orderkey % 10 <> 0 THEN 0 WHEN l_orderkey % 20 = 0 THEN NULL ELSE 1 + l_suppkey % 7 END AS grp, CASE WHEN l_linenumber < 7 THEN l_extendedprice END AS v FROM lineitem)
SELECT grp, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90 FROM g GROUP BY 1""")
def skewed_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles where one group holds nine tenths of all rows, another has no key."""
    k = F.col("l_orderkey")
    grp = F.when(k % 10 != 0, 0).when(k % 20 == 0, None).otherwise(1 + F.col("l_suppkey") % 7)
    rows = table(spark, sf_dir, "lineitem").select(grp.alias("grp"), F.when(F.col("l_linenumber") < 7, F.col("l_extendedprice")).alias("v"))
    found = with_percentiles(rows.groupBy("grp").agg(F.count("*").alias("n")), rows, ["grp"], F.col("v"), (0.1, 0.5, 0.9), ("p10", "median", "p90"), rows=5_000)
    return found.select(F.col("grp").cast("long").alias("grp"), *(F.round(c, 6).alias(c) for c in ("p10", "median", "p90")))


@query("""SELECT p_partkey, CAST(rank() OVER (ORDER BY p_retailprice DESC) AS INTEGER) AS place, count(*) OVER () AS of_n, round(p_retailprice - quantile_cont(p_retailprice, 0.5) OVER (), 6) AS gap FROM part""")
def global_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every part among all of them, in ranges of the price."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("v"))
    return S.ranked(p, "v").select("p_partkey", "place", F.col("of").alias("of_n"), F.round("gap", 6).alias("gap"))
