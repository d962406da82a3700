"""Filters and what they leave out, panels and option lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators import filters as L
from cadastra.plans import traffic
from cadastra.registry import query, table


@query("""SELECT p_partkey FROM part WHERE p_size % 3 <> 1 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#11', 'Brand#12')""")
def active_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("p_size") % 3 == 0, " ").when(F.col("p_size") % 3 == 1, "retired").otherwise("Active")
    p = table(spark, sf_dir, "part").withColumn("version_status", status)
    return L.active_versions(p, "version_status", {"p_brand": ["Brand#1", "Brand#2", "Brand#3", "Brand#11", "Brand#12"], "p_type": []}).select("p_partkey")


@query(f"""WITH {traffic._E}, d AS (SELECT segment, direction, day, round(sum(value), 2) AS flow, round(sum(value) FILTER (event_type = 'click'), 2) AS click FROM e GROUP BY 1, 2, 3), w AS (SELECT min(day) AS a FROM d)
SELECT segment, day, click AS flow, CAST(NULL AS DOUBLE) AS peak FROM d, w WHERE direction = 'north' AND day >= a + 2 AND day <= a + 20""")
def traffic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One class over a range of days and one direction: peaks are of all vehicles only."""
    r = traffic.records(spark, sf_dir).groupBy("segment", "direction", F.to_date("ts").alias("day"), "event_type").agg(F.sum("value").alias("value"))
    days = r.groupBy("segment", "direction", "day").agg(F.round(F.sum("value"), 2).alias("flow"), F.map_from_entries(F.collect_list(F.struct("event_type", F.round("value", 2)))).alias("classes"), F.max("value").alias("peak"), F.lit(0.0).alias("divergence"))
    first = table(spark, sf_dir, "events").agg(F.to_date(F.min("ts"))).first()[0]
    if first is None:
        return days.select("segment", "day", "flow", "peak")
    day = lambda n: str(first.fromordinal(first.toordinal() + n))
    return L.traffic_filter(days, start=day(2), end=day(20), vehicle="click", direction="north").select("segment", "day", "flow", "peak")


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS pct, l_returnflag, -48 + (l_suppkey % 40) * 0.05 AS lon FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN round(lon, 6) NOT BETWEEN -47.9 AND -46.5 THEN 'outside' WHEN NOT (pct >= 50 OR l_returnflag = 'A') THEN 'rank' END AS reason FROM e""")
def published_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    coords = F.array(point(F.lit(-47.0), F.lit(-15.8)), point(F.round(-48 + (F.col("l_suppkey") % 40) * 0.05, 6), F.lit(-15.7)))
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("percentile"), F.col("l_returnflag").alias("highway"), coords.alias("coords"))
    return L.published_roads(e, 50, ["A"], (-47.8, -16.0, -46.6, -15.5), 0.1).select("l_orderkey", "l_linenumber", "reason")


@query("""WITH c AS (SELECT c_custkey, c_nationkey, (c_custkey % 100) * 0.02 - 1 AS lon, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 5 END AS pop, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 2 END AS dom FROM customer),
i AS (SELECT *, round(lon, 6) BETWEEN -0.5 AND 0.5 AS inside, greatest(pop, coalesce(dom, 0)) > 0 AS lived FROM c)
SELECT c_nationkey, count(*) FILTER (NOT inside) AS outside, count(*) FILTER (inside) AS children, count(*) FILTER (inside AND lived) AS shown, CAST(sum(pop) FILTER (inside) AS BIGINT) AS pop FROM i GROUP BY 1""")
def cells_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty cells aren't shown but count as children of their parent."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.round((k % 100) * 0.02 - 1, 6).alias("lon"), F.lit(0.0).alias("lat"), F.when(k % 3 == 0, 0).otherwise(k % 5).alias("pop"), F.when(k % 7 != 0, k % 2).alias("dom"))
    x = L.cells_in_box(c, (-0.5, -1.0, 0.5, 1.0), ["pop", "dom"])
    return x.groupBy("c_nationkey").agg(F.count_if(~F.col("inside")).alias("outside"), F.count_if("inside").alias("children"), F.count_if("detail").alias("shown"), F.sum(F.when(F.col("inside"), F.col("pop"))).alias("pop"))


@query("""SELECT t.s_suppkey AS target, o.s_suppkey FROM supplier t JOIN supplier o ON t.s_nationkey = o.s_nationkey AND t.s_suppkey <> o.s_suppkey WHERE t.s_acctbal < 0""")
def comparable_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of the nation of each one in debt."""
    s = table(spark, sf_dir, "supplier")
    return L.comparables(s, "s_suppkey", "s_nationkey", s.filter("s_acctbal < 0"))


@query("""SELECT o_orderkey FROM orders WHERE o_custkey % 25 = 4 AND year(o_orderdate) = 1996 AND o_orderpriority IN ('1-URGENT', '5-LOW')""")
def keyed_drill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderdate >= '1996-01-01' and o_orderdate < '1997-01-01'").select("o_orderkey", (F.col("o_custkey") % 25).alias("region"), "o_orderpriority")
    return L.drill_down(o, ["1-URGENT", "5-LOW"], "o_orderpriority", region=4).select("o_orderkey")


@query("""WITH c AS (SELECT c_nationkey, CASE WHEN c_custkey % 11 = 0 THEN CAST(c_custkey AS VARCHAR) WHEN c_custkey % 11 = 1 THEN ' Total' ELSE c_mktsegment END AS category, c_acctbal AS v FROM customer)
SELECT c_nationkey, count(*) FILTER (regexp_full_match(trim(category), '[0-9]+')) AS dropped, count(*) FILTER (lower(trim(category)) = 'total') AS totals, round(sum(v) FILTER (NOT regexp_full_match(trim(category), '[0-9]+') AND lower(trim(category)) <> 'total'), 2) AS total FROM c GROUP BY 1""")
def invalid_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.when(k % 11 == 0, k.cast("string")).when(k % 11 == 1, " Total").otherwise(F.col("c_mktsegment")).alias("category"), F.col("c_acctbal").alias("v"))
    x = L.categories(c, "category")
    return x.groupBy("c_nationkey").agg(F.count_if("invalid").alias("dropped"), F.count_if("is_total").alias("totals"), F.round(F.sum(F.when(~F.col("invalid") & ~F.col("is_total"), F.col("v"))), 2).alias("total"))


@query("""SELECT p_partkey FROM part WHERE NOT p_brand LIKE '%1' OR p_size % 2 = 0""")
def yes_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that end in 1 are questions of multiple choice; even sizes are answers of yes."""
    p = table(spark, sf_dir, "part").withColumn("answer", F.when(F.col("p_size") % 4 == 0, F.concat("p_type", F.lit(" · Sim"))).when(F.col("p_size") % 2 == 0, "Sim").otherwise(F.concat("p_type", F.lit(" · Não"))))
    return L.yes_cards(p, "p_brand", "answer", p.filter(F.col("p_brand").endswith("1")).select("p_brand")).select("p_partkey")


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE o_orderstatus = 'O') WHERE month BETWEEN '1995-03' AND '1996-11' ORDER BY month, o_orderkey LIMIT 150""")
def api_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 150 rows by status and months (the limit is the request's)."""
    o = table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return L.api_filter(o, "month", "1995-03", "1996-11", 150, ["month", "o_orderkey"], o_orderstatus="O", o_orderpriority=None).select("o_orderkey")


@query("""WITH x AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_custkey % 4 AS area, o_orderstatus AS segment, round(max(o_totalprice), 2) AS v, count(*) AS n FROM orders GROUP BY 1, 2, 3)
SELECT month, CASE WHEN n % 2 = 0 THEN v WHEN n % 3 <> 0 THEN round(v * 2, 2) END AS value, CASE WHEN n % 2 = 0 THEN 'official' WHEN n % 3 <> 0 THEN 'calculated' END AS source FROM x WHERE area = 0 AND segment = 'O'""")
def index_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("m"), (F.col("o_custkey") % 4).cast("string").alias("area"), F.col("o_orderstatus").alias("segment")).agg(F.round(F.max("o_totalprice"), 2).alias("v"), F.count("*").alias("n"))
    x = x.withColumn("official", F.when(F.col("n") % 2 == 0, F.col("v"))).withColumn("calculated", F.when(F.col("n") % 3 != 0, F.round(F.col("v") * 2, 2)))
    return L.index_series(x, "0", "m", "official", "calculated", segment="O")


@query("""WITH v AS (SELECT DISTINCT 'p_brand' AS list, trim(p_brand) AS value FROM part UNION ALL SELECT DISTINCT 'p_type', trim(p_type) FROM part UNION ALL SELECT DISTINCT 'size', CAST(p_size AS VARCHAR) FROM part WHERE p_size > 20)
SELECT list, value, CAST(row_number() OVER (PARTITION BY list ORDER BY value) AS INTEGER) AS place FROM v WHERE value <> ''""")
def distinct_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("size", F.when(F.col("p_size") > 20, F.col("p_size")))
    return L.options(p, ["p_brand", "p_type", "size"])


@query("""WITH s AS (SELECT *, p_partkey % 5 <> 0 AS placed, CASE WHEN p_size % 6 > 0 THEN p_retailprice / (p_size % 6) END AS per_area FROM part WHERE p_size >= 5)
SELECT count(*) AS visible, count(*) FILTER (placed) AS mappable, count(*) FILTER (placed AND p_size % 2 = 0) AS approximate, round(median(per_area), 4) AS median, (SELECT string_agg(b || ':' || n, ',' ORDER BY b) FROM (SELECT p_brand AS b, count(*) AS n FROM s GROUP BY 1)) AS by_kind FROM s""")
def visible_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.when(F.col("p_partkey") % 5 != 0, 1.0)
    p = table(spark, sf_dir, "part").select("p_brand", "p_size", k.alias("lat"), k.alias("lon"), (F.col("p_size") % 2 == 0).alias("approximate"), F.try_divide("p_retailprice", F.col("p_size") % 6).alias("price_per_area"))
    out = L.visible_kpis(p, F.col("p_size") >= 5, "p_brand")
    listed = F.array_join(F.transform(F.map_entries("by_kind"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return out.select("visible", "mappable", "approximate", F.round("median", 4).alias("median"), listed.alias("by_kind"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("metric"), F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("cell"), F.col("o_totalprice").alias("value"), "o_orderkey")


@query("""WITH m AS (SELECT o_custkey AS cell, c_nationkey AS region, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '2-HIGH' AND year(o_orderdate) = 1997 GROUP BY 1, 2)
SELECT *, (SELECT count(*) FROM m) > 40 AS truncated FROM m ORDER BY cell LIMIT 40""")
def metric_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 cells at most of a metric and year (the limit is the request's), and whether more were left out."""
    m = _metrics(spark, sf_dir).groupBy("metric", "year", "cell").agg(F.round(F.sum("value"), 2).alias("value"))
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_nationkey").alias("region"))
    return L.metric_cells(m, cells, "2-HIGH", 1997, 40).select("cell", "region", "value", "truncated")


@query("""SELECT o_orderstatus AS dataset, o_orderpriority AS metric, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS rows FROM orders GROUP BY 1, 2, 3""")
def metric_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.metric_catalogue(_metrics(spark, sf_dir))
