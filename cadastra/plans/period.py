"""Market months from orders and lineitem, and the period engine over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions.scalar import ratio
from cadastra.operators import period as P
from cadastra.operators.period import Metric
from cadastra.registry import query, table

#: Months with number % 7 = 0 (counted from year 0) have no stock; those with % 5 = 0 no quantity.
MONTHS = """m AS (
  SELECT month, sales, value, CASE WHEN n % 5 <> 0 THEN quantity END AS quantity, CASE WHEN n % 7 <> 0 THEN offers END AS offers, parts FROM (
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, max(year(o_orderdate) * 12 + month(o_orderdate)) AS n, count(DISTINCT o_orderkey) AS sales,
      round(sum(l_extendedprice), 2) AS value, sum(l_quantity) AS quantity, count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS offers, count(DISTINCT l_partkey) AS parts
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1))"""
METRICS = [Metric("sales", "flow"), Metric("value", "flow"), Metric("offers", "stock"), Metric("price", "ratio", ("value", "quantity")), Metric("rate", "ratio", ("sales", "offers"), 100.0), Metric("parts", "refused")]


def months(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """A row a month: sales and value (flows), offers (stock), quantity, parts (can't be added)."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("v"), F.sum("l_quantity").alias("q"))
    dated = o.select("o_orderkey", "o_orderstatus", F.trunc("o_orderdate", "month").alias("month"))
    sums = dated.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("month").agg(
        F.count("*").alias("sales"), F.round(F.sum("v"), 2).alias("value"), F.sum("q").alias("quantity"), F.count_if(F.col("o_orderstatus") == "O").alias("offers")
    )
    parts = dated.join(li.select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("month").agg(F.count_distinct("l_partkey").alias("parts"))
    n = F.year("month") * 12 + F.month("month")
    return sums.join(parts, "month").select("month", "sales", "value", F.when(n % 5 != 0, F.col("quantity")).alias("quantity"), F.when(n % 7 != 0, F.col("offers")).alias("offers"), "parts")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


PERIOD_SQL = """
SELECT 'sales' AS metric, CAST(sum(sales) AS DOUBLE) AS value, 'sum' AS origin, count(sales) AS months, count(*) - count(sales) AS missing FROM p UNION ALL
SELECT 'value', round(sum(value), 6), 'sum', count(value), count(*) - count(value) FROM p UNION ALL
SELECT 'offers', round(avg(offers), 6), 'mean', count(offers), count(*) - count(offers) FROM p UNION ALL
SELECT 'price', round(sum(value) FILTER (quantity IS NOT NULL) / sum(quantity), 6), 'ratio_of_sums', count(quantity), count(*) - count(quantity) FROM p UNION ALL
SELECT 'rate', round(100.0 * sum(sales) FILTER (offers IS NOT NULL) / sum(offers), 6), 'ratio_of_sums', count(offers), count(*) - count(offers) FROM p UNION ALL
SELECT 'parts', NULL, 'unsupported', count(parts), count(*) - count(parts) FROM p"""


@query(f"WITH {MONTHS}, p AS (SELECT * FROM m WHERE year(month) = 1997) {PERIOD_SQL}")
def period_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.aggregate(P.window(months(spark, sf_dir), "year", "1997-06-01"), METRICS))


@query(f"WITH {MONTHS}, p AS (SELECT * FROM m WHERE month IN (SELECT month FROM m WHERE month <= '1999-03-01' ORDER BY month DESC LIMIT 12)) {PERIOD_SQL}")
def period_last_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.aggregate(P.window(months(spark, sf_dir), "last12", "1999-03-01"), METRICS))


@query(f"""WITH {MONTHS}, p AS (SELECT *, sales * 10 AS sales_ytd FROM m WHERE month BETWEEN '1998-01-01' AND '1998-05-01')
SELECT 'sales' AS metric, CAST(max_by(sales_ytd, month) AS DOUBLE) AS value, 'published_ytd' AS origin, count(sales) AS months, CAST(0 AS BIGINT) AS missing FROM p""")
def period_ytd(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.window(months(spark, sf_dir), "ytd", "1998-05-01").withColumn("sales_ytd", F.col("sales") * 10)
    return P.aggregate(p, [Metric("sales", "flow", ytd="sales_ytd")])


@query(f"""WITH {MONTHS}, p AS (SELECT * FROM m WHERE month = '1996-02-01')
SELECT 'price' AS metric, 12.5 AS value, 'published' AS origin, count(quantity) AS months, count(*) - count(quantity) AS missing FROM p UNION ALL
SELECT 'parts', CAST(max(parts) AS DOUBLE), 'published', count(parts), CAST(0 AS BIGINT) FROM p""")
def period_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.window(months(spark, sf_dir), "custom", None, "1996-02-01", "1996-02-01").withColumn("price", F.lit(12.5))
    return P.aggregate(p, [Metric("price", "ratio", ("value", "quantity")), Metric("parts", "refused")])


@query(f"""WITH {MONTHS}, c AS (SELECT month, value / quantity AS computed, CASE WHEN month(month) = 3 THEN value / quantity * 1.02 ELSE value / quantity * 1.001 END AS price FROM m)
SELECT month, 'price' AS metric, round(price, 6) AS published, round(computed, 6) AS computed, round(abs(price - computed) / price, 6) AS apart FROM c WHERE month(month) = 3 AND computed IS NOT NULL""")
def published_vs_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ratio(F.col("value"), F.col("quantity"))
    p = months(spark, sf_dir).withColumn("price", own * F.when(F.month("month") == 3, 1.02).otherwise(1.001))
    return _rounded(P.divergences(p, {"price": own}))


@query(f"""WITH {MONTHS} SELECT month, CAST(sum(sales) OVER w AS DOUBLE) AS sales, round(sum(value) OVER w, 4) AS value, round(avg(offers) OVER w, 4) AS offers,
  round(sum(CASE WHEN quantity IS NOT NULL THEN value END) OVER w / sum(quantity) OVER w, 4) AS price FROM m
  WINDOW w AS (PARTITION BY year(month) ORDER BY month ROWS UNBOUNDED PRECEDING)""")
def running_ytd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.running(months(spark, sf_dir), METRICS[:4]), 4)


@query(f"""WITH {MONTHS} SELECT month, CAST(sum(sales) OVER w AS DOUBLE) AS sales, round(avg(offers) OVER w, 4) AS offers FROM m WHERE month BETWEEN '1996-04-01' AND '1998-02-01'
  WINDOW w AS (ORDER BY month ROWS UNBOUNDED PRECEDING)""")
def running_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.window(months(spark, sf_dir), "custom", None, "1998-02-01", "1996-04-01")
    return _rounded(P.running(p, [METRICS[0], METRICS[2]], by_year=False), 4)


def _compare_sql(shift: int) -> str:
    return f"""WITH {MONTHS} SELECT a.month, a.sales, a.offers, b.sales AS sales_before, b.offers AS offers_before,
  round((a.sales - b.sales) / CAST(b.sales AS DOUBLE), 6) AS sales_change, round((a.offers - b.offers) / CAST(nullif(b.offers, 0) AS DOUBLE), 6) AS offers_change
  FROM m a LEFT JOIN m b ON b.month + INTERVAL {shift} MONTH = a.month"""


@query(_compare_sql(1))
def period_compare_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.compared(months(spark, sf_dir), ["sales", "offers"], 1))


@query(_compare_sql(12))
def period_compare_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.compared(months(spark, sf_dir), ["sales", "offers"], 12))


@query(f"""WITH {MONTHS} SELECT month(month)::INT AS month_no, max(CASE WHEN year(month) = 1997 THEN sales END) AS y1997, max(CASE WHEN year(month) = 1998 THEN sales END) AS y1998,
  max(CASE WHEN year(month) = 1999 THEN sales END) AS y1999, max(CASE WHEN year(month) = 2000 THEN sales END) AS y2000 FROM m WHERE year(month) BETWEEN 1997 AND 2000 GROUP BY 1""")
def seasonality_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = list(range(1997, 2001))
    m = months(spark, sf_dir).filter(F.year("month").isin(years))
    out = m.select(F.month("month").alias("month_no"), F.year("month").alias("year"), "sales").groupBy("month_no").pivot("year", years)
    return out.agg(F.max("sales")).toDF("month_no", *(f"y{y}" for y in years))


@query(f"""WITH {MONTHS} SELECT year(month)::INT AS year, round(sum(value) / sum(sales), 4) AS ticket, round(sum(value) FILTER (quantity IS NOT NULL) / sum(quantity), 4) AS price,
  round(avg(offers) FILTER (offers IS NOT NULL) / avg(sales) FILTER (offers IS NOT NULL), 4) AS months_of_supply, CAST(sum(sales) - sum(offers) AS BIGINT) AS net FROM m GROUP BY 1""")
def market_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = F.col("offers").isNotNull()
    out = months(spark, sf_dir).groupBy(F.year("month").alias("year")).agg(
        ratio(F.sum("value"), F.sum("sales")).alias("ticket"),
        ratio(F.sum(F.when(F.col("quantity").isNotNull(), F.col("value"))), F.sum("quantity")).alias("price"),
        ratio(F.avg("offers"), F.avg(F.when(has, F.col("sales")))).alias("months_of_supply"),
        (F.sum("sales") - F.sum("offers")).alias("net"),
    )
    return _rounded(out, 4)


@query("""SELECT o_custkey, count(*) AS orders, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN max(o_orderstatus) END AS status,
  array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS seen FROM orders GROUP BY o_custkey""")
def provenance_agreed(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.array_sort(F.collect_set("o_orderstatus"))  # a status is one of a few fixed values
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.when(F.size(seen) == 1, seen[0]).alias("status"), F.array_join(seen, ",").alias("seen"))


@query(f"""WITH {MONTHS}, q AS (SELECT month FROM m WHERE month(month) NOT IN (4, 9)), b AS (SELECT min(month) AS a, max(month) AS z FROM q)
SELECT CAST(s AS DATE) AS month FROM b, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 MONTH)) AS t(s) WHERE CAST(s AS DATE) NOT IN (SELECT month FROM q)""")
def month_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = months(spark, sf_dir).filter(~F.month("month").isin(4, 9)).select("month")
    return P.spine(m).join(m, "month", "left_anti")
