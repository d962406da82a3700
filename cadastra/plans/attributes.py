"""Typed attributes of parts by definitions from a table, and values deflated by chained rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators import attributes as A
from cadastra.registry import query, spread, table


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A definition for every region: a number with a unit, an option, a date, a flag, a whole number."""
    k = F.col("r_regionkey")
    pick = lambda *of: F.element_at(F.array(*map(F.lit, of)), k.cast("int") + 1)
    options = F.when(k == 1, F.array(*(F.lit(f"Brand#{i}") for i in (11, 12, 13))))
    return table(spark, sf_dir, "region").select(F.concat(F.lit("a"), k).alias("attribute"), pick("number", "option", "date", "flag", "integer").alias("kind"), F.when(k == 0, "cm").alias("unit"), options.alias("options"))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven texts a part; some break their definition, some have none."""
    k = F.col("p_partkey")
    given = {
        "a0": F.when(k % 7 == 0, "wide").when(k % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(",5 CM"))).otherwise(F.col("p_size").cast("string")),
        "a1": F.upper(F.col("p_brand")), "a2": F.when(k % 5 == 0, "31/02/2024").otherwise(F.concat(F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("/03/2024"))),
        "a3": F.when(k % 11 == 0, "maybe").when(k % 2 == 0, "sim").otherwise("nao"), "a4": F.when(k % 4 == 0, "1,5").otherwise(F.col("p_size").cast("string")),
        "a9": F.lit("lost"), "a8": F.lit("  "),
    }
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), v.alias("value")) for a, v in given.items())))
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")).select(k.alias("ident"), each.alias("x")).select("ident", "x.*")


@query("""SELECT p_partkey AS ident, 'a0' AS attribute, CASE WHEN p_partkey % 7 <> 0 THEN (CASE WHEN p_partkey % 3 = 0 THEN p_size + 0.5 ELSE p_size END)::DOUBLE::VARCHAR END AS value, CASE WHEN p_partkey % 7 = 0 THEN 'not_a_number' END AS reason FROM part
UNION ALL SELECT p_partkey, 'a1', CASE WHEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') THEN p_brand END, CASE WHEN p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'not_an_option' END FROM part
UNION ALL SELECT p_partkey, 'a2', CASE WHEN p_partkey % 5 <> 0 THEN '2024-03-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') END, CASE WHEN p_partkey % 5 = 0 THEN 'not_a_date' END FROM part
UNION ALL SELECT p_partkey, 'a3', CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END END, CASE WHEN p_partkey % 11 = 0 THEN 'not_a_flag' END FROM part
UNION ALL SELECT p_partkey, 'a4', CASE WHEN p_partkey % 4 <> 0 THEN p_size::VARCHAR END, CASE WHEN p_partkey % 4 = 0 THEN 'not_an_integer' END FROM part
UNION ALL SELECT p_partkey, 'a9', NULL, 'unknown_attribute' FROM part""")
def typed_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value as its kind, or the reason why it is rejected."""
    found = A.typed(values(spark, sf_dir), definitions(spark, sf_dir))
    amount = F.try_variant_get("value", "$", "double").cast("string")
    return found.select("ident", "attribute", F.when(F.col("attribute") == "a0", amount).otherwise(F.try_variant_get("value", "$", "string")).alias("value"), "reason")


@query("""SELECT p_partkey AS ident FROM part WHERE p_partkey % 7 <> 0 AND CASE WHEN p_partkey % 3 = 0 THEN p_size + 0.5 ELSE p_size END BETWEEN 10 AND 20.5 AND p_brand IN ('Brand#11', 'Brand#13')""")
def attribute_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts within a range of a typed number and with one of two options."""
    found = A.typed(values(spark, sf_dir), definitions(spark, sf_dir))
    return A.matching(found, "a0", 10, 20.5).join(A.matching(found, "a1", options=["Brand#11", "Brand#13"]), "ident", "left_semi")


@query("""WITH r AS (SELECT n_nationkey AS series, y AS year, ((n_nationkey * 7 + y) % 11) / 100.0 AS rate FROM nation, range(1992, 1999) t(y) WHERE (n_nationkey + y) % 13 <> 0),
v AS (SELECT c_nationkey AS series, year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS nominal FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
f AS (SELECT v.series, v.year, nominal, count(rate) AS k, coalesce(sum(ln(1 + rate)), 0) AS g FROM v LEFT JOIN r ON r.series = v.series AND r.year > least(v.year, 1995) AND r.year <= greatest(v.year, 1995) GROUP BY 1, 2, 3)
SELECT series, CAST(year AS INTEGER) AS year, nominal, CASE WHEN k = abs(year - 1995) THEN round(nominal / exp(CASE WHEN year > 1995 THEN g ELSE -g END), 2) END AS real FROM f""")
def deflated_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turnover of every nation and year at prices of 1995, by rates of which some are missing."""
    years = F.explode(F.sequence(F.lit(1992), F.lit(1998)))
    rates = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("series"), years.alias("year")).withColumn("rate", ((F.col("series") * 7 + F.col("year")) % 11) / 100.0).filter("(series + year) % 13 <> 0")
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    panel = orders.groupBy(F.col("c_nationkey").alias("series"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("nominal"))
    return A.deflated(panel, rates, "series", "year", "nominal", 1995).withColumn("real", F.round("real", 2))
