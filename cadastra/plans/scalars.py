"""Scalar functions over whole tables. Texts are written from known values, which the SQL names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions import scalar as S
from cadastra.registry import dealt, query, table


def _grouped(n: Column, comma: bool) -> Column:
    """1,234.56 or 1.234,56."""
    text = F.format_number(n, 2)
    return F.translate(text, ",.", ".,") if comma else text


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice AS both_pt, l_extendedprice AS both_en, l_extendedprice AS plain, l_extendedprice AS money,
  l_discount AS percent, CAST(l_quantity AS BIGINT) AS whole, CAST(NULL AS DOUBLE) AS unreadable FROM lineitem""")
def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, d = F.col("l_extendedprice"), F.col("l_discount")
    return dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity")).select(
        "l_orderkey", "l_linenumber",
        S.number(_grouped(p, True)).alias("both_pt"), S.number(_grouped(p, False)).alias("both_en"), S.number(F.format_string("%.2f", p)).alias("plain"),
        S.number(F.concat(F.lit("R$ "), _grouped(p, True))).alias("money"), S.number(F.concat(F.translate(F.format_string("%.2f", d), ".", ","), F.lit(" %"))).alias("percent"),
        S.integer(F.format_string("%.2f", F.col("l_quantity") + 0.4)).alias("whole"), S.number(F.concat(F.lit("x"), F.col("l_linenumber"))).alias("unreadable"),
    )


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS zero_month, CAST(o_orderdate AS DATE) AS br, CAST(o_orderdate AS DATE) AS serial,
  CAST(NULL AS DATE) AS no_day, strftime(o_orderdate, '%Y-%m') AS month FROM orders""")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    serial = F.datediff(d, F.lit("1899-12-30").cast("date"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", S.calendar_date(F.date_format(d, "yyyy-MM-dd HH:mm:ss")).alias("iso"),
        S.calendar_date(F.format_string("Date(%d,%d,%d)", F.year(d), F.month(d) - 1, F.dayofmonth(d))).alias("zero_month"),
        S.calendar_date(F.date_format(d, "dd/MM/yyyy")).alias("br"), S.calendar_date(serial.cast("string")).alias("serial"),
        S.calendar_date(F.concat(F.year(d).cast("string"), F.lit("-02-30"))).alias("no_day"), S.month_key(F.date_format(d, "MM/yyyy")).alias("month"),
    )


@query("""SELECT event_id, event_id % 4 = 0 OR event_id % 4 = 3 AS two_valued,
  CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS three_valued FROM events""")
def boolean_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(F.lit(" Sim"), F.lit("não"), F.lit(" "), F.lit("7")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", S.flag(word).alias("two_valued"), S.flag_or_null(word).alias("three_valued"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_suppkey % 90 + 0.5 END AS lat,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 11 = 0 THEN NULL ELSE -(s_suppkey % 180) - 0.25 END AS lon FROM supplier""")
def coordinate_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    lat = F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, 0.0).when(k % 11 == 0, 91.0).otherwise(k % 90 + 0.5)
    lon = F.when(k % 7 == 0, 0.0).otherwise(-(k % 180) - 0.25)
    c = S.coordinate(lat, lon)
    return table(spark, sf_dir, "supplier").select("s_suppkey", c["lat"].alias("lat"), c["lon"].alias("lon"))


@query("""WITH p AS (SELECT p_partkey, p_retailprice, CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE p_size END AS area,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice / p_size * (1 + (p_partkey % 10) / 100.0) END AS informed FROM part)
SELECT p_partkey, round(coalesce(informed, CASE WHEN area > 0 THEN p_retailprice / area END), 6) AS value,
  coalesce(CASE WHEN area > 0 THEN abs(p_retailprice / area - informed) / informed END > 0.0505, false) AS mismatch FROM p""")
def price_per_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    area = F.when(k % 6 == 0, 0).otherwise(F.col("p_size"))
    informed = F.when(k % 3 != 0, F.col("p_retailprice") / F.col("p_size") * (1 + (k % 10) / 100.0))
    p = S.price_per_area(F.col("p_retailprice"), area, informed, 0.0505)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(p["value"], 6).alias("value"), p["mismatch"].alias("mismatch"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1000.0 * (p_partkey % 900 + 100) ELSE p_partkey % 900 + 100.0 END AS price FROM part""")
def ambiguous_thousands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_partkey") % 900 + 100
    expected = F.when(k % 2 == 0, 1000.0 * n).otherwise(n.cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", S.price(F.format_string("%d.000", n), F.lit(50.0), expected / 50).alias("price"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN l_discount WHEN 1 THEN l_discount * 100 + 1.5 ELSE l_quantity + 200 END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(v) <= 1 THEN v WHEN abs(v) <= 100 THEN v / 100 ELSE v END, 6) AS value,
  CASE WHEN abs(v) <= 1 THEN NULL WHEN abs(v) <= 100 THEN 'ESCALA_CONVERTIDA' ELSE 'ESCALA_INDETERMINADA' END AS scale FROM l""")
def fraction_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 3
    f = S.fraction(F.when(n == 0, F.col("l_discount")).when(n == 1, F.col("l_discount") * 100 + 1.5).otherwise(F.col("l_quantity") + 200))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(f["value"], 6).alias("value"), f["flag"].alias("scale"))


@query("""SELECT p_partkey, trim(regexp_replace(strip_accents(lower(p_name || ' São-' || p_brand)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part""")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.slug(F.concat("p_name", F.lit(" São-"), "p_brand")).alias("slug"))


@query("""SELECT c_custkey, CAST(c_custkey % 399 + 1 AS INTEGER) AS number, 'RA_' || lpad(CAST((c_custkey % 399 + 1) % 100 AS VARCHAR), 2, '0') AS region, CAST(NULL AS INTEGER) AS wrong FROM customer""")
def region_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey") % 399 + 1
    found = S.region_number(F.concat(F.lit("ra-"), F.lower(S.roman(n))))
    return table(spark, sf_dir, "customer").select("c_custkey", found.alias("number"), S.region_id(found).alias("region"), S.region_number(F.concat(F.lit("RA "), S.roman(n), F.lit("IIII"))).alias("wrong"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'vertical' WHEN 1 THEN 'horizontal' END AS orientation,
  NOT (p_partkey % 2 = 0 AND p_partkey % 5 <> 0) AS approximate,
  CASE WHEN p_partkey % 10 = 0 THEN 'sem_info' WHEN p_size < 10 THEN 'a' WHEN p_size < 20 THEN 'b' WHEN p_size < 40 THEN 'c' ELSE 'd' END AS band FROM part""")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.element_at(F.array(F.lit("Apartamento"), F.lit("casa "), F.lit("loja")), (k % 3 + 1).cast("int"))
    precision = F.when(k % 2 == 0, "building_reference_point").otherwise("street")
    confidence = F.when(k % 5 == 0, "low_spatial_confidence").otherwise("ok")
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.orientation(kind).alias("orientation"), S.approximate(precision, confidence, F.lit(None).cast("string")).alias("approximate"),
        S.band(F.when(k % 10 != 0, F.col("p_size")), [10, 20, 40], ["a", "b", "c", "d"], "sem_info").alias("band"),
    )


@query("""SELECT p_partkey, CAST(CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE (p_size >= 10)::INT + (p_size >= 25)::INT + (p_size >= 40)::INT END AS INTEGER) AS class FROM part""")
def class_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("p_partkey") % 9 == 0, float("nan")).otherwise(F.col("p_size").cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", S.class_index(v, [10, 25, 40]).alias("class"))


@query("""SELECT page_id, regexp_replace(url, '[?#].*$', '') AS canonical, regexp_extract(url, '^https?://([^/?#:]*)', 1) AS host, NULL::VARCHAR AS other FROM pages""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.upper(F.regexp_extract("url", "^[^/]*//[^/?#]*", 0)), F.regexp_extract("url", "^[^/]*//[^/?#]*(.*)$", 1))
    return table(spark, sf_dir, "pages").select("page_id", S.canonical_url(url).alias("canonical"), S.url_host(url).alias("host"), S.canonical_url(F.concat(F.lit("javascript:"), url)).alias("other"))


@query("""WITH h AS (SELECT s_suppkey, sha256(s_name) AS h FROM supplier), p AS (
  SELECT s_suppkey, CAST('0x' || substr(h, 1, 8) AS BIGINT) / 4294967295.0 * 2 * pi() AS angle, sqrt(CAST('0x' || substr(h, 9, 8) AS BIGINT) / 4294967295.0) * 0.004 AS radius FROM h)
SELECT s_suppkey, round(-15.8 + radius * sin(angle), 6) AS lat, round(-47.9 + radius * cos(angle) / cos(radians(-15.8)), 6) AS lon FROM p""")
def deterministic_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.jitter(F.col("s_name"), F.lit(-15.8), F.lit(-47.9))
    return table(spark, sf_dir, "supplier").select("s_suppkey", p["lat"].alias("lat"), p["lon"].alias("lon"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.' || json_keys(props)[1]) AS VARCHAR) AS first_value, len(json_keys(props)) AS n_keys, CAST(NULL AS INTEGER) AS of_array FROM events""")
def property_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    bag = S.property_bag(F.col("props"))
    key = F.json_object_keys("props")[0]
    array = S.property_bag(F.concat(F.lit("["), F.col("props"), F.lit("]")))
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(bag, key).alias("first_value"), F.size(bag).cast("long").alias("n_keys"), F.when(array.isNotNull(), F.size(array)).alias("of_array"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_name || ' · ' || r_name END AS label,
  CASE WHEN n_nationkey % 3 = 0 THEN '''=' || n_name ELSE n_name END AS guarded, CASE WHEN n_nationkey % 3 = 0 THEN '=' || n_name ELSE n_name END AS unguarded
  FROM nation JOIN region ON r_regionkey = n_regionkey""")
def labels_and_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # region is a fixed dimension
    cell = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("="), "n_name")).otherwise(F.col("n_name"))
    other = F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("r_name"))
    return n.select("n_nationkey", S.label(F.col("n_name"), other).alias("label"), S.guarded(cell).alias("guarded"), S.unguarded(S.guarded(cell)).alias("unguarded"))
