"""Vocabularies, record and list filters, and resolution of places over the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions import vocabulary as V
from cadastra.operators import filters as L
from cadastra.operators import joins as J
from cadastra.operators import quality as Q
from cadastra.registry import query, table

_STATUS = ["Pré-Lançamento", "Em obras", "Pronto p/ morar", "Em construção", "?", ""]
_CATEGORY = ["Escola", "Saúde", "Mobilidade", "Supermercado/Atacarejo", "Shopping Center", "Praça"]
_NAMES = ["Hospital X", "Clínica Y", "Estação de Metrô", "Atacadão", "Loja", "Terminal Rodoviário"]
_URLS = ["/casa-em-condominio/3-quartos/", "/apartamento-2-qts", "/lote/10", "/kitinete-1-quarto.html", "/casas/4_dormitorios", "/loja"]


def _pick(texts: list[str], k: str, mod: int = 6) -> Column:
    return F.element_at(F.array(*map(F.lit, texts)), (F.col(k) % mod + 1).cast("int"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'given' WHEN p_size % 6 = 0 THEN 'em_lancamento' WHEN p_size % 6 IN (1, 3) THEN 'em_construcao' WHEN p_size % 6 = 2 THEN 'oferta' END AS stage,
  CASE p_partkey % 6 WHEN 2 THEN 'infraestrutura' WHEN 5 THEN NULL ELSE 'comercio_servico' END AS grp,
  CASE p_partkey % 6 WHEN 0 THEN 'escola' WHEN 1 THEN CASE p_size % 6 WHEN 0 THEN 'hospital' WHEN 1 THEN 'clinica' END WHEN 2 THEN CASE p_size % 6 WHEN 2 THEN 'estacao_metro' WHEN 5 THEN 'terminal_rodoviario' END WHEN 3 THEN CASE p_size % 6 WHEN 3 THEN 'atacado' ELSE 'supermercado' END END AS segment FROM part""")
def derived_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    given = F.when(F.col("p_partkey") % 10 == 0, "given").otherwise(" ")
    category, name = _pick(_CATEGORY, "p_partkey"), _pick(_NAMES, "p_size")
    return p.select("p_partkey", V.sales_stage(_pick(_STATUS, "p_size"), given).alias("stage"), V.anchor_group(category).alias("grp"), V.anchor_segment(category, F.lit(None), name).alias("segment"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'casa_condominio' WHEN 1 THEN 'apartamento' WHEN 2 THEN 'terreno' WHEN 3 THEN 'kitnet' WHEN 4 THEN 'casa' END AS type,
  CAST(CASE o_orderkey % 6 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 4 END AS INTEGER) AS bedrooms FROM orders""")
def url_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://x.org"), _pick(_URLS, "o_orderkey"))
    path = F.regexp_replace(url, "^https?://[^/]+", "")
    return table(spark, sf_dir, "orders").select("o_orderkey", V.property_type(path).alias("type"), V.bedrooms(path).alias("bedrooms"))


@query("""SELECT n_nationkey, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w, i: CASE WHEN i > 1 AND w IN ('de', 'da', 'do', 'das', 'dos', 'e') THEN w ELSE upper(w[1]) || w[2:] END), ' ') || ' do Sul' AS name FROM nation""")
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", V.title(F.concat(F.lit(" "), F.upper("n_name"), F.lit("  DO SUL"))).alias("name"))


@query("""SELECT p_partkey FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 4 <> 1 AND (p_name ILIKE '%a%' OR p_brand ILIKE '%a%') AND p_type LIKE 'S%' AND p_retailprice + CASE WHEN p_size % 2 = 0 THEN 50 ELSE 0 END >= 950 AND p_retailprice <= 1900 AND p_size % 5 >= 2""")
def record_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active listings of one type by a text, a range of prices and bedrooms."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 3 == 0, "listing").when(k % 3 == 1, "development").otherwise("anchor").alias("kind"), F.when(k % 4 == 1, " Inactive").otherwise("").alias("status"), F.upper("p_name").alias("title"), F.col("p_brand").alias("locality"),
        F.when(F.col("p_type").startswith("S"), "casa").otherwise("lote").alias("property_type"), F.col("p_retailprice").alias("price"), F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice") + 50).alias("price_max"), (F.col("p_size") % 5).alias("bedrooms"),
    )
    found = L.record_filter(p, kinds=["listing", "anchor"], active_only=True, text="Á", property_type="casa", least_price=950, most_price=1900, bedrooms=2, sales_stage=None)
    return found.select(F.col("id").alias("p_partkey"))


@query("""SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0 AND s_nationkey IN (1, 3, 5, 7, 9, 11, 13) AND s_acctbal BETWEEN -500 AND 7000 AND (s_suppkey % 40) * 0.1 BETWEEN 0.5 AND 3.0 AND (s_name LIKE '%1%' OR CAST(s_nationkey AS VARCHAR) LIKE '%1%')""")
def list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumns({"status": F.when(F.col("s_suppkey") % 3 == 0, "inactive").otherwise("active"), "lon": F.round((F.col("s_suppkey") % 40) * 0.1, 6), "lat": F.lit(0.0), "ra": F.col("s_nationkey").cast("string")})
    found = L.list_filter(s, lists={"ra": "1, 3,5,7,,9,11,13", "s_name": None}, ranges={"s_acctbal": (-500, 7000)}, box=(0.5, -1.0, 3.0, 1.0), text="1", fields=["s_name", "ra"])
    return found.select("s_suppkey")


@query("""WITH p AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 4 <> 0)
SELECT count(*) FILTER (p.k IS NOT NULL AND c.k IS NOT NULL) AS matched, count(*) FILTER (p.k IS NULL) AS left_only, count(*) FILTER (c.k IS NULL) AS right_only FROM c FULL JOIN p ON p.k = c.k""")
def enrichment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k"))
    people = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("population"))
    return J.enriched(c, people, "k")[1]


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 40 < 25 THEN CAST(o_custkey % 40 AS INTEGER) END AS place_id FROM orders""")
def place_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By id, code, old code or name; what is in no place comes out as a rejection."""
    n, k = table(spark, sf_dir, "nation"), F.col("o_custkey") % 40
    places = n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("C-"), "n_nationkey").alias("code"), F.concat(F.lit("OLD"), "n_nationkey").alias("legacy"), F.col("n_name").alias("name"))
    named = table(spark, sf_dir, "orders").select("o_orderkey", k.alias("n_nationkey"), (F.col("o_orderkey") % 4).alias("form")).join(n.select("n_nationkey", "n_name"), "n_nationkey", "left")
    text = F.when(F.col("form") == 0, F.col("n_nationkey").cast("string")).when(F.col("form") == 1, F.concat(F.lit(" C-"), "n_nationkey")).when(F.col("form") == 2, F.concat(F.lit("OLD"), "n_nationkey")).otherwise(F.coalesce(F.initcap("n_name"), F.lit("nowhere")))
    good, bad = J.resolved(named.select("o_orderkey", text.alias("place")), "place", places)
    return good.select("o_orderkey", "place_id").unionByName(bad.select("o_orderkey", F.lit(None).cast("int").alias("place_id")))


@query("""SELECT 'RA-X' AS ident, 'roman' AS code FROM nation WHERE n_nationkey = 13 UNION ALL SELECT 'name=' || r_name, 'repeated' FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name HAVING count(*) > 1 UNION ALL SELECT CAST(count(*) AS VARCHAR), 'count' FROM nation HAVING count(*) <> 24""")
def crosswalk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadastra.functions.scalar import roman

    k = F.col("n_nationkey")
    names = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("name"))
    n = table(spark, sf_dir, "nation").join(names, "n_regionkey").select((k + 1).alias("number"), F.when(k == 13, "RA-X").otherwise(F.concat(F.lit("RA-"), roman(k + 1))).alias("code"), "name", "n_name")
    return Q.crosswalk_findings(n, "number", "code", ["name", "n_name"], 24)


@query("""WITH c AS (SELECT c_nationkey AS region, c_custkey % 17 AS category, 1 + c_custkey % 3 AS persons FROM customer), b AS (SELECT region, CASE WHEN category < 3 THEN '0-14' WHEN category < 6 THEN '15-29' WHEN category < 9 THEN '30-44' WHEN category < 12 THEN '45-59' ELSE '60+' END AS band, persons FROM c),
t AS (SELECT region, count(*) AS households, sum(persons) AS persons FROM b GROUP BY 1)
SELECT region, band, CAST(sum(b.persons) AS BIGINT) AS n, round(100.0 * sum(b.persons) / any_value(t.persons), 6) AS share, any_value(households) AS households, round(any_value(t.persons) / CAST(any_value(households) AS DOUBLE), 6) AS per_household FROM b JOIN t USING (region) GROUP BY 1, 2""")
def household_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five age bands of persons with their share of the region, its households and persons a household."""
    from cadastra.functions.scalar import band

    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("region"), band(k % 17, [3, 6, 9, 12], ["0-14", "15-29", "30-44", "45-59", "60+"], "").alias("band"), (1 + k % 3).alias("persons"))
    total = c.groupBy("region").agg(F.count("*").alias("households"), F.sum("persons").alias("all"))
    out = c.groupBy("region", "band").agg(F.sum("persons").alias("n")).join(total, "region")
    return out.select("region", "band", "n", F.round(100.0 * F.col("n") / F.col("all"), 6).alias("share"), "households", F.round(F.col("all") / F.col("households"), 6).alias("per_household"))
