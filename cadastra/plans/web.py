"""Pages as snapshots of listings, and events as their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators import lifecycle, web
from cadastra.operators.selection import with_percentiles
from cadastra.registry import query, table

_TEXT = r"""trim(regexp_replace(strip_accents(lower(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html,
  '(?is)<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>|<noscript[^>]*>.*?</noscript\s*>|<template[^>]*>.*?</template\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'))), '\s+', ' ', 'g'))"""


@query(f"SELECT page_id, sha256({_TEXT}) AS text FROM pages")
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(web.visible_text(F.col("html")), 256).alias("text"))


@query("""SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'gone' WHEN 1 THEN 'blocked' WHEN 2 THEN 'error' WHEN 3 THEN 'redirect' WHEN 4 THEN 'gone' WHEN 5 THEN 'error' WHEN 6 THEN 'blocked' ELSE 'ok' END AS verdict FROM pages""")
def page_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 8
    code = F.when(k == 0, 404).when(k == 1, 403).when(k == 2, 500).otherwise(200)
    text = F.concat_ws(" ", web.visible_text(F.col("html")), F.when(k.isin(4, 5), "anuncio removido").when(k == 6, "captcha"))
    final = F.when(k == 3, F.concat("url", F.lit("x"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", web.verdict(code, final, F.col("url"), text, k.isin(5, 7)).alias("verdict"))


@query(r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"''#]*)', 1)) AS href FROM pages)
SELECT DISTINCT page_id, regexp_extract(href, '^(/[^?#]*)', 1) AS path FROM h WHERE href LIKE '/%' AND regexp_matches(regexp_extract(href, '^/([^/?#]*)', 1), '^[Tt]')""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.links(table(spark, sf_dir, "pages"), "page_id", "url", "html", "^[Tt]").drop("host")


@query(r"""WITH h AS (SELECT page_id, length(html) AS size, len(regexp_extract_all(html, '(?i)<a\s')) AS anchors, page_id % 4 AS kind FROM pages),
p AS (SELECT page_id, kind, 1000.0 + size AS own, 10.0 + anchors AS other FROM h)
SELECT page_id, CAST(CASE kind WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS BIGINT) AS candidates, CAST(CASE kind WHEN 0 THEN own WHEN 1 THEN other WHEN 3 THEN own END AS DOUBLE) AS price FROM p""")
def page_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured data is written into each page here, as the given pages hold none: prices of the page's size and number of anchors,
    in the state of an application at some depth under the listing's id, in linked data, twice without the id, or in a meta tag alone."""
    k, text = F.col("page_id"), F.col("page_id").cast("string")
    own, other = 1000.0 + F.char_length("html"), 10.0 + F.regexp_count("html", F.lit(r"(?i)<a\s"))
    script = lambda kind, *parts: F.concat(F.lit(f'<script type="{kind}">'), *(p if not isinstance(p, str) else F.lit(p) for p in parts), F.lit("</script>"))
    deep = script("application/json", '{"props":{"pageProps":[{"x":null},{"listing":{"id":"', text, '","deal":{"sale":{"price":', own.cast("string"), '}}}}],"ads":[{"id":"other","price":"', other.cast("string"), '"}]}}')
    linked = script("application/ld+json", '{"sku":"other","offers":[{"lowPrice":', other.cast("string"), "}]}")
    twice = script("application/ld+json", '[{"sku":"a","price":', own.cast("string"), '},{"sku":"b","offers":{"price":', other.cast("string"), "}}]")
    meta = F.concat(F.lit('{not json</script><meta content="'), own.cast("string"), F.lit('" property="product:price:amount"/>'))
    html = F.concat("html", F.when(k % 4 == 0, deep).when(k % 4 == 1, linked).when(k % 4 == 2, twice).otherwise(meta))
    pages = table(spark, sf_dir, "pages").select("page_id", text.alias("listing"), html.alias("html"))
    return web.structured(pages, "page_id", "html", "listing")


@query("""SELECT page_id, CASE regexp_extract(url, '://[^/]*/([a-z]+)/', 1) WHEN 'en' THEN 'England' WHEN 'fr' THEN 'France' WHEN 'de' THEN 'Germany' END AS locality FROM pages WHERE regexp_extract(url, '://[^/]*/([a-z]+)/', 1) IN ('en', 'fr', 'de')""")
def page_locality(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("England", "en"), ("France", "fr"), ("Germany", "de")], "locality string, slug string")
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://[^/]*(/[a-z]+/)", 1).alias("path"))
    return web.inferred_locality(pages, "page_id", "path", known)


_CAND = """c AS (SELECT o_orderkey, o_totalprice AS price, o_custkey % 50 AS area, c_nationkey AS loc, CASE WHEN o_orderkey % 13 = 0 THEN 'rent' ELSE 'sale' END AS deal FROM orders JOIN customer ON c_custkey = o_custkey),
r AS (SELECT loc, quantile_cont(price / area, 0.5) AS median, count(*) AS n FROM c WHERE area > 0 GROUP BY 1)"""


@query(f"""WITH {_CAND}, g AS (SELECT o_orderkey, concat_ws(',', CASE WHEN price < 20000 THEN 'price' END, CASE WHEN area <= 0 THEN 'area' END, CASE WHEN deal <> 'sale' THEN 'deal' END) AS hard,
  CASE WHEN n >= 3 AND area > 0 AND (price / area / median > 3 OR price / area / median < 1 / 3.0) THEN 'outlier' ELSE '' END AS soft FROM c LEFT JOIN r USING (loc))
SELECT o_orderkey, hard, soft, CASE WHEN hard <> '' THEN 'rejected' WHEN soft <> '' THEN 'review' ELSE 'promoted' END AS decision FROM g""")
def candidate_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    cand = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 50).alias("area"), F.col("c_nationkey").alias("loc"), F.when(k % 13 == 0, "rent").otherwise("sale").alias("deal"))
    m2 = F.try_divide("price", "area")
    sold = cand.filter("area > 0")
    ref = with_percentiles(sold.groupBy("loc").agg(F.count("*").alias("n")), sold, ["loc"], m2, (0.5,), ("median",))
    rate = F.try_divide(m2, F.col("median"))
    out = web.gates(cand.join(ref, "loc", "left"), {"price": F.col("price") < 20000, "area": F.col("area") <= 0, "deal": F.col("deal") != "sale"}, {"outlier": (F.col("n") >= 3) & ((rate > 3) | (rate < 1 / 3))})
    return out.select("o_orderkey", F.array_join("hard", ",").alias("hard"), F.array_join("soft", ",").alias("soft"), "decision")


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the checks of a listing: error = gone, purchase and click = ok, others blocked."""
    outcome = F.when(F.col("event_type").isin("error", "view"), "gone").when(F.col("event_type").isin("purchase", "click"), "ok").otherwise("blocked")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("listing"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), outcome.alias("outcome"), F.round(F.col("value") * 100, 0).alias("price"))


#: The fold of a listing's checks, one check a step.
FOLD = """WITH RECURSIVE c AS (
  SELECT user_id AS listing, ts AS moment, CASE WHEN event_type IN ('error', 'view') THEN 'gone' WHEN event_type IN ('purchase', 'click') THEN 'ok' ELSE 'blocked' END AS outcome, round(value * 100, 0) AS price,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events
), seen AS (
  SELECT c.*, outcome = 'ok' AS ok, outcome = 'gone' AS gone, CAST(moment AS DATE) AS d FROM c
), fold(listing, i, status, failures, price, last, day, deactivated, reactivated, price_change, price_unconfirmed) AS (
  SELECT DISTINCT listing, CAST(0 AS BIGINT), 'active', 0, CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR), CAST(NULL AS DATE), 0, 0, 0, 0 FROM c
  UNION ALL
  SELECT listing, i, CASE WHEN down THEN 'inactive' WHEN up THEN 'active' ELSE status END, failures, CASE WHEN (ok AND old IS NULL) OR taken THEN new ELSE old END, outcome, d,
         deactivated + down::INT, reactivated + up::INT, price_change + taken::INT, price_unconfirmed + (moved AND NOT taken)::INT
  FROM (SELECT *, gone AND status <> 'inactive' AND failures >= 3 AS down, ok AND status = 'inactive' AS up, moved AND abs(new - old) / old <= 0.6 AS taken
    FROM (SELECT n.listing, n.i, n.ok, n.gone, n.outcome, n.d, n.price AS new, f.price AS old, f.status, f.deactivated, f.reactivated, f.price_change, f.price_unconfirmed,
        CASE WHEN n.ok THEN 0 WHEN n.gone AND NOT coalesce(f.last = 'gone' AND f.day = n.d, FALSE) THEN f.failures + 1 ELSE f.failures END AS failures,
        n.ok AND coalesce(f.price > 0 AND abs(n.price - f.price) >= 1, FALSE) AS moved
      FROM fold f JOIN seen n ON n.listing = f.listing AND n.i = f.i + 1))
), done AS (
  SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY listing ORDER BY i DESC) = 1
)"""
EVENT_KINDS = ("deactivated", "reactivated", "price_change", "price_unconfirmed")


@query(f"{FOLD} SELECT listing, status, failures, price, deactivated, reactivated, price_change, price_unconfirmed FROM done")
def listing_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every listing after all its checks."""
    out = lifecycle.fold(checks(spark, sf_dir), "listing")
    count = lambda e: F.size(F.filter("events", lambda x: x["event"] == e)).alias(e)
    return out.select("listing", "status", "failures", "price", *map(count, ("deactivated", "reactivated", "price_change", "price_unconfirmed")))
