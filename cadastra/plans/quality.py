"""Rules, imports, change data, filters and orders over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions.scalar import fold, slug
from cadastra.operators import quality as Q
from cadastra.operators.quality import Rule
from cadastra.registry import query, table


@query("""SELECT c_custkey, 'negative_balance' AS code, 'warning' AS severity FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'region_range', 'error' FROM customer WHERE c_nationkey >= 20
UNION ALL SELECT c_custkey, 'price_mismatch', 'info' FROM customer WHERE abs(c_acctbal - round(c_acctbal, 0)) > 0.4""")
def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("c_acctbal")
    rules = [Rule("negative_balance", "warning", b < 0), Rule("region_range", "error", F.col("c_nationkey") >= 20), Rule("price_mismatch", "info", F.abs(b - F.round(b, 0)) > 0.4)]
    return Q.rule_findings(table(spark, sf_dir, "customer"), "c_custkey", rules)


@query("""SELECT l_orderkey * 100 + l_linenumber AS line, 'part' AS code FROM lineitem WHERE l_partkey + l_linenumber * 300 NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT l_orderkey * 100 + l_linenumber, 'supplier' FROM lineitem WHERE l_suppkey + l_linenumber NOT IN (SELECT s_suppkey FROM supplier)""")
def ref_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("line"), (F.col("l_partkey") + F.col("l_linenumber") * 300).alias("p"), (F.col("l_suppkey") + F.col("l_linenumber")).alias("s"))
    return Q.missing_references(li, "line", {"part": ("p", table(spark, sf_dir, "part"), "p_partkey"), "supplier": ("s", table(spark, sf_dir, "supplier"), "s_suppkey")})


_DUP = "d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN ' ' ELSE CAST(o_custkey AS VARCHAR) || o_orderpriority END AS k FROM orders)"


@query(f"""WITH {_DUP}, f AS (SELECT k, min(o_orderkey) AS first FROM d WHERE trim(k) <> '' GROUP BY 1)
SELECT o_orderkey, k AS key, first, 'duplicate' AS code FROM d JOIN f USING (k) WHERE o_orderkey > first UNION ALL SELECT o_orderkey, NULL, NULL, 'empty' FROM d WHERE trim(k) = ''""")
def dup_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.when(F.col("o_orderkey") % 50 == 0, " ").otherwise(F.concat("o_custkey", "o_orderpriority"))
    return Q.duplicates(table(spark, sf_dir, "orders").select("o_orderkey", k.alias("k")), "k", "o_orderkey")


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("line"), F.when(k % 11 != 0, F.when(k % 7 == 0, k - 1).otherwise(k)).alias("id"), F.when(k % 3 != 0, F.col("c_acctbal") + 1).cast("string").alias("balance"), F.when(k % 4 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment")
    )


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").filter(k % 2 == 0).select(k.alias("id"), F.col("c_acctbal").alias("balance"), F.lower("c_mktsegment").alias("segment"), F.lit("seed").alias("import_id"), F.lit(1).alias("version"))


_BATCH = """b AS (SELECT c_custkey AS line, CASE WHEN c_custkey % 11 <> 0 THEN CASE WHEN c_custkey % 7 = 0 THEN c_custkey - 1 ELSE c_custkey END END AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal + 1 END AS balance,
  CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS segment FROM customer), f AS (SELECT id AS fid, min(line) AS first FROM b GROUP BY 1),
t AS (SELECT c_custkey AS id, c_acctbal AS balance, lower(c_mktsegment) AS segment, 'seed' AS import_id, 1 AS version FROM customer WHERE c_custkey % 2 = 0),
v AS (SELECT b.*, concat_ws(',', CASE WHEN balance < 0 THEN 'negative' END, CASE WHEN id IS NULL THEN 'required' END, CASE WHEN line > first THEN 'repeated_in_file' END) AS errors, id IN (SELECT id FROM t) AS known FROM b LEFT JOIN f ON fid = id),
a AS (SELECT *, CASE WHEN errors <> '' THEN 'reject' WHEN known THEN 'update' ELSE 'insert' END AS action FROM v)"""
_NEGATIVE = "negative"


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.validate_batch(_batch(spark, sf_dir), "line", "id", [Rule(_NEGATIVE, "error", F.col("balance").try_cast("double") < 0)], _table(spark, sf_dir), "update")


@query(f"WITH {_BATCH} SELECT line, action, errors FROM a")
def reject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).select("line", "action", F.array_join("errors", ",").alias("errors"))


@query(f"""WITH {_BATCH}, n AS (SELECT * FROM a WHERE action <> 'reject') SELECT coalesce(t.id, n.id) AS id, round(coalesce(n.balance, t.balance), 2) AS balance, coalesce(n.segment, t.segment) AS segment,
  CASE WHEN n.line IS NOT NULL THEN 'i1' ELSE t.import_id END AS import_id, CAST(CASE WHEN n.line IS NOT NULL THEN coalesce(t.version, 0) + 1 ELSE t.version END AS INTEGER) AS version FROM t FULL JOIN n ON t.id = n.id""")
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.upsert(_table(spark, sf_dir), _validated(spark, sf_dir), "id", ["balance", "segment"], "i1").withColumn("balance", F.round("balance", 2))


@query(f"""WITH {_BATCH}, n AS (SELECT * FROM a WHERE action <> 'reject') SELECT coalesce(t.id, n.id) AS id, CASE WHEN n.line IS NOT NULL THEN 'edited_later' ELSE 'untouched' END AS reason FROM t LEFT JOIN n ON t.id = n.id""")
def undo_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = Q.upsert(_table(spark, sf_dir), _validated(spark, sf_dir), "id", ["balance", "segment"], "i1")
    left, kept = Q.undo(after, "i1")
    return left.join(kept.select("id", "reason"), "id", "left").select("id", F.coalesce("reason", F.lit("untouched")).alias("reason"))


@query(f"""WITH {_BATCH}, n AS (SELECT * FROM a WHERE action = 'update'), j AS (SELECT t.id, t.segment AS old_s, coalesce(n.segment, t.segment) AS new_s, n.balance IS NOT NULL AS b FROM t JOIN n ON t.id = n.id)
SELECT id, 'segment' AS field FROM j WHERE old_s <> new_s UNION ALL SELECT id, 'balance' FROM j WHERE b""")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _table(spark, sf_dir)
    new = Q.upsert(old, _validated(spark, sf_dir), "id", ["balance", "segment"], "i1")
    return Q.change_log(old, new, "id", ["balance", "segment"]).select("id", "field")


@query("""SELECT c_custkey, 'phone' AS field FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'c_mktsegment' FROM customer WHERE c_mktsegment LIKE 'A%'""")
def research_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("phone", F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise("1")).withColumn("c_mktsegment", F.when(~F.col("c_mktsegment").startswith("A"), F.col("c_mktsegment")))
    return Q.research_queue(c, "c_custkey", ["phone", "c_mktsegment"])


@query("""SELECT c_nationkey % 7 AS key, count(DISTINCT c_mktsegment) AS values FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1""")
def key_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.key_conflicts(table(spark, sf_dir, "customer").withColumn("key", F.col("c_nationkey") % 7), "key", "c_mktsegment")


@query(r"""SELECT doc_id, 'private_key' AS code FROM documents WHERE regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') UNION ALL SELECT doc_id, 'google_key' FROM documents WHERE regexp_matches(text, 'AIza[0-9A-Za-z_-]{35}')
UNION ALL SELECT doc_id, 'github_token' FROM documents WHERE regexp_matches(text, 'gh[pousr]_[A-Za-z0-9]{20,}') UNION ALL SELECT doc_id, 'cloud_key' FROM documents WHERE regexp_matches(text, 'AKIA[0-9A-Z]{16}')
UNION ALL SELECT doc_id, 'assigned' FROM documents WHERE regexp_matches(text, '(?i)(?:token|secret|password|api_key)\s*[=:]\s*["''][^"''\s]{12,}["'']')""")
def credential_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.credential_scan(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""SELECT p_partkey FROM part WHERE (p_brand IN ('Brand#1', 'Brand#23') OR p_type LIKE '%PROMO%' OR p_size BETWEEN 10 AND 20) AND p_retailprice >= 950""")
def search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternatives in one pushed-down filter."""
    p = table(spark, sf_dir, "part")
    return p.filter((F.col("p_brand").isin("Brand#1", "Brand#23") | F.col("p_type").contains("PROMO") | F.col("p_size").between(10, 20)) & (F.col("p_retailprice") >= 950)).select("p_partkey")


@query("""SELECT p_partkey FROM part WHERE concat_ws(' ', p_name, p_brand, p_type) ILIKE '%an%' AND p_size >= 5""")
def text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accent-free search of a term in any visible field."""
    hit = F.exists(F.array(*map(fold, (F.col("p_name"), F.col("p_brand"), F.col("p_type")))), lambda x: x.contains("an"))
    return table(spark, sf_dir, "part").filter(hit & (F.col("p_size") >= 5)).select("p_partkey")


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0)""")
def semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, s = (table(spark, sf_dir, t) for t in ("customer", "orders", "supplier"))
    has = c.join(o.filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return has.join(s.filter("s_suppkey % 3 = 0"), F.col("c_nationkey") == F.col("s_nationkey"), "left_anti").select("c_custkey")


@query("""SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996 INTERSECT SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1998 EXCEPT SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997""")
def id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda y: table(spark, sf_dir, "orders").filter(f"o_orderdate >= '{y}-01-01' and o_orderdate < '{y + 1}-01-01'").select("o_custkey").distinct()
    return of(1996).intersect(of(1998)).subtract(of(1997))


@query("""SELECT c_custkey FROM customer ORDER BY CASE WHEN c_custkey % 5 = 0 THEN 2 WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 2 = 0 THEN c_acctbal END, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 2 = 1 THEN lower(c_mktsegment) END, c_custkey LIMIT 20 OFFSET 40""")
def paginated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 20 in mixed order: numbers, texts, blanks."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 5 == 0, "").when(k % 2 == 0, F.col("c_acctbal").cast("string")).otherwise(F.col("c_mktsegment")).alias("cell"))
    return Q.paginated(c, Q.mixed_order("cell", "c_custkey"), 3, 20).select("c_custkey")


@query("""SELECT c_nationkey, c_mktsegment, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) ORDER BY n DESC, c_nationkey, c_mktsegment LIMIT 8""")
def top_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc_nulls_last("n"), "c_nationkey", "c_mktsegment").limit(8)


@query("""WITH l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderdate AS DATE) END AS checked, o_orderstatus FROM orders)
SELECT o_orderkey FROM l WHERE (checked IS NULL OR CASE WHEN o_orderstatus = 'F' THEN date_diff('day', checked, DATE '1998-06-30') >= 7 ELSE date_diff('day', checked, DATE '1998-06-30') >= 1 END) AND o_orderkey % 4 <> 0""")
def due_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, F.to_date("o_orderdate")).alias("checked"), F.when(F.col("o_orderstatus") == "F", "inactive").otherwise("active").alias("status"))
    return Q.due(o, F.lit("1998-06-30").cast("date"), "checked", "status", F.col("o_orderkey") % 4 != 0, "o_orderkey").select("o_orderkey")


@query("""SELECT n_nationkey, c.name AS other FROM nation JOIN (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN n_name || ' X' ELSE lower(n_name) END AS name FROM nation) c ON k = n_nationkey
WHERE regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g') <> regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g')""")
def name_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    other = n.select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 4 == 0, F.concat("n_name", F.lit(" X"))).otherwise(F.lower("n_name")).alias("other"))
    return n.join(other, F.col("k") == F.col("n_nationkey")).filter(slug(F.col("n_name")) != slug(F.col("other"))).select("n_nationkey", "other")
