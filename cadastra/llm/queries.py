"""The registered queries of the training-data operators, one each, and the SQL of those that have one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.bpe import decode, encode
from cadastra.llm.common import table
from cadastra.llm.decontamination import contaminated
from cadastra.llm.fingerprints import edited_fingerprints
from cadastra.llm.hard_negatives import hard_negatives
from cadastra.llm.language_id import fit, predict
from cadastra.llm.line_dedup import drop_recurring_lines
from cadastra.llm.ngram_jaccard import near_duplicates
from cadastra.llm.packing import pack
from cadastra.llm.pii import KINDS, find_pii, listed
from cadastra.llm.prefix_trie import prefix_trie
from cadastra.llm.sharding import shard
from cadastra.llm.substring_dedup import remove_repeats
from cadastra.llm.url_filter import filter_urls


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.filter(~held_out))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    return filter_urls(table(spark, sf_dir, "pages"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), 4, 85, 100)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that lie in documents, also with other numbers or names."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    found = find_pii(table(spark, sf_dir, "documents"))
    secret, four = F.filter("added", lambda s: s["kind"] == "secret"), F.filter("added", lambda s: s["kind"] != "secret")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", four)).alias("spans"), listed(secret).alias("secrets"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document when recurring line templates are dropped."""
    left = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left when every repeated window of 20 words is removed."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose counts differ by one at most."""
    placed = shard(table(spark, sf_dir, "documents"), 40)
    return placed.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector and its positives."""
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, and the ids decoded again."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = decode(encode(table(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_url_filter": op2_url_filter,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_decontamination": op4_decontamination,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_fingerprints": op9_fingerprints,
    "op10_sharding": op10_sharding,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_bpe": op13_bpe,
}

ORACLES: dict[str, str] = {
    "op3_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [len(ws) || ' ' || array_to_string(ws, ' ')] ELSE [] END) AS g FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), either_way AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(v, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, reached.c FROM reached JOIN either_way e ON e.a = reached.v WHERE reached.c < e.b
)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id FROM documents LEFT JOIN sizes USING (doc_id) JOIN reached ON v = doc_id GROUP BY doc_id
""",
    "op8_substring_dedup": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, greatest(len(ws) - 19, 0) + 1)) AS i,
         unnest(list_transform(range(1, greatest(len(ws) - 19, 0) + 1), lambda i: md5(array_to_string(ws[i:i + 19], ' ')))) AS k
  FROM words
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1
), covered AS (
  SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM repeated) GROUP BY doc_id
), kept AS (
  SELECT doc_id, ws, CASE WHEN js IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(js, j)) END AS ks
  FROM words LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - len(ks) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(ks, ' '), '')) AS kept_sha256
FROM kept
""",
    "op11_prefix_trie": r"""
WITH ordered AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), taken AS (  -- unsigned crc32 of the decimal id, bit by bit, modulo 6
  SELECT conv_id, own, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, x:
    list_reduce(list_prepend(xor(c, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END)), 4294967295::BIGINT) % 6 AS BIGINT) AS h
  FROM ordered
), rebuilt AS (
  SELECT t.conv_id, coalesce(b.own, [])[1:h] || t.own[h + 1:] AS turns FROM taken t LEFT JOIN ordered b ON b.conv_id = t.conv_id - t.conv_id % 100
), steps AS (
  SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt
), nodes AS (
  SELECT depth, turns[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN len(turns) = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256,
         CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * length(any_value(turns[depth].text)) END AS saved
  FROM steps GROUP BY 1, 2
), children AS (
  SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2
), subtrees AS (
  SELECT up AS depth, path[1:up] AS path, sum(saved) AS saved, count(*) FILTER (n IS NULL) AS leaves
  FROM (SELECT nodes.*, n, unnest(range(0, nodes.depth + 1)) AS up FROM nodes LEFT JOIN children ON children.depth = nodes.depth AND children.path = nodes.path) GROUP BY 1, 2
)
SELECT CAST(x.conv_id AS BIGINT) AS conv_id, CAST(x.depth AS BIGINT) AS depth, CAST(p.conv_id AS BIGINT) AS parent_conv_id, CAST(x.n_convs AS BIGINT) AS n_convs,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, x.ends_sha256
FROM nodes x JOIN subtrees s ON s.depth = x.depth AND s.path = x.path LEFT JOIN children c ON c.depth = x.depth AND c.path = x.path
LEFT JOIN nodes p ON x.depth > 0 AND p.depth = x.depth - 1 AND p.path = x.path[1:x.depth - 1]
""",
    "op12_hard_negatives": r"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), mined AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM mined WHERE rank <= 10
""",
}
