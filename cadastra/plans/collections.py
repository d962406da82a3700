"""Large collections: written by the canonical sink, and read back by scans that split inside the file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions import geometry as G
from cadastra.registry import query, table
from cadastra.session import shared_folder
from cadastra.sources import collections as C
from cadastra.sources.features import polygons_box, read_geometries


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plot for every customer: a square, with a hole for every third one and a second square for every fifth."""
    k = F.col("c_custkey")
    west, south = (k % 97).cast("double") / 4, (k % 53).cast("double") / 4
    square = lambda dx, dy, side: G.square(west + dx, south + dy, side)
    outer = F.when(k % 3 == 0, F.array(square(0.0, 0.0, 2.0), square(0.5, 0.5, 0.5))).otherwise(F.array(square(0.0, 0.0, 2.0)))
    polygons = F.when(k % 5 == 0, F.array(outer, F.array(square(4.0, 0.25, 1.0)))).otherwise(F.array(outer))
    odd = F.concat(F.lit('{"type":"Feature","features":[ \\" ]}, '), F.lit("\\"), "c_name", F.lit('"'))
    return table(spark, sf_dir, "customer").select(k.alias("id"), "c_name", odd.alias("note"), F.col("c_nationkey").cast("string").alias("ra"), polygons.alias("polygons"))


def _written(spark: SparkSession, sf_dir: str, plots_: DataFrame) -> tuple[DataFrame, str]:
    path = f"{shared_folder(spark)}/collection-{uuid.uuid4().hex}"
    return C.write_collection(C.canonical_lines(plots_, "id", ["id", "note", "ra"], "polygons"), path), path


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind, c_nationkey::VARCHAR AS ra,
  '{"type":"Feature","features":[ \\" ]}, ' || '\\' || c_name || '"' AS note,
  CAST(1 + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS rings,
  (c_custkey % 97) / 4.0::DOUBLE AS west, (c_custkey % 53) / 4.0::DOUBLE AS south,
  (c_custkey % 97) / 4.0::DOUBLE + CASE WHEN c_custkey % 5 = 0 THEN 5 ELSE 2 END AS east, (c_custkey % 53) / 4.0::DOUBLE + 2 AS north FROM customer""".replace("\\\\", "\\"))
def collection_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plot for every customer, written as one collection and read back in ranges of 64 kB, which begin anywhere in it."""
    _, path = _written(spark, sf_dir, plots(spark, sf_dir))
    rows = read_geometries(spark, path, "struct<id:long,note:string,ra:string>", (), split=1 << 16)
    box = polygons_box(F.col("polygons"))
    return rows.select("id", "kind", "ra", "note", F.size(F.flatten("polygons")).alias("rings"), *(box[s].alias(s) for s in ("west", "south", "east", "north")))


@query("""WITH s AS (
  SELECT s_suppkey AS id, (s_suppkey % 97) / 4.0::DOUBLE AS w, (s_suppkey % 53) / 4.0::DOUBLE AS y, s_name, s_nationkey FROM supplier
), c AS (
  SELECT id, w, y, '{"type":"Feature","properties":{"id":' || id || ',"ra":"' || s_nationkey || '"},"geometry":{"type":"Polygon","coordinates":[[['
    || w || ',' || y || '],[' || (w + 2) || ',' || y || '],[' || (w + 2) || ',' || (y + 2) || '],[' || w || ',' || (y + 2) || '],[' || w || ',' || y || ']]]}}' AS line FROM s
), whole AS (
  SELECT '{"type":"FeatureCollection","features":[' || chr(10) || string_agg(line, ',' || chr(10) ORDER BY id) || chr(10) || ']}' || chr(10) AS text FROM c
), digest AS (
  SELECT list_reduce(list_prepend(0::BIGINT, list_transform(string_split(text, ''), lambda x: ord(x)::BIGINT)), lambda a, b: (a * 1000003 + b) % 2147483647) AS digest, length(text) AS bytes FROM whole
)
SELECT (SELECT count(*) FROM c) AS features, CAST(bytes AS BIGINT) AS bytes, CAST(digest AS BIGINT) AS digest, (SELECT min(w) FROM c) AS west, (SELECT min(y) FROM c) AS south, (SELECT max(w) + 2 FROM c) AS east, (SELECT max(y) + 2 FROM c) AS north FROM digest""")
def collection_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, bytes, digest and box of a canonical collection of one square a supplier."""
    k = F.col("s_suppkey")
    ring = G.square((k % 97).cast("double") / 4, (k % 53).cast("double") / 4, 2.0)
    rows = table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_nationkey").cast("string").alias("ra"), F.array(F.array(ring)).alias("polygons"))
    path = f"{shared_folder(spark)}/collection-{uuid.uuid4().hex}"
    return C.write_collection(C.canonical_lines(rows, "id", ["id", "ra"], "polygons"), path)
