"""Files in and out: delimited text, feature collections, sharded and canonical output, catalogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadastra.functions.scalar import guarded, unguarded

#: What counts as absent in delimited files.
ABSENT = ("", "NA", "NaN", "null")


def read_csv(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """All columns as text: separator found in the header if not given, quotes, BOM, spreadsheet guard taken off."""
    if separator is None:
        head = spark.read.text(path).first()
        line = head[0] if head else ""
        separator = max((";", "\t", ","), key=line.count)
    rows = spark.read.csv(path, sep=separator, header=True, quote='"', escape='"', multiLine=True)
    names = [c.replace(chr(0xFEFF), "").strip() for c in rows.columns]
    rows = rows.toDF(*names)
    return rows.select(*(unguarded(F.col(f"`{c}`")).alias(c) for c in names))


def write_csv(df: DataFrame, path: str) -> None:
    """``;`` between cells, a byte order mark before the header, text cells guarded against being read as formulas."""
    cells = [guarded(F.col(c)).alias(c) if isinstance(t.dataType, T.StringType) else F.col(c) for c, t in zip(df.columns, df.schema.fields, strict=True)]
    marked = df.select(*cells)
    marked = marked.withColumnRenamed(marked.columns[0], chr(0xFEFF) + marked.columns[0])
    marked.write.mode("overwrite").csv(path, sep=";", header=True, quote='"', escape='"')


def clean(text: Column) -> Column:
    """Trimmed, NULL for what counts as absent."""
    t = F.trim(text)
    return F.when(~t.isin(*ABSENT), t)


def count_or_null(text: Column) -> Column:
    """A count; NULL where absent or negative."""
    n = clean(text).try_cast("double")
    return F.when(n >= 0, F.rint(n).cast("long"))


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The frame itself, or an error that names the columns found."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, list[str]]:
    """A table with its declared schema; a missing one is empty, with a warning."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(schema).parquet(path), []
    return spark.createDataFrame([], schema), [f"{path}: missing"]


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """``properties`` (a struct type) and outer rings of every polygon of a feature collection."""
    point = "array<double>"
    schema = f"features array<struct<properties:{properties},geometry:struct<type:string,coordinates:array<array<{point}>>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    ring = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    return rows.select("f.properties.*", F.col("f.geometry.type").alias("kind"), F.transform("f.geometry.coordinates", ring).alias("rings"))


def feature_lines(df: DataFrame, ident: str, properties: Sequence[str], ring: str, digits: int = 6) -> DataFrame:
    """One canonical JSON feature a row: rounded coordinates, properties in order of their names."""
    coordinates = F.transform(F.col(ring), lambda p: F.array(F.bround(p["lon"], digits), F.bround(p["lat"], digits)))
    geometry = F.struct(F.array(coordinates).alias("coordinates"), F.lit("Polygon").alias("type"))
    return df.select(F.col(ident).alias("id"), F.to_json(F.struct(geometry.alias("geometry"), F.struct(*sorted(properties)).alias("properties"), F.lit("Feature").alias("type"))).alias("json"))


def write_sharded(df: DataFrame, path: str, region: str) -> None:
    """A folder a region, ``SEM_RA`` for none; regions that are gone go."""
    df.withColumn(region, F.coalesce(region, F.lit("SEM_RA"))).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(region).parquet(path)


def catalogue(files: DataFrame, previous: DataFrame) -> DataFrame:
    """Content hash of each dataset from its files' ``dataset, path, sha``; the version grows if it changed.

    Files are hashed in 4096 buckets by the hash of their path, and then the buckets, so that no task holds
    all files of a dataset.
    """
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    bucket = files.groupBy("dataset", F.substring(F.sha2("path", 256), 1, 3).alias("bucket")).agg(joined(F.concat_ws(":", "path", "sha")).alias("h"), F.sum("bytes").alias("bytes"), F.count("*").alias("files"))
    now = bucket.groupBy("dataset").agg(joined(F.concat_ws(":", "bucket", "h")).alias("hash"), F.sum("bytes").alias("bytes"), F.sum("files").alias("files"))
    old = previous.select("dataset", F.col("hash").alias("old"), F.col("version").alias("v"))
    version = F.when(F.col("old").isNull(), 1).when(F.col("old") == F.col("hash"), F.col("v")).otherwise(F.col("v") + 1)
    return now.join(old, "dataset", "left").select("dataset", "hash", "bytes", "files", version.alias("version"))
