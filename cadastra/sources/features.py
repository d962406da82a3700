"""Feature collections in and out: simple geometries, regions, grid editions, road edges, canonical lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions import geometry as G
from cadastra.functions.scalar import filled
from cadastra.sources.collections import scan_elements

_GEOMETRY = "struct<type:string,coordinates:string,geometries:array<struct<type:string,coordinates:string>>>"
_POINTS = "array<array<double>>"


def _points(line: Column) -> Column:
    return F.transform(line, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))


def read_geometries(spark: SparkSession, path: str, properties: str, name: Sequence[str] = ("nome", "name", "Name", "NOME"), split: int | None = None) -> DataFrame:
    """One row a simple geometry of a FeatureCollection or a Feature, with the fields of ``properties`` (a struct type).

    A GeometryCollection gives a row for each of its geometries, a MultiPolygon all its ``polygons`` in one.
    ``name`` is the first filled of the given properties. Columns ``kind``, ``point``, ``line`` and
    ``polygons`` (each an array of rings) hold the geometry, NULL for other kinds; a feature without one is
    left out. With ``split`` a FeatureCollection, a file or a folder of its parts, is read in ranges of so many
    bytes, one a task; without it a file is one task's.
    """
    schema = f"type string, id string, properties {properties}, geometry {_GEOMETRY}, features array<struct<id:string,properties:{properties},geometry:{_GEOMETRY}>>"
    read = spark.createDataFrame([], schema) if split else spark.read.schema(schema).json(path, multiLine=True)
    each = F.when(F.col("type") == "FeatureCollection", F.col("features")).when(F.col("type") == "Feature", F.array(F.struct("id", "properties", "geometry")))
    rows = read.select(F.explode(each).alias("f")) if split is None else scan_elements(spark, path, "features", split).select(F.from_json("element", f"struct<id:string,properties:{properties},geometry:{_GEOMETRY}>").alias("f"))
    rows = rows.filter("f.geometry is not null")
    simple = F.when(F.col("f.geometry.type") == "GeometryCollection", F.col("f.geometry.geometries")).otherwise(F.array(F.struct(F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"))))
    rows = rows.select("f", F.explode(simple).alias("g"))
    of = lambda kind, shape: F.when(F.col("g.type") == kind, F.from_json("g.coordinates", shape))
    rings = lambda polygon: F.transform(polygon, _points)
    polygons = F.when(F.col("g.type") == "Polygon", F.array(rings(of("Polygon", f"array<{_POINTS}>")))).when(F.col("g.type") == "MultiPolygon", F.transform(of("MultiPolygon", f"array<array<{_POINTS}>>"), rings))
    fields = [f.name for f in read.schema["properties"].dataType.fields]
    known = [F.col(f"f.properties.{n}") for n in name if n in fields]
    named = F.coalesce(*(filled(c) for c in known)) if known else F.lit(None).cast("string")
    point = F.when(F.col("g.type") == "Point", _points(F.array(of("Point", "array<double>")))[0])
    return rows.select(F.col("f.id").alias("feature_id"), named.alias("feature_name"), "f.properties.*", F.col("g.type").alias("kind"), point.alias("point"), _points(of("LineString", _POINTS)).alias("line"), polygons.alias("polygons"))


def polygons_box(polygons: Column) -> Column:
    """Box of all rings of all polygons: struct(west, south, east, north)."""
    return G.bbox(F.flatten(F.flatten(polygons)))


def box_union(df: DataFrame, box: str) -> DataFrame:
    """One row: the box of all boxes."""
    part = lambda f, c: f(F.col(f"{box}.{c}")).alias(c)
    return df.agg(part(F.min, "west"), part(F.min, "south"), part(F.max, "east"), part(F.max, "north"))


def polygons_area_km2(polygons: Column) -> Column:
    """Area of all polygons, each without its holes."""
    return F.aggregate(F.transform(polygons, G.polygon_area_km2), F.lit(0.0), lambda s, a: s + a)


def read_regions(spark: SparkSession, path: str, number: str, code: str, name: str, area: str, split: int | None = None) -> DataFrame:
    """``number, code, name, area, polygons, box`` of every region; a feature that is no polygon or has a bad number fails."""
    properties = f"struct<{','.join(f'{c}:string' for c in dict.fromkeys((number, code, name, area)))}>"
    rows = read_geometries(spark, path, properties, (), split)
    n = F.col(number).try_cast("double").cast("int")
    shown = F.concat(F.lit("region without a polygon or a number: "), F.coalesce(F.col(number), F.lit("null")), F.lit(" "), F.coalesce("kind", F.lit("null")))
    good = F.when(F.col("kind").isin("Polygon", "MultiPolygon") & n.isNotNull(), n).otherwise(F.raise_error(shown).cast("int"))
    return rows.select(good.alias("number"), F.coalesce(code, F.lit("")).alias("code"), F.coalesce(name, F.lit("")).alias("name"), F.col(area).try_cast("double").alias("area"), "polygons", polygons_box(F.col("polygons")).alias("box"))


def read_grid(spark: SparkSession, path: str, roles: Mapping[str, str], split: int | None = None) -> DataFrame:
    """Cells of one edition: ``cell_id, parent_1km, pop, dom_ocu, suppressed, polygons`` by the columns of its ``roles``.

    A declared column that no feature has is an error that names what was found. A count that is there
    but can't be read, such as ``X``, is suppressed: NULL, and the cell is marked.
    """
    shape = "struct<properties:map<string,string>>"
    each = scan_elements(spark, path, "features", split).select(F.from_json("element", shape).alias("f")) if split else spark.read.schema(f"features array<{shape}>").json(path, multiLine=True).select(F.explode("features").alias("f"))
    keys = each.select(F.explode(F.map_keys("f.properties")).alias("k")).distinct()
    found = sorted(r["k"] for r in keys.collect())  # names of columns
    if found and (missing := sorted(set(roles.values()) - set(found))):
        raise ValueError(f"missing columns {missing}; found {found}")
    rows = read_geometries(spark, path, f"struct<{','.join(f'`{c}`:string' for c in dict.fromkeys(roles.values()))}>", (), split)
    text = lambda role: filled(F.col(f"`{roles[role]}`"))
    count = lambda role: F.when(text(role).try_cast("double") >= 0, F.rint(text(role).try_cast("double")).cast("long"))
    hidden = lambda role: text(role).isNotNull() & count(role).isNull()
    return rows.select(text("cell_id").alias("cell_id"), text("parent_1km").alias("parent_1km"), count("pop").alias("pop"), count("dom_ocu").alias("dom_ocu"), (hidden("pop") | hidden("dom_ocu")).alias("suppressed"), "polygons")


def read_roads(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """``u, v, key, osmid, name, highway, oneway, length_m, coords`` of a graph's edges; an absent length follows from the coordinates."""
    edge = f"struct<u:string,v:string,key:int,osmid:array<long>,name:string,highway:string,oneway:boolean,length_m:double,coords:{_POINTS}>"
    each = scan_elements(spark, path, "edges", split).select(F.from_json("element", edge).alias("e")) if split else spark.read.schema(f"edges array<{edge}>").json(path, multiLine=True).select(F.explode("edges").alias("e"))
    rows = each.select("e.*")
    rows = rows.withColumn("coords", _points(F.col("coords")))
    return rows.select(
        "u", "v", F.coalesce("key", F.lit(0)).alias("key"), F.coalesce("osmid", F.array().cast("array<bigint>")).alias("osmid"), "name", F.coalesce("highway", F.lit("unclassified")).alias("highway"), F.coalesce("oneway", F.lit(False)).alias("oneway"),
        F.coalesce(F.when(F.col("length_m") != 0, F.col("length_m")), 1000 * G.length_km(F.col("coords"))).alias("length_m"), "coords",
    )


def published(spark: SparkSession, root: str, dataset: str, role: str) -> DataFrame:
    """A published layer, read back by its dataset and role from ``root``, partitioned by both."""
    return spark.read.option("basePath", root).parquet(f"{root}/dataset={dataset}/role={role}")


def publish(df: DataFrame, root: str, dataset: str, role: str) -> None:
    """Replace one layer of ``root`` and leave the others."""
    df.write.mode("overwrite").parquet(f"{root}/dataset={dataset}/role={role}")


def write_lines(lines: DataFrame, path: str) -> DataFrame:
    """Write ``id, json`` in order of id as text, a feature a line; one row of what was written.

    ``features, bytes, checksum``: the checksum is of all lines whatever files they are in, so that equal
    content has an equal one.
    """
    lines.repartitionByRange("id").sortWithinPartitions("id").select("json").write.mode("overwrite").text(path)
    back = lines.sparkSession.read.schema("value string").text(path)
    each = F.sum(F.xxhash64("value").cast("decimal(38,0)"))
    return back.agg(F.count("*").alias("features"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.coalesce(each, F.lit(0)).cast("string")), 256).alias("checksum"))
