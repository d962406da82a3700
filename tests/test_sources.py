"""Feature collections, grids, roads, canonical lines and monthly partitions on small files."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cadastra.operators import coverage, records
from cadastra.sources import features, files

SQUARE = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
HOLE = [[0.5, 0.5], [1.5, 0.5], [1.5, 1.5], [0.5, 1.5], [0.5, 0.5]]


def feature(properties: dict, geometry: dict | None) -> dict:
    return {"type": "Feature", "id": "f", "properties": properties, "geometry": geometry}


def save(path: Path, payload: dict) -> str:
    path.write_text(json.dumps(payload))
    return str(path)


def test_geometries_are_flattened(spark: SparkSession, tmp_path: Path) -> None:
    collection = [
        feature({"nome": " ", "name": "A"}, {"type": "Polygon", "coordinates": [*SQUARE, HOLE]}), feature({"nome": "B"}, {"type": "MultiPolygon", "coordinates": [SQUARE, [[[5, 5], [6, 5], [6, 7], [5, 5]]]]}),
        feature({"nome": "C"}, {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}, {"type": "LineString", "coordinates": [[0, 0], [3, 4]]}]}), feature({"nome": "D"}, None),
    ]
    path = save(tmp_path / "f.json", {"type": "FeatureCollection", "features": collection})
    rows = features.read_geometries(spark, path, "struct<nome:string,name:string>").select("*", features.polygons_box(F.col("polygons")).alias("box"), features.polygons_area_km2(F.col("polygons")).alias("km2")).orderBy("feature_name", "kind").collect()
    assert [(r["feature_name"], r["kind"]) for r in rows] == [("A", "Polygon"), ("B", "MultiPolygon"), ("C", "LineString"), ("C", "Point")]
    assert (rows[3]["point"].asDict(), rows[2]["line"][1].asDict()) == ({"lon": 1.0, "lat": 2.0}, {"lon": 3.0, "lat": 4.0})
    assert tuple(rows[1]["box"]) == (0.0, 0.0, 6.0, 7.0)
    assert rows[0]["km2"] == pytest.approx(3 * 111.19**2, rel=0.01)
    one = save(tmp_path / "one.json", feature({"nome": "E"}, {"type": "Point", "coordinates": [1, 2]}))
    assert features.read_geometries(spark, one, "struct<nome:string>").count() == 1


def test_regions_fail_without_a_polygon_or_number(spark: SparkSession, tmp_path: Path) -> None:
    good = feature({"n": "7.0", "c": "RA-VII", "name": "X", "km2": "4.5"}, {"type": "Polygon", "coordinates": SQUARE})
    read = lambda path: features.read_regions(spark, path, "n", "c", "name", "km2")
    row = read(save(tmp_path / "g.json", {"type": "FeatureCollection", "features": [good]})).first()
    assert (row["number"], row["code"], row["area"], row["box"]["east"]) == (7, "RA-VII", 4.5, 2.0)
    for i, bad in enumerate((feature({"n": "x"}, good["geometry"]), feature({"n": "3"}, {"type": "Point", "coordinates": [0, 0]}))):
        with pytest.raises(Exception, match="region without"):
            read(save(tmp_path / f"b{i}.json", {"type": "FeatureCollection", "features": [good, bad]})).collect()


def test_grid_editions_by_roles(spark: SparkSession, tmp_path: Path) -> None:
    cells = [feature({"ID": f"200M{i}", "P1": "" if i else "1KM0", "POP": pop, "DOM": "2"}, {"type": "Polygon", "coordinates": SQUARE}) for i, pop in enumerate(["3", "X", None])]
    path = save(tmp_path / "grid.json", {"type": "FeatureCollection", "features": cells})
    roles = {"cell_id": "ID", "parent_1km": "P1", "pop": "POP", "dom_ocu": "DOM"}
    got = [(r["cell_id"], r["parent_1km"], r["pop"], r["dom_ocu"], r["suppressed"]) for r in features.read_grid(spark, path, roles).orderBy("cell_id").collect()]
    assert got == [("200M0", "1KM0", 3, 2, False), ("200M1", None, None, 2, True), ("200M2", None, None, 2, False)]
    with pytest.raises(ValueError, match="found .*POP"):
        features.read_grid(spark, path, roles | {"pop": "PEOPLE"})


def test_roads_without_a_length(spark: SparkSession, tmp_path: Path) -> None:
    edges = [{"u": 1, "v": 2, "coords": [[0, 0], [0, 1]]}, {"u": 2, "v": 3, "key": 4, "osmid": [9], "oneway": True, "highway": "trunk", "length_m": 5.5, "coords": [[0, 0], [0, 1]]}]
    a, b = features.read_roads(spark, save(tmp_path / "r.json", {"edges": edges})).orderBy("u").collect()
    assert (a["length_m"], a["key"], a["osmid"], a["highway"], a["oneway"]) == (pytest.approx(111_195, rel=1e-3), 0, [], "unclassified", False)
    assert (b["length_m"], b["key"], b["osmid"], b["oneway"]) == (5.5, 4, [9], True)


def test_lines_in_order_with_a_checksum(spark: SparkSession, tmp_path: Path) -> None:
    ring = [{"lon": 0.12345678, "lat": 1.0}, {"lon": 2.0, "lat": 1.0}, {"lon": 0.12345678, "lat": 1.0}]
    df = spark.createDataFrame([(f"id{i}", i, ring) for i in range(20)], "id string, n int, ring array<struct<lon:double,lat:double>>")
    lines = files.feature_lines(df, "id", ["n"], "ring")
    a, b = (features.write_lines(lines.repartition(n), str(tmp_path / f"l{n}")).first() for n in (2, 5))
    assert (a["features"], a["checksum"], a["bytes"]) == (20, b["checksum"], b["bytes"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "l2").glob("part-*")))
    assert len(text.encode()) == a["bytes"]
    assert [json.loads(x)["properties"]["n"] for x in text.splitlines()] == [int(i[2:]) for i in sorted(f"id{i}" for i in range(20))]
    assert json.loads(text.splitlines()[0])["geometry"]["coordinates"][0][0] == [0.123457, 1.0]
    features.publish(df.select("n"), str(tmp_path / "pub"), "d", "detail")
    features.publish(df.limit(1).select("n"), str(tmp_path / "pub"), "d", "overview")
    assert (features.published(spark, str(tmp_path / "pub"), "d", "detail").count(), features.published(spark, str(tmp_path / "pub"), "d", "overview").columns) == (20, ["n", "dataset", "role"])


def test_months_are_closed_by_a_stream(spark: SparkSession, tmp_path: Path) -> None:
    schema = "id long, seen long, status string, reference_month string"
    arrive = lambda rows, i: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in" / str(i)))
    arrive([(1, 1, "active", "2024-01"), (2, 1, "active", "2024-01"), (1, 1, "active", "2023-12")], 0)
    close = lambda: coverage.close_months(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    close()
    arrive([(1, 2, "inactive", "2024-01"), (3, 2, "active", "2024-02")], 1)
    close()
    got = sorted(map(tuple, spark.read.schema(schema).parquet(str(tmp_path / "out")).select("reference_month", "id", "status").collect()))
    assert got == [("2023-12", 1, "active"), ("2024-01", 1, "inactive"), ("2024-01", 2, "active"), ("2024-02", 3, "active")]


def test_a_closed_month_has_few_files(spark: SparkSession, tmp_path: Path) -> None:
    rows = spark.range(400).selectExpr("id", "concat('2024-0', 1 + id % 3) AS reference_month").repartition(8)
    coverage.close_month(rows, str(tmp_path / "out"))
    assert [len(list(d.glob("part-*"))) for d in sorted((tmp_path / "out").glob("reference_month=*"))] == [1, 1, 1]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400


def test_column_roles() -> None:
    names = ["sold", "sold_ytd", "sold_calc", "sold_diff_pct", "sold_yoy_pp", "rent_mom", "note", "extra"]
    assert list(records.roles(names, ["sold"], ["note"]).values()) == ["metric", "ytd", "check", "check", "variation", "undeclared", "metadata", "unknown"]
