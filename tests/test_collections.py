"""Scans that begin anywhere in a file, and the canonical sink."""

from __future__ import annotations

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cadastra.plans.collections import plots
from cadastra.sources import collections as C
from cadastra.sources.features import read_geometries, read_roads

SF = "/root/testdata/sf0.001"


def odd_features(n: int) -> list[dict]:
    rng = random.Random(9)
    strings = ['a"b', "\\", '\\"', "{[", "]}", '"features":[', "é漢🙂", "", "x" * 300, '{"type":"Feature"}', "\\\\\\"]
    out = []
    for i in range(n):
        rings = [[[rng.random(), rng.random()] for _ in range(rng.randrange(3, 9))] for _ in range(rng.randrange(1, 4))]
        nested = {"features": [{"deep": [rng.choice(strings), {"x": []}]}], "s": rng.choice(strings) + rng.choice(strings)}
        out.append({"type": "Feature", "properties": {"k": i, rng.choice(strings) or "e": nested}, "geometry": {"type": "MultiPolygon", "coordinates": [rings, rings[:1]]}})
    return out


@pytest.mark.parametrize(("split", "indent", "ascii_"), [(1, None, True), (7, None, False), (64, 1, True), (1000, None, False), (1 << 20, 2, True)])
def test_ranges_that_begin_anywhere_give_every_feature_once(spark: SparkSession, tmp_path: Path, split: int, indent: int | None, ascii_: bool) -> None:
    features = odd_features(4 if split == 1 else 60)
    whole = {"crs": {"features": [1, {"no": "feature"}]}, "other": [{"features": [{"a": 1}]}, {"b": 2}], "type": "FeatureCollection", "features": features, "after": [{"type": "Feature"}, [{"c": 3}]]}
    path = tmp_path / "whole.json"
    path.write_text(json.dumps(whole, indent=indent, ensure_ascii=ascii_))
    size = path.stat().st_size
    if split == 1:  # each byte a range
        source, key = C.RangeReader({"path": str(path), "key": "features", "split": "1"}), "features"
        assert len(source.partitions()) == size and key
        split = 3
    df = C.scan_elements(spark, str(path), "features", split) if split > 60 else None
    rows = df.collect() if df is not None else scanned_here(str(path), "features", split)
    assert [json.loads(r[1]) for r in sorted(rows)] == features
    if df is not None and split < size:
        assert df.rdd.getNumPartitions() > 1


def scanned_here(path: str, key: str, split: int) -> list[tuple]:
    """What ``scan_elements`` does, without a job for each of very many ranges."""
    first = C.RangeReader({"path": path, "key": key, "split": str(split)})
    told = {(r[0], r[1]): r for p in first.partitions() for r in first.read(p)}
    ranges = C.folded(told, C.Joined(path).size, split)
    second = C.ElementReader({"path": path, "ranges": json.dumps(ranges)})
    return [row for p in second.partitions() for row in second.read(p)]


def test_files_without_the_array_and_empty_ones(spark: SparkSession, tmp_path: Path) -> None:
    for i, text in enumerate(("", "{}", '{"features": []}', '{"other": [{"features": [{"a": 1}]}]}', '{"features": null}')):
        (tmp_path / f"{i}.json").write_text(text)
        assert C.scan_elements(spark, str(tmp_path / f"{i}.json"), "features", 8).count() == 0
    with pytest.raises(FileNotFoundError):
        C.scan_elements(spark, str(tmp_path / "none.json"), "features")


def test_sink_makes_one_valid_file_whatever_the_parts(spark: SparkSession, tmp_path: Path) -> None:
    lines = C.canonical_lines(plots(spark, SF), "id", ["id", "note", "ra"], "polygons")
    found = []
    for parts in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        manifest = C.write_collection(lines, str(tmp_path / parts)).first()
        data = b"".join(p.read_bytes() for p in sorted((tmp_path / parts).glob("part-*")))
        assert (manifest.bytes, manifest.digest, manifest.features) == (len(data), C.digest_of(data), lines.count())
        assert not list((tmp_path / parts).glob("_part-*"))
        found.append(data)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]
    whole = json.loads(found[0])
    assert [f["properties"]["id"] for f in whole["features"]] == sorted(f["properties"]["id"] for f in whole["features"])
    holes = [f for f in whole["features"] if f["properties"]["id"] % 15 == 0]
    assert holes and all(f["geometry"]["type"] == "MultiPolygon" and [len(p) for p in f["geometry"]["coordinates"]] == [2, 1] for f in holes)
    # written again in place, with fewer rows, and with none
    fewer = C.write_collection(lines.filter("id < 10"), str(tmp_path / "5")).first()
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "5").glob("part-*")))
    assert fewer.bytes == len(data) and len(json.loads(data)["features"]) == fewer.features
    none = C.write_collection(lines.limit(0), str(tmp_path / "5")).first()
    assert none.features == 0 and none.west is None
    assert C.scan_elements(spark, str(tmp_path / "5"), "features").count() == 0


def test_digests_join() -> None:
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(30_000))
    for cut in (0, 1, 4095, 4096, 12_345, 30_000):
        left, right = data[:cut], data[cut:]
        assert C.joined((C.digest_of(left), len(left)), (C.digest_of(right), len(right))) == (C.digest_of(data), len(data))


def test_roads_are_read_in_ranges(spark: SparkSession, tmp_path: Path) -> None:
    edges = [{"u": str(i), "v": str(i + 1), "key": 0, "osmid": [i], "name": "{", "highway": "primary", "oneway": False, "length_m": float(i + 1), "coords": [[0.0, 0.0], [0.1, i * 0.1]]} for i in range(50)]
    (tmp_path / "roads.json").write_text(json.dumps({"nodes": [{"id": 1}], "edges": edges}))
    whole, parts = read_roads(spark, str(tmp_path / "roads.json")), read_roads(spark, str(tmp_path / "roads.json"), 500)
    assert parts.rdd.getNumPartitions() > 5
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))


def test_geometries_of_parts_equal_those_of_a_whole(spark: SparkSession, tmp_path: Path) -> None:
    C.write_collection(C.canonical_lines(plots(spark, SF), "id", ["id", "note", "ra"], "polygons"), str(tmp_path / "c"))
    whole = tmp_path / "whole.json"
    whole.write_bytes(b"".join(p.read_bytes() for p in sorted((tmp_path / "c").glob("part-*"))))
    shape = "struct<id:long,note:string,ra:string>"
    of = lambda path, split: sorted(map(str, read_geometries(spark, str(path), shape, (), split).select("id", "note", "kind", F.to_json("polygons")).collect()))
    assert of(whole, None) == of(whole, 3000) == of(tmp_path / "c", 1000)


def test_small_ranges_make_no_more_tasks(spark: SparkSession, tmp_path: Path) -> None:
    path = tmp_path / "many.json"
    path.write_text(json.dumps({"features": [{"id": i, "note": "x" * 50} for i in range(2_000)]}))
    found = C.scan_elements(spark, str(path), "features", split=512)
    assert 1 < found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism + 1
    assert [json.loads(r["element"])["id"] for r in found.orderBy("at").collect()] == list(range(2_000))
