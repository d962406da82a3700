"""Percentiles, ranks and pages by ranges, regions by tiles of bounded counts, typed attributes, checks in any order."""

from __future__ import annotations

import random
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cadastra.functions import geometry as G
from cadastra.operators import attributes as A
from cadastra.operators import lifecycle, quadtree, selection
from cadastra.streaming.lifecycle import STORE, Lifecycle, lifecycle_unordered


def numbers(spark: SparkSession):
    rng = random.Random(8)
    rows = [(1, float(rng.randrange(4000))) for _ in range(3000)] + [(2, 5.0)] * 200 + [(None, float(i)) for i in range(7)] + [(3, None), (4, 1.5), (5, -1.0), (5, 2.0)]
    return spark.createDataFrame(rows, "g long, v double")


@pytest.mark.parametrize("rows", [60, 100_000])
def test_percentiles_of_groups_equal_the_exact_ones(spark: SparkSession, rows: int) -> None:
    df = numbers(spark)
    at, names = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0), ("a", "b", "c", "d", "e", "f")
    got = selection.with_percentiles(df.groupBy("g").agg(F.count("*").alias("n")), df, ["g"], F.col("v"), at, names, rows).drop("n")
    want = df.groupBy("g").agg(*(F.percentile("v", p).alias(n) for p, n in zip(at, names, strict=True)))
    of = lambda x: sorted([tuple(None if c is None else round(c, 9) for c in r) for r in x.collect()], key=str)
    assert of(got) == of(want)
    one = selection.group_percentiles(df, [], F.col("v"), (0.5,), ("m",), rows).first().m
    assert one == df.agg(F.percentile("v", 0.5)).first()[0]


@pytest.mark.parametrize("rows", [60, 100_000])
def test_ranks_of_groups(spark: SparkSession, rows: int) -> None:
    df = numbers(spark)
    local: dict = {}
    for r in df.filter("v is not null").collect():
        local.setdefault(r.g, []).append(r.v)
    for r in selection.group_ranks(df, ["g"], "v", rows).collect():
        own = local[r.g]
        assert (r.below, r.same, r.of) == (sum(x < r.v for x in own), own.count(r.v), len(own))
    assert selection.group_ranks(df, ["g"], "v", rows).count() == sum(map(len, local.values()))


@pytest.mark.parametrize("ranges", [4, 200])
def test_pages_by_rank(spark: SparkSession, ranges: int) -> None:
    rng = random.Random(5)
    rows = [(i, rng.choice([None, rng.randrange(30)]), rng.choice(["a", "b", None])) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, n long, t string")
    order = sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), (r[2] is not None, r[2] or ""), r[0]))
    for number in (1, 2, 17, 45, 46, 999, 0, -3):
        page = [r.k for r in selection.page(df, [F.col("n"), F.col("t"), F.col("k")], number, 20, ranges).collect()]
        at = (min(max(1, number), 45) - 1) * 20
        assert page == [r[0] for r in order[at : at + 20]], number
    assert selection.page(df.limit(0), [F.col("k")], 3, 20, ranges).count() == 0


def test_no_part_of_a_tile_is_over_the_bound(spark: SparkSession) -> None:
    rng = random.Random(6)
    rows = [(i, (1.25, 2.5)) for i in range(3000)] + [(3000 + i, (rng.random() * 5, rng.random() * 5)) for i in range(2000)] + [(9000, None), (9001, (179.9, -90.0)), (9002, (500.0, 500.0))]
    points = spark.createDataFrame(rows, "k long, point struct<lon:double,lat:double>")
    squares = [(n, float(n % 5), float(n // 5)) for n in range(25)]
    regions = spark.createDataFrame(squares, "region_no int, w double, s double").select("region_no", F.array(G.square(F.col("w"), F.col("s"), 1.0)).alias("rings"))
    got = {r.k: r.region_no for r in quadtree.assign_by_density(points, regions, "k", bound=100).collect()}
    assert len(got) == len(rows)
    for k, p in rows:
        inside = [n for n, w, s in squares if p and w <= p[0] <= w + 1 and s <= p[1] <= s + 1]
        assert got[k] == (min(inside) if inside else None), (k, p)
    cells = points.filter("point is not null").select(quadtree._cell(F.col("point.lon"), quadtree.WEST).alias("cx"), quadtree._cell(F.col("point.lat"), quadtree.SOUTH).alias("cy")).groupBy("cx", "cy").agg(F.count("*").alias("n"))
    tiles = quadtree.leaves(cells, 0, 100).select("depth", "x", "y", "n").distinct().collect()
    assert sum(t.n for t in tiles) == 5002
    assert all(t.n <= 100 or t.depth == quadtree.DEPTH for t in tiles)
    assert quadtree.assign_by_density(points.limit(0), regions, "k").count() == 0


def test_typed_attributes_name_what_they_reject(spark: SparkSession) -> None:
    defined = [("area", "number", "m2", None), ("rooms", "integer", None, None), ("pets", "flag", None, None), ("since", "date", None, None), ("view", "option", None, ["Sea", "Park"]), ("note", "text", None, None), ("twice", "text", None, None), ("twice", "number", None, None), ("odd", "colour", None, None)]
    given = [("area", "1.234,5 m2"), ("area", "big"), ("rooms", "3"), ("rooms", "3,5"), ("pets", "sim"), ("pets", "hm"), ("since", "2024-02-29"), ("since", "2023-02-29"), ("view", "PARK"), ("view", "lake"), ("note", 'say "hi"\n'), ("twice", "x"), ("odd", "x"), ("none", "x"), ("note", " "), ("note", None)]
    values = spark.createDataFrame([(i, a, v) for i, (a, v) in enumerate(given)], "ident long, attribute string, value string")
    got = {r.ident: (r.v, r.reason) for r in A.typed(values, spark.createDataFrame(defined, "attribute string, kind string, unit string, options array<string>")).select("ident", F.to_json("value").alias("v"), "reason").collect()}
    good = {0: "1234.5", 2: "3", 4: "true", 6: '"2024-02-29"', 8: '"Park"', 10: '"say \\"hi\\"\\n"'}
    bad = {1: "not_a_number", 3: "not_an_integer", 5: "not_a_flag", 7: "not_a_date", 9: "not_an_option", 11: "ambiguous_attribute", 12: "unknown_kind", 13: "unknown_attribute"}
    assert got == {**{i: (v, None) for i, v in good.items()}, **{i: (None, r) for i, r in bad.items()}}


def test_deflation_stops_at_a_missing_year(spark: SparkSession) -> None:
    panel = spark.createDataFrame([("a", y, 100.0) for y in range(2000, 2008)] + [("b", 2003, 50.0), ("b", 2004, 50.0)], "s string, y int, v double")
    rates = spark.createDataFrame([("a", y, 0.1) for y in (2001, 2002, 2003, 2004, 2006)], "s string, y int, rate double")
    got = {(r.s, r.y): r.real and round(r.real, 6) for r in A.deflated(panel, rates, "s", "y", "v", 2003).collect()}
    assert got == {("a", 2000): 133.1, ("a", 2001): 121.0, ("a", 2002): 110.0, ("a", 2003): 100.0, ("a", 2004): 90.909091, ("a", 2005): None, ("a", 2006): None, ("a", 2007): None, ("b", 2003): 50.0, ("b", 2004): None}


def test_listings_that_wait_together_have_one_timer_a_batch() -> None:
    class State:
        held: list | tuple | None = None

        def exists(self) -> bool:
            return self.held is not None

        def get(self):
            return self.held

        def put(self, value) -> None:
            self.held = value

        update = put

        def appendList(self, rows: list) -> None:  # noqa: N802
            self.held = [*(self.held or []), *rows]

        def clear(self) -> None:
            self.held = None

        def getValue(self, key: tuple):  # noqa: N802
            return (self.held or {}).get(key)

        def updateValue(self, key: tuple, value: tuple) -> None:  # noqa: N802
            self.held = {**(self.held or {}), key: value}

    class Handle:
        def __init__(self) -> None:
            self.timers: list[int] = []
            self.registerTimer = self.timers.append
            self.getListState = self.getMapState = lambda *_: State()

    class Now:
        def __init__(self, ms: int) -> None:
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    handle, lifecycle_of = Handle(), Lifecycle()
    lifecycle_of.init(handle)
    days = [0, 40, 1, 2, 3, 41]  # gone on four days, seen again on a later one
    rows = pd.DataFrame({"listing": [7] * len(days), "us": [(1_000 + d) * 86_400_000_000 for d in days], "seq": days, "outcome": ["ok" if d > 3 else "gone" for d in days], "price": [None] * len(days)})
    list(lifecycle_of.handleInputRows((1,), iter([rows[:3], rows[3:], rows[:5].assign(listing=8)]), Now(0)))
    assert handle.timers == [1_000 * 86_400_000 + 1]
    first = pd.concat(lifecycle_of.handleExpiredTimer((1,), Now(1_010 * 86_400_000), Now(handle.timers[0])))
    assert list(zip(first["listing"], first["event"], strict=True)) == [(7, "deactivated"), (8, "deactivated")] and handle.timers[1:] == [1_040 * 86_400_000 + 1]
    last = pd.concat(lifecycle_of.handleExpiredTimer((1,), Now(1_050 * 86_400_000), Now(handle.timers[1])))
    assert list(zip(last["listing"], last["event"], strict=True)) == [(7, "reactivated"), (8, "reactivated")] and len(handle.timers) == 2


def test_checks_in_any_order_give_the_events_of_the_fold(spark: SparkSession, tmp_path: Path) -> None:
    rng = random.Random(3)
    day = 86_400
    rows = [(k, 1_700_000_000 + i * day // 2, i, rng.choice(["ok", "gone", "gone", "blocked"]), rng.choice([None, 100.0, 130.0, 400.0])) for k in (1, 2, 3) for i in range(20)]
    shape = "listing long, at timestamp, seq long, outcome string, price double"
    frame = lambda part: spark.createDataFrame(part, "listing long, at long, seq long, outcome string, price double").withColumn("at", F.timestamp_seconds("at"))
    mixed = rng.sample(rows, len(rows))
    for i in range(4):
        frame(mixed[i::4]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame([(-1, 1_900_000_000, 0, "blocked", None)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    stream = lifecycle_unordered(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "2000 days")
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r.listing, r.at, r.event, r.price) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    folded = lifecycle.fold(frame(rows), "listing").select("listing", F.explode("events").alias("e")).select("listing", "e.*").collect()
    assert got == sorted((r.listing, r.at, r.event, r.price) for r in folded) and got
