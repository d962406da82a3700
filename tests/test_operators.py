from __future__ import annotations

import datetime as dt
import heapq
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cadastra.functions import scalar
from cadastra.operators import attributes, filters, graph, joins, lifecycle, period, quality, rollup, rules, spatial, stats, survey
from cadastra.operators.period import Metric
from cadastra.sources import files
from cadastra.streaming.lifecycle import lifecycle_events


def month(n: int) -> dt.date:
    return dt.date(2024, n, 1)


@pytest.fixture
def months(spark: SparkSession):
    rows = [(month(1), 10.0, 100.0, 2.0, 5.0), (month(2), 20.0, 300.0, None, 7.0), (month(3), None, 50.0, 1.0, None)]
    return spark.createDataFrame(rows, "month date, flow double, num double, den double, stock double")


def test_kinds_pick_the_aggregate(months) -> None:
    metrics = [Metric("flow", "flow"), Metric("stock", "stock"), Metric("price", "ratio", ("num", "den")), Metric("den", "refused")]
    found = {r["metric"]: (r["value"], r["origin"], r["missing"]) for r in period.aggregate(months, metrics).collect()}
    assert found == {"flow": (30.0, "sum", 1), "stock": (6.0, "mean", 1), "price": (50.0, "ratio_of_sums", 1), "den": (None, "unsupported", 1)}


def test_no_sides_is_absent_not_zero(months) -> None:
    found = period.aggregate(months.filter("den is null"), [Metric("price", "ratio", ("num", "den"))]).first()
    assert (found["value"], found["origin"]) == (None, "absent")


def test_unknown_kind_is_refused() -> None:
    with pytest.raises(ValueError, match="kind"):
        period.registry([Metric("x", "median")])


def test_published_year_to_date_wins_only_without_gaps(months) -> None:
    ytd = months.withColumn("y", F.lit(99.0))
    of = lambda df: period.aggregate(df, [Metric("flow", "flow", ytd="y")]).first()["value"]
    assert of(ytd) == 99.0
    assert of(ytd.filter(F.col("month") != month(2))) == 10.0


def test_midrank_with_ties(spark: SparkSession) -> None:
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.0, 5.0, None)], "v double")
    assert [r[0] for r in stats.midrank(df, "v").orderBy("rank_pct").select("rank_pct").collect()] == [None, 0.0, 50.0, 50.0, 100.0]
    assert stats.midrank(df.filter("v = 5"), "v").first()["rank_pct"] == 100.0


def test_quantile_breaks_do_not_interpolate(spark: SparkSession) -> None:
    df = spark.createDataFrame([(float(v),) for v in range(10)], "v double")
    assert stats.quantile_breaks(df, "v", 4) == [2.0, 5.0, 7.0]
    assert stats.quantile_breaks(df.filter("v < 3"), "v", 4) == []


def test_conflicts_drop_both_rows(spark: SparkSession) -> None:
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "b", 7), (4, None, 8), (5, None, 9)], "i int, k string, n int")
    assert sorted(r["i"] for r in joins.without_conflicts(df, ["k", "n"]).collect()) == [3, 4, 5]


def test_import_then_undo(spark: SparkSession) -> None:
    table = spark.createDataFrame([(1, "x", "seed", 1)], "id int, name string, import_id string, version int")
    batch = spark.createDataFrame([(1, 1, "y"), (2, 2, "z"), (3, 2, "w"), (4, None, "q")], "line int, id int, name string")
    rows = quality.validate_batch(batch, "line", "id", [], table, "update")
    assert {r["line"]: (r["action"], r["errors"]) for r in rows.collect()} == {1: ("update", []), 2: ("insert", []), 3: ("reject", ["repeated_in_file"]), 4: ("reject", ["required"])}
    after = quality.upsert(table, rows, "id", ["name"], "i1")
    assert sorted((r["id"], r["name"], r["version"]) for r in after.collect()) == [(1, "y", 2), (2, "z", 1)]
    left, kept = quality.undo(after, "i1")
    assert [r["id"] for r in left.collect()] == [1] == [r["id"] for r in kept.collect()]


CHECKS = [
    (1, 1, "ok", 100.0), (1, 2, "gone", None), (1, 2, "gone", None), (1, 2, "error", None), (1, 2, "gone", None), (1, 3, "gone", None), (1, 4, "ok", 150.0), (1, 5, "ok", 900.0),
    (2, 1, "gone", None), (2, 2, "blocked", None), (2, 3, "gone", None), (2, 4, "gone", None), (2, 5, "gone", None),
]


def test_life_cycle_in_batch_and_stream(spark: SparkSession, tmp_path) -> None:
    rows = [(listing, dt.datetime(2024, 1, day, 8) + dt.timedelta(minutes=i), i, outcome, price) for i, (listing, day, outcome, price) in enumerate(CHECKS)]
    checks = spark.createDataFrame(rows, "listing long, at timestamp, seq long, outcome string, price double")
    state = {r["listing"]: r for r in lifecycle.fold(checks, "listing").collect()}
    events = {k: [e["event"] for e in r["events"]] for k, r in state.items()}
    assert events == {1: ["deactivated", "reactivated", "price_change", "price_unconfirmed"], 2: ["deactivated"]}
    assert (state[1]["status"], state[1]["price"], state[2]["status"]) == ("active", 150.0, "inactive")
    checks.write.parquet(str(tmp_path / "in"))
    stream = lifecycle_events(spark.readStream.schema(checks.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    seen = defaultdict(list)
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect():
        seen[r["listing"]].append(r["event"])
    assert dict(seen) == events


def brandes(arcs: dict[str, list[tuple[str, float, int]]]) -> dict[int, float]:
    """Edge dependencies by a plain search."""
    out: dict[int, float] = defaultdict(float)
    for s in {*arcs, *(v for a in arcs.values() for v, _, _ in a)}:
        dist, heap, order = {s: 0.0}, [(0.0, s)], []
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u] or u in order:
                continue
            order.append(u)
            for v, w, _ in arcs.get(u, []):
                if d + w < dist.get(v, 1e18):
                    dist[v] = d + w
                    heapq.heappush(heap, (d + w, v))
        sigma, delta = defaultdict(float), defaultdict(float)
        sigma[s] = 1.0
        used = [(u, v, e) for u in order for v, w, e in arcs.get(u, []) if dist[u] + w == dist[v]]
        for u, v, _ in used:
            sigma[v] += sigma[u]
        for u in reversed(order):
            for a, b, e in used:
                if b == u:
                    c = sigma[a] / sigma[b] * (1 + delta[b])
                    out[e] += c
                    delta[a] += c
    most = max(out.values())
    return {e: c / most for e, c in out.items()}


def test_betweenness_against_a_plain_search(spark: SparkSession) -> None:
    rnd = random.Random(5)
    pairs = {tuple(sorted(rnd.sample("abcdefgh", 2))) for _ in range(14)}
    edges = [(i, u, v, float(rnd.randint(1, 4)), rnd.random() < 0.3) for i, (u, v) in enumerate(sorted(pairs))]
    edges += [(100 + i, u, v, w, oneway) for i, u, v, w, oneway in edges[:4]] + [(200, *edges[0][1:3], 9.0, False)]  # parallel ones
    arcs = defaultdict(list)
    for e, u, v, w, oneway in edges:
        arcs[u].append((v, w, e))
        if not oneway:
            arcs[v].append((u, w, e))
    want = brandes(arcs)
    got = {r["edge"]: r["betweenness"] for r in graph.edge_betweenness(spark.createDataFrame(edges, "edge int, u string, v string, length double, oneway boolean")).collect()}
    assert got == {e: pytest.approx(want.get(e, 0.0)) for e, *_ in edges}


@pytest.mark.parametrize("front", [0, 200_000])
def test_betweenness_keeps_no_arcs_out_of_reach(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, front: int) -> None:
    held, cut = [], graph._cut
    monkeypatch.setattr(graph, "FRONT", front, raising=False)
    monkeypatch.setattr(graph, "_cut", lambda df: held.append((out := cut(df)).count()) or out)
    names = [r["s"] for r in spark.range(200).select(F.concat(F.lit("n"), "id").alias("s")).orderBy(F.xxhash64("s"), "s").collect()]
    near = [(i, names[i], names[i + 1], 1.0, False) for i in range(4)] + [(4, names[0], names[1], 1.0, False)]
    far = [(10 + i, names[5 + i % 195], names[5 + i * 7 % 195], 1.0, False) for i in range(1, 500)]
    got = graph.edge_betweenness(spark.createDataFrame(near + far, "edge int, u string, v string, length double, oneway boolean"), sources=1)
    want = {0: 2 / 3, 1: 1.0, 2: 2 / 3, 3: 1 / 3, 4: 2 / 3}  # the first node by hash begins the near path
    assert {r["edge"]: r["betweenness"] for r in got.collect()} == {e: pytest.approx(want.get(e, 0.0)) for e, *_ in near + far}
    assert front == 0 or max(held) <= 2 * len(near)


@pytest.mark.parametrize("hashes", [0, 1_000_000])
def test_betweenness_holds_one_arc_between_two_nodes(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, hashes: int) -> None:
    held, cut = [], graph._cut
    monkeypatch.setattr(graph, "HASHES", hashes, raising=False)
    monkeypatch.setattr(graph, "_cut", lambda df: held.append((out := cut(df)).count()) or out)
    names = [r["s"] for r in spark.range(6).select(F.concat(F.lit("n"), "id").alias("s")).orderBy(F.xxhash64("s"), "s").collect()]
    path = [(i, names[i], names[i + 1], 1.0, i % 2 == 0) for i in range(5)]
    longer = [(10 + i, names[i % 5 + 1], names[i % 5], 2.0 + i, False) for i in range(300)]
    loose = [(-1, names[0], names[0], 1.0, False), (-2, None, names[0], 1.0, False), (-3, names[0], None, 1.0, False)]
    got = graph.edge_betweenness(spark.createDataFrame(path + longer + loose, "edge int, u string, v string, length double, oneway boolean"), sources=1)
    want = {i: (5 - i) / 5 for i in range(5)}
    assert {r["edge"]: r["betweenness"] for r in got.collect()} == {e: pytest.approx(want.get(e, 0.0)) for e, *_ in path + longer + loose}
    assert max(held) <= 10


def test_betweenness_makes_edges_distinct_in_small_parts(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(graph, "EDGES", 20, raising=False)
    edges = [(i % 500, "a", "b" if i % 500 < 10 else "c", 1.0, True) for i in range(1000)]  # each comes twice
    got = graph.edge_betweenness(spark.createDataFrame(edges, "edge int, u string, v string, length double, oneway boolean"))
    assert got.rdd.getNumPartitions() == 50
    rows = got.collect()
    assert len(rows) == 500
    assert {r["edge"]: r["betweenness"] for r in rows} == {i: pytest.approx(1.0 if i < 10 else 20 / 980) for i in range(500)}


@pytest.mark.parametrize("sources", [0, 1, 4, 30, 500])
def test_first_nodes_without_telling_all_apart(spark: SparkSession, sources: int) -> None:
    rnd = random.Random(8)
    edges = [(i, f"n{rnd.randrange(150)}", f"n{rnd.randrange(150)}", 1.0, rnd.random() < 0.5) for i in range(400)] + [(400, "alone", "alone", 1.0, False), (401, None, "lost", 1.0, False)]
    df = spark.createDataFrame(edges, "edge int, u string, v string, length double, oneway boolean")
    nodes, around = graph._first_nodes(df, sources)
    used = {n for _, u, v, *_ in edges if u and u != v for n in (u, v)}
    order = [r["s"] for r in spark.createDataFrame([(n,) for n in used], "s string").orderBy(F.xxhash64("s"), "s").collect()]
    first = set(order[:sources])
    assert {r["s"] for r in nodes.collect()} == first
    if around is not None:
        from_first = {(r["u"], r["v"]) for r in graph.arcs(df).collect() if r["u"] in first}
        assert from_first <= {(r["u"], r["v"]) for r in around.collect()}
    assert (around is not None) == (sources in (1, 4))


def test_hull_of_a_square(spark: SparkSession) -> None:
    rows = [("p", {"lon": float(x), "lat": float(y)}) for x in range(3) for y in range(3)]
    ring = spatial.hulls(spark.createDataFrame(rows, "parent string, point struct<lon:double,lat:double>"), "parent", "point").first()["ring"]
    assert [(p["lon"], p["lat"]) for p in ring] == [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]


def plain_simple(line: list, tolerance: float) -> list:
    """The recursion on the distance from the segment."""

    def away(p: tuple, a: tuple, b: tuple) -> float:
        d = (b[0] - a[0], b[1] - a[1])
        n = d[0] ** 2 + d[1] ** 2
        t = max(0.0, min(1.0, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / n)) if n else 0.0
        return ((p[0] - a[0] - t * d[0]) ** 2 + (p[1] - a[1] - t * d[1]) ** 2) ** 0.5

    if len(line) < 3 or tolerance <= 0:
        return line
    far = [away(p, line[0], line[-1]) for p in line[1:-1]]
    i = far.index(max(far)) + 1
    return plain_simple(line[: i + 1], tolerance)[:-1] + plain_simple(line[i:], tolerance) if far[i - 1] > tolerance else [line[0], line[-1]]


def test_simplified_lines_against_a_plain_recursion(spark: SparkSession) -> None:
    rnd = random.Random(9)
    lines = [[(0.0, 0.0), (3.0, 0.0), (1.0, 0.0)], [(0.0, 0.0), (1.0, 1.0)], *([(rnd.uniform(0, 5), rnd.uniform(0, 2)) for _ in range(rnd.randrange(2, 15))] for _ in range(40))]
    df = spark.createDataFrame([(i, [{"lon": x, "lat": y} for x, y in line]) for i, line in enumerate(lines)], "i int, line array<struct<lon:double,lat:double>>")
    for tolerance in (0.5, 0.0):
        got = {r["i"]: [(p["lon"], p["lat"]) for p in r["simple"]] for r in spatial.simplified(df, "line", tolerance).collect()}
        assert got == {i: plain_simple(line, tolerance) for i, line in enumerate(lines)}


def test_hull_of_two_points_is_closed(spark: SparkSession) -> None:
    rows = [("p", {"lon": float(x), "lat": 0.0}) for x in (1, 0, 1)] + [("q", {"lon": 2.0, "lat": 2.0})]
    rings = {r["parent"]: [(p["lon"], p["lat"]) for p in r["ring"]] for r in spatial.hulls(spark.createDataFrame(rows, "parent string, point struct<lon:double,lat:double>"), "parent", "point").collect()}
    assert rings == {"p": [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)], "q": [(2.0, 2.0)]}


def test_csv_round_trip_is_guarded(spark: SparkSession, tmp_path) -> None:
    df = spark.createDataFrame([("=1+1", "a;b"), ("x", 'say "hi"')], "a string, b string")
    files.write_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "csv")).collect())) == [("=1+1", "a;b"), ("x", 'say "hi"')]


def test_missing_table_is_empty_with_a_warning(spark: SparkSession, tmp_path) -> None:
    schema = spark.range(1).schema
    df, warnings = files.read_or_empty(spark, str(tmp_path / "none"), schema)
    assert df.count() == 0
    assert len(warnings) == 1
    with pytest.raises(ValueError, match="found"):
        files.require(df, ["other"])


def test_features(spark: SparkSession, tmp_path) -> None:
    (tmp_path / "f.json").write_text('{"features":[{"properties":{"name":"a"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}]}')
    row = files.read_features(spark, str(tmp_path / "f.json"), "struct<name:string>").first()
    assert (row["name"], row["kind"], len(row["rings"][0])) == ("a", "Polygon", 4)


def test_survey_helpers(spark: SparkSession) -> None:
    df = spark.createDataFrame([(1, "R$ 1.000,00", " "), (2, "a combinar", "x")], "id int, price string, name string")
    new, log = survey.sanitised(df, "id", ["price"])
    assert [r["price"] for r in new.orderBy("id").collect()] == ["1000.0", "a combinar"]
    assert [tuple(r) for r in log.collect()] == [(1, "price", "R$ 1.000,00", "1000.0")]
    assert survey.drift(df, ["id", "area"]) == {"missing": ["area"], "unknown": ["price", "name"]}
    assert survey.refresh_allowed({"a": (df, ["id", "area"]), "b": (df.limit(0), ["id"])}) == ["a: column area is missing", "b: no rows"]
    assert [r["name"] for r in survey.resolve_aliases(df, {"name": ["price"]}).orderBy("id").collect()] == ["R$ 1.000,00", "x"]


def test_findings_in_order_of_severity(spark: SparkSession) -> None:
    df = spark.createDataFrame([("b", "info"), ("a", "odd"), ("c", "error"), ("a", "error"), ("z", "warning")], "ident string, severity string")
    assert [tuple(r) for r in quality.ordered(df, "ident").collect()] == [("a", "error"), ("c", "error"), ("z", "warning"), ("b", "info"), ("a", "odd")]


def test_headers_are_checked() -> None:
    assert quality.header_findings(["id", " ", "price", "id "], ["id", "area"]) == [("blank_header", "2"), ("duplicate_header", "id"), ("missing_header", "area")]


def test_files_in_a_box_and_the_median(spark: SparkSession) -> None:
    bounds = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", 2.0, 2.0, 3.0, 3.0), ("c", -5.0, 0.5, 0.0, 0.7)], "path string, west double, south double, east double, north double")
    assert filters.files_in_box(bounds, (0.0, 0.0, 1.5, 1.5)) == ["a", "c"]
    for values, want in (([3.0, 1.0, 2.0, 2.0], 2.0), ([1.0, 4.0], 2.5), ([7.0], 7.0), ([], None)):
        assert filters.exact_median(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()[0] == want


def test_known_listings_by_token_then_address(spark: SparkSession) -> None:
    columns = "id long, portal string, token string, url string"
    old = spark.createDataFrame([(1, "Imóveis DF", "A1", "https://x.br/a?p=1"), (2, "imoveis-df", "A1", None), (3, "outro", "", "HTTPS://X.br/b"), (4, "outro", None, "nowhere"), (5, "", "A1", "https://x.br/B#top")], columns)
    new = spark.createDataFrame([
        (10, "IMÓVEIS DF", " A1 ", "https://x.br/b"),  # the token comes first; of two the smaller id
        (11, "imoveis df", "a1", "https://x.br/b?utm=2#z"),  # tokens keep their case
        (12, "outro", "", "nowhere"),  # blank token, no address
        (13, "", "A1", "https://X.br/B"),  # no portal, paths keep their case
        (14, None, None, None),
        (15, "outro", "A1", "ftp://x.br/b"),
    ], columns)
    got = {r["id"]: (r["existing"], r["matched_by"]) for r in joins.known_listings(new, "id", old, "id").collect()}
    assert got == {10: (1, "token"), 11: (3, "address"), 13: (5, "address")}
    assert joins.known_listings(new, "id", old.limit(0), "id").count() == 0


def test_edition_totals_count_each_place_once_an_edition(spark: SparkSession) -> None:
    columns = "region string, quality_flags array<string>, dom_2010 long, dom_2022 long, pop_2010 long, pop_2022 long"
    detail = spark.createDataFrame([("RA_01", None, None, 7, None, 20), ("RA_01", ["partial_children"], 3, 4, 9, 12), (None, [], 2, 2, 5, 5)], columns)
    overview = spark.createDataFrame([
        ("RA_01", [], 10, 99, 30, 990, 0, 4, 4),  # whole in 2010 only
        ("RA_01", [], 50, 50, 50, 50, None, None, 2),  # subdivided in both
        ("", None, None, 5, None, 6, None, None, None),  # no count of children: whole in both
    ], columns + ", children_2010 long, children_2022 long, children long")
    got = {r["region"]: r.asDict() for r in rollup.edition_totals(detail, overview, "region", ("2010", "2022")).collect()}
    assert got == {
        "RA_01": {"region": "RA_01", "households_2010": 13, "households_2022": 11, "pop_2010": 39, "pop_2022": 32, "cells_2010": 2, "cells_2022": 2, "cells_partial": 2, "households_delta": -2, "households_growth": -0.1538},
        "SEM_RA": {"region": "SEM_RA", "households_2010": 2, "households_2022": 7, "pop_2010": 5, "pop_2022": 11, "cells_2010": 1, "cells_2022": 2, "cells_partial": 1, "households_delta": 5, "households_growth": 2.5},
    }


def test_hulls_of_many_small_groups_make_no_frame_a_group(spark: SparkSession) -> None:
    rows = spark.range(3_000).select((F.col("id") % 400).cast("string").alias("parent"), F.struct((F.col("id") % 7).cast("double").alias("lon"), (F.col("id") % 11).cast("double").alias("lat")).alias("point"))
    rows = rows.union(spark.createDataFrame([("one", (1.0, 2.0)), ("two", (1.0, 2.0)), ("two", (0.0, 2.0))], rows.schema))
    hulls = spatial.hulls(rows, "parent", "point")
    got = {r["parent"]: [tuple(p) for p in r["ring"]] for r in hulls.collect()}
    points: dict[str, list] = {}
    for r in rows.collect():
        points.setdefault(r["parent"], []).append(tuple(r["point"]))
    assert got == {k: spatial._hull(v) for k, v in points.items()}
    assert "FlatMapGroupsInPandas" not in hulls._jdf.queryExecution().executedPlan().toString()


def test_lines_of_a_batch_are_cut_at_once() -> None:
    ends = np.array([0, 0, 1, 3, 8, 8, 12])
    x, y = np.array([5.0, 0, 1, 0, 1, 2, 3, 4, 0, 1, 1, 0]), np.array([5.0, 0, 0, 0, 9, 0, 0.1, 0, 0, 0, 1, 0])
    assert spatial._kept(x, y, ends, 0.5).tolist() == [True, True, True, True, True, True, False, True, True, True, True, True]


def test_a_profile_reads_each_number_once(spark: SparkSession) -> None:
    rows = spark.createDataFrame([(1, "-1", "50", "50"), (2, "", "101", "x"), (3, "5", "10", "20")], "id long, income string, a string, b string")
    found = rules.profile_findings(rows, "id", "income", ["a", "b"])
    assert {(r["id"], r["code"]) for r in found.collect()} == {(1, "invalid_income"), (2, "invalid_percentage:a"), (2, "invalid_percentage:b"), (3, "share_sum")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("reais") <= 12


def test_an_attribute_reads_its_number_once_for_a_kind(spark: SparkSession) -> None:
    read = str(attributes._read(*map(F.col, ("kind", "value", "unit", "options"))))
    assert 0 < read.count("reais") <= 6  # of a number, a whole number and a date's serial


def test_figures_in_other_dress(spark: SparkSession) -> None:
    texts = {"1,234\n": 1234.0, "1.234,5": 1234.5, "1,5": 1.5, "12.5": 12.5, "R$ 1.234": 1234.0, "1.234": 1.234, ".5": 0.5, "..": None, "-": None, "x1": None, "7 %": 7.0, "": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalar.number(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == texts
