from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cadastra.functions import geometry as G
from cadastra.functions import scalar as S
from cadastra.functions import vocabulary as V
from cadastra.operators import web as W


def values(spark: SparkSession, texts: list, use, kind: str = "string") -> list:
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, x {kind}").orderBy("i").select(use(F.col("x"))).collect()]


def test_number(spark: SparkSession) -> None:
    texts = ["19117.647", "1.234,56", "R$ 2.500.000", "8,6%", "1,234", "R$ 385.000", "385.000", "-3", "abc", "", None, "1.2.3", "1,2,3", "12 m²"]
    assert values(spark, texts, S.number) == [19117.647, 1234.56, 2500000.0, 8.6, 1234.0, 385000.0, 385.0, -3.0, None, None, None, 123.0, 123.0, 12.0]


def test_date_needs_a_real_day(spark: SparkSession) -> None:
    texts = ["2026-02-30", "2024-02-29", "Date(2024,0,31)", "31/12/2023", "45000", "15", None]
    assert values(spark, texts, S.calendar_date) == [None, dt.date(2024, 2, 29), dt.date(2024, 1, 31), dt.date(2023, 12, 31), dt.date(2023, 3, 15), None, None]


def test_month_key(spark: SparkSession) -> None:
    assert values(spark, ["2024-05-03", "5/2024", "Date(2024,11", "2024-13", "x", None], S.month_key) == ["2024-05", "2024-05", "2024-12", None, None, None]


def test_region_numerals_are_canonical(spark: SparkSession) -> None:
    assert values(spark, ["RA-XIX", "ra iv", "IIII", "IXX", "", None], S.region_number) == [19, 4, None, None, None, None]


def test_value_on_a_break_goes_up(spark: SparkSession) -> None:
    assert values(spark, [9.9, 10.0, 40.0, None, float("nan"), float("inf")], lambda c: S.class_index(c, [10, 25, 40]), "double") == [0, 1, 3, None, None, None]


def test_zero_base_is_null(spark: SparkSession) -> None:
    assert values(spark, [0.0, None, 4.0], lambda c: S.change(F.lit(5.0), c), "double") == [None, None, 0.25]


def test_slug_and_urls(spark: SparkSession) -> None:
    assert values(spark, ["  São João-D'Oeste ", "--", None], S.slug) == ["sao_joao_d_oeste", "", ""]
    assert values(spark, ["HTTP://Ex.com/A?b#c", "ftp://x", "javascript:1", None], S.canonical_url) == ["http://ex.com/A", None, None, None]


def test_property_bag(spark: SparkSession) -> None:
    assert values(spark, ['{"a":1}', "[1]", "3", None], S.property_bag) == [{"a": "1"}, None, None, None]


@pytest.mark.parametrize(("x", "y", "inside"), [(0.5, 0.5, True), (1.0, 0.5, True), (0.0, 0.0, True), (1.1, 0.5, False)])
def test_border_counts_as_inside(spark: SparkSession, x: float, y: float, inside: bool) -> None:
    ring = G.square(F.lit(0.0), F.lit(0.0), 1.0)
    point = F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat"))
    assert spark.range(1).select(G.contains(ring, point)).first()[0] is inside


def test_hole_is_outside(spark: SparkSession) -> None:
    rings = F.array(G.square(F.lit(0.0), F.lit(0.0), 3.0), G.square(F.lit(1.0), F.lit(1.0), 1.0))
    at = lambda v: F.struct(F.lit(v).alias("lon"), F.lit(v).alias("lat"))
    assert spark.range(1).select(G.in_polygon(rings, at(1.5)), G.in_polygon(rings, at(0.5))).first()[:] == (False, True)


def test_degenerate_ring_has_the_mean_of_its_vertices(spark: SparkSession) -> None:
    ring = F.array(*(F.struct(F.lit(float(v)).alias("lon"), F.lit(0.0).alias("lat")) for v in (0, 1, 2)))
    assert spark.range(1).select(G.centroid(ring)["lon"]).first()[0] == 1.0


def test_geometry_fingerprint_and_rounding(spark: SparkSession) -> None:
    rows = [(1, [{"lon": 0.12345649, "lat": 1.0}]), (2, [{"lon": 0.1234560, "lat": 1.0000001}]), (3, [{"lon": 0.2, "lat": 1.0}])]
    df = spark.createDataFrame(rows, "i int, ring array<struct<lon:double,lat:double>>")
    got = {r["i"]: r["f"] for r in df.select("i", G.fingerprint(F.col("ring")).alias("f")).collect()}
    assert got[1] == got[2] != got[3]
    assert df.select(G.rounded(F.col("ring"), 2)[0]["lon"]).first()[0] == 0.12


def test_first_filled_and_titles(spark: SparkSession) -> None:
    df = spark.createDataFrame([(" ", "b", "são joão da serra"), ("a", "b", "  DE  LUZ "), (None, "", "")], "x string, y string, n string")
    assert [tuple(r) for r in df.select(S.first_filled(F.col("x"), F.col("y")), V.title(F.col("n"))).collect()] == [("b", "São João da Serra"), ("a", "De Luz"), (None, "")]


def test_hidden_elements_are_not_seen(spark: SparkSession) -> None:
    html = """<p>a</p><div class="x d-none">b</div><span hidden>c</span><i style="color:red; display: none">d</i><b aria-hidden="true">e</b><p class="not-hidden">f</p>"""
    assert spark.createDataFrame([(html,)], "h string").select(W.visible_text(F.col("h"))).first()[0] == "a f"


def test_hidden_elements_at_any_depth(spark: SparkSession) -> None:
    from cadastra.operators.web import visible_text

    cases = {
        "<div hidden><div>a</div><div>b</div></div>c": "c",
        "x<div><p style='Display : None'>a<p>b</p>c</p>d</div>e": "x d e",
        '<section class="big d-none"><div><div><div>deep</div></div></div><section>in</section>still</section>out': "out",
        '<span aria-hidden="true">a</span><span aria-hidden="false">b</span><span class="hidden-xs">c</span>': "b c",
        "<img hidden src='a'>shown<br hidden/>too": "shown too",
        "<div hidden>a<img>b<br/>c</div>d": "d",
        "a<div hidden>never closed <b>x</b>": "a",
        "<div data-x='display:none' title=hidden>kept</div>": "kept",
        "</div hidden>odd<DIV HIDDEN>x</DIV>y": "odd y",
        "caf&#233; &#xE9;t&#xe9; &#0; &#55296; &#128512; &lt;b&gt; &amp;": "cafe ete &#0; &#55296; \U0001f600 <b> &",
        "plain": "plain", "": "",
    }
    df = spark.createDataFrame(list(cases.items()), "html string, want string")
    for r in df.select("html", "want", visible_text(F.col("html")).alias("got")).collect():
        assert r.got == r.want, r.html


def test_types_and_rooms_by_words(spark: SparkSession) -> None:
    from cadastra.functions.vocabulary import bedrooms, property_type

    cases = [
        ("/imovel/casa-em-condominio-fechado/3-quartos-x", "casa_condominio", 3), ("/venda/lote-urbano", "terreno", None), ("/piloto/terrenos", "terreno", None), ("/apartamento-2-qts/", "apartamento", 2),
        ("/flat/10-dormitorios", "apartamento", 10), ("/casas/100-quartos", "casa", None), ("/casarao/4quartos", None, None), ("/Prédio-inteiro", "predio", None), ("/kitinete", "kitnet", None), ("", None, None), (None, None, None),
    ]
    df = spark.createDataFrame(cases, "url string, kind string, rooms int")
    for r in df.select("url", "kind", "rooms", property_type(F.col("url")).alias("k"), bedrooms(F.col("url")).alias("n")).collect():
        assert (r.k, r.n) == (r.kind, r.rooms), r.url
