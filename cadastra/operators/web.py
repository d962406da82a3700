"""Page snapshots: verdict, structured data, visible text, links, inference and gates of candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions.scalar import fold, jitter, let, url_host
from cadastra.session import cut

#: What a page says that is removed.
REMOVED = (
    "anuncio nao esta mais disponivel", "imovel nao esta mais disponivel", "este anuncio nao esta mais disponivel", "este imovel nao esta mais disponivel", "anuncio foi removido", "anuncio removido", "anuncio indisponivel",
    "imovel indisponivel", "anuncio expirado", "anuncio desativado", "anuncio inativo", "imovel ja foi vendido", "imovel ja foi alugado", "nao encontramos o imovel", "nao encontramos este imovel", "nao encontramos esse imovel",
    "pagina nao encontrada", "anuncio nao encontrado", "imovel nao encontrado",
)
#: What a page says that keeps readers out.
BLOCKED = (
    "just a moment", "attention required", "cf-chl", "cf_chl", "px-captcha", "perimeterx", "datadome", "are you a robot", "are you human", "access denied", "acesso negado", "request unsuccessful", "incapsula",
    "verifique que voce e humano", "captcha",
)
#: Classes that hide an element, and elements that have no end tag.
HIDING_CLASSES = ("hidden", "d-none", "is-hidden", "invisible")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
_TAG = r"<[^>]*+>"
_ATTRIBUTE = r"""([A-Za-z_:][-A-Za-z0-9_:.]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?"""


def hides(tag: Column) -> Column:
    """Whether an opening tag hides its element, by its attributes: hidden, aria-hidden, a style or a class."""
    inner = F.regexp_replace(tag, r"^<[^\s>/]*+|/?>$", "")
    names = F.transform(F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), F.lit(1)), F.lower)
    values = F.transform(F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), F.lit(2)), lambda v: F.lower(F.regexp_replace(v, "^[\"']|[\"']$", "")))

    def hiding(a: Column) -> Column:
        style = F.regexp_replace(a["value"], r"\s", "")
        return (
            F.when(a["name"] == "hidden", True).when(a["name"] == "aria-hidden", a["value"] == "true")
            .when(a["name"] == "style", style.contains("display:none") | style.contains("visibility:hidden"))
            .when(a["name"] == "class", F.arrays_overlap(F.split(a["value"], r"\s+"), F.array(*map(F.lit, HIDING_CLASSES)))).otherwise(False)
        )

    return F.exists(F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), v.alias("value"))), hiding)


def without_hidden(html: Column) -> Column:
    """HTML without its hidden elements and all that is in them, at any depth.

    Tags are walked in order with the name of the outermost hidden element and how many elements of that name
    are open in it; a hidden element that is never closed hides the rest.
    """

    def walked(t: Column) -> Column:
        tags, gaps = F.regexp_extract_all(t, F.lit(_TAG), F.lit(0)), F.split(t, _TAG, -1)
        pieces = F.zip_with(tags, F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda g, x: F.struct(g.alias("tag"), x.alias("text")))
        told = F.transform(pieces, lambda p: F.struct(
            p["tag"].alias("tag"), p["text"].alias("text"), F.lower(F.regexp_extract(p["tag"], r"^</?\s*([A-Za-z][-A-Za-z0-9]*)", 1)).alias("name"), p["tag"].startswith("</").alias("closes"),
            F.when(p["tag"].rlike(r"(?i)hidden|style|class"), hides(p["tag"])).otherwise(False).alias("hides"),
        ))

        def step(s: Column, p: Column) -> Column:
            opens = ~p["closes"] & ~p["name"].isin(*VOID) & ~p["tag"].endswith("/>") & (p["name"] != "")
            begins = (s["depth"] == 0) & opens & p["hides"]
            same = (s["depth"] > 0) & (p["name"] == s["name"])
            depth = F.when(begins, 1).when(same & opens, s["depth"] + 1).when(same & p["closes"], s["depth"] - 1).otherwise(s["depth"])
            lone = (s["depth"] == 0) & p["hides"]  # also a void element
            shown = F.when((depth == 0) & (s["depth"] == 0) & ~lone, F.concat(p["tag"], p["text"])).when(depth == 0, F.concat(F.lit(" "), p["text"])).otherwise("")
            return F.struct(depth.alias("depth"), F.when(begins, p["name"]).otherwise(s["name"]).alias("name"), F.array_append(s["out"], shown).alias("out"))

        start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("name"), F.array(F.get(gaps, 0)).alias("out"))
        return F.array_join(F.aggregate(told, start, step)["out"], "")

    return F.when(html.rlike(r"(?i)hidden|display\s*:|d-none|invisible"), let(html, walked)).otherwise(html)


def entities(text: Column) -> Column:
    """Named entities of markup and numeric ones as their characters; a number that is no character stays as it is."""

    def read(t: Column) -> Column:
        number = lambda e: F.when(F.lower(F.substring(e, 3, 1)) == "x", F.conv(F.regexp_extract(e, "(?i)x([0-9a-f]+)", 1), 16, 10)).otherwise(F.regexp_extract(e, "([0-9]+)", 1)).try_cast("int")
        good = lambda n: n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?i)&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});"), F.lit(0)))
        return F.aggregate(found, t, lambda acc, e: F.when(good(number(e)), F.replace(acc, e, char(number(e)))).otherwise(acc))

    text = F.when(text.contains("&#"), let(text, read)).otherwise(text)
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def visible_text(html: Column) -> Column:
    """Without scripts, styles, comments, hidden elements and tags; entities read, accents folded, blanks joined."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b[^>]*+>.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(without_hidden(t), r"(?s)<[^>]*+>", " ")
    return F.trim(F.regexp_replace(fold(entities(t)), r"\s++", " "))


def verdict(code: Column, final_url: Column, url: Column, text: Column, has_data: Column) -> Column:
    """ok, gone, blocked, redirect or error; signals that contradict each other are an error."""

    def of(text: Column) -> Column:
        says = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))
        return F.struct(says(REMOVED).alias("removed"), says(BLOCKED).alias("blocked"))

    def decided(said: Column) -> Column:
        return (
            F.when(code.isin(404, 410), F.when(has_data, "error").otherwise("gone"))
            .when(code.isin(401, 403, 429) | (said["blocked"] & ~has_data), "blocked")
            .when(code >= 400, "error")
            .when(final_url.isNotNull() & (final_url != url), "redirect")
            .when(said["removed"], F.when(has_data, "error").otherwise("gone"))
            .when(has_data, "ok").otherwise("error")
        )

    return let(let(text, of), decided)


_SCRIPT = r"(?is)<script[^>]*?(?:application/(?:ld\+)?json|__NEXT_DATA__|__NUXT__)[^>]*+>(.*?)</script>"
_META = r"""(?is)<meta\b(?=[^>]*\b(?:property|name|itemprop)\s*=\s*["']?(?:product:price:amount|og:price:amount|price)["'\s>/])[^>]*\bcontent\s*=\s*["']([^"']*)["']"""
#: Keys of a price and of an identifier in nested data.
PRICE_KEYS, ID_KEYS = ("price", "lowprice", "pricevalue"), ("sku", "productid", "identifier", "id", "listingid")


def nested_values(blocks: DataFrame, json: str, levels: int = 64) -> DataFrame:
    """Every object at any depth of ``json`` texts: the other columns, ``path`` of the object, and ``fields``, a map of its plain values by lower-cased key.

    Values are taken apart level by level as VARIANT until none is left, so a key is found at whatever depth
    it lies; beyond ``levels`` levels nothing is looked at. A text that is no JSON has no object.
    """
    keep = [c for c in blocks.columns if c != json]
    now = blocks.select(*keep, F.lit("$").alias("path"), F.try_parse_json(F.col(json)).alias("v")).filter("v is not null")
    found = None
    for _ in range(levels):
        inner = now.select(*keep, "path", F.col("v").alias("v")).lateralJoin(now.sparkSession.tvf.variant_explode_outer(F.col("v").outer())).select(*keep, "path", "pos", "key", F.col("value").alias("value")).filter("value is not null")
        inner = cut(inner.withColumn("kind", F.schema_of_variant("value")))
        nested = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
        plain = inner.filter(F.col("key").isNotNull() & ~nested & (F.col("kind") != "VOID")).groupBy(*keep, "path").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.lower("key"), F.try_variant_get("value", "$", "string"))))).alias("fields"))
        found = plain if found is None else found.unionByName(plain)
        now = inner.filter(nested).select(*keep, F.concat("path", F.lit("/"), F.coalesce("key", F.col("pos").cast("string"))).alias("path"), F.col("value").alias("v"))
        if now.isEmpty():
            break
    return found


def structured(pages: DataFrame, ident: str, html: str, listing: str) -> DataFrame:
    """Price of each page's data: of the object that carries the listing's id, or lies in one that does, else of the only one with a price, else the page's meta tag.

    Objects are looked for at any depth of linked data and of the state that applications embed.
    """
    blocks = pages.select(ident, listing, F.posexplode(F.regexp_extract_all(html, F.lit(_SCRIPT), F.lit(1))).alias("block", "json"))
    objects = nested_values(blocks, "json")
    first = lambda keys: F.coalesce(*(F.col("fields")[k] for k in keys))
    found = cut(objects.select(ident, listing, "block", "path", first(PRICE_KEYS).try_cast("double").alias("price"), first(ID_KEYS).alias("id")))
    prices, ids = found.filter("price > 0").select(ident, listing, "block", "path", "price", "id"), found.filter("id is not null").select(ident, "block", F.col("path").alias("of"), F.col("id").alias("of_id"))
    # the id of a price is the nearest one upwards; a page's objects meet on page and block
    up = prices.select(ident, "block", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))).alias("of")).join(ids, [ident, "block", "of"])
    owner = up.groupBy(ident, "block", "path").agg(F.max_by("of_id", F.length("of")).alias("owner"))
    owned = prices.join(owner, [ident, "block", "path"], "left")
    own = F.max(F.when(F.col("owner") == F.col(listing), F.col("price")))
    data = owned.groupBy(ident).agg(F.count("*").alias("candidates"), F.coalesce(own, F.when(F.count("*") == 1, F.max("price"))).alias("price"))
    meta = pages.select(ident, F.nullif(F.regexp_extract(html, _META, 1), F.lit("")).try_cast("double").alias("meta")).filter("meta > 0")
    both = data.join(meta, ident, "full_outer")
    return both.select(ident, F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"), F.coalesce("price", F.when(F.col("candidates").isNull(), F.col("meta"))).alias("price"))


def links(pages: DataFrame, ident: str, url: str, html: str, first_segment: str) -> DataFrame:
    """Distinct paths of anchors on the page's own host whose first segment matches a pattern."""
    href = F.explode(F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'#]*)"""), F.lit(1)))
    rows = pages.select(ident, url_host(F.col(url)).alias("host"), href.alias("href"))
    path = F.when(F.col("href").startswith("/"), F.regexp_extract("href", r"^(/[^?#]*)", 1)).when(url_host(F.col("href")) == F.col("host"), F.regexp_extract("href", r"^[a-z]+://[^/]*(/[^?#]*)", 1))
    return rows.select(ident, "host", path.alias("path")).filter(F.regexp_extract("path", "^/([^/]*)", 1).rlike(first_segment)).distinct()


def inferred_locality(pages: DataFrame, ident: str, path: str, localities: DataFrame) -> DataFrame:
    """The locality with the longest slug in the path, by an equi-join on the path's words.

    ``localities(locality, slug)``; a slug of several words is looked for among runs of up to four.
    """
    words = F.filter(F.split(F.lower(path), "[^a-z0-9]+"), lambda w: w != "")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))), lambda i: F.array_join(F.slice("w", i + 1, n), "_"))))
    keys = pages.select(ident, words.alias("w")).filter(F.size("w") > 0).select(ident, F.explode(F.array_distinct(runs)).alias("slug"))
    return keys.join(localities, "slug").groupBy(ident).agg(F.max_by("locality", F.struct(F.length("slug"), "slug")).alias("locality"))


def gates(candidates: DataFrame, hard: dict[str, Column], soft: dict[str, Column]) -> DataFrame:
    """Candidates with the reasons that bar them and those that ask for a look, and the decision."""
    names = lambda rules: F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items())))
    out = candidates.withColumn("hard", names(hard)).withColumn("soft", names(soft))
    return out.withColumn("decision", F.when(F.size("hard") > 0, "rejected").when(F.size("soft") > 0, "review").otherwise("promoted"))


def promoted(candidates: DataFrame, ident: str, columns: Sequence[str]) -> DataFrame:
    """Rows to add to the listings: a point near the reference one, marked as such."""
    near = let(jitter(F.col(ident), F.col("lat"), F.col("lon")), lambda p: p)
    return candidates.filter("decision = 'promoted'").withColumn("p", near).select(ident, *columns, F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), F.lit("locality_centroid_deterministic_jitter").alias("coordinate_precision"))
