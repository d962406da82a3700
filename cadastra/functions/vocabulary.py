"""Controlled vocabularies derived from texts, and names as titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadastra.functions.scalar import filled, let, slug

#: Stages of sale by what a status says, in order.
STAGES = (("em_lancamento", "lancamento"), ("em_construcao", "em_obra|em_obras|construcao|em_construcao|inicio_de_obras"), ("oferta", "oferta|pronto|estoque|entregue"))
#: Groups of anchors by category, and segments by category and detail, in order.
GROUPS = {"mobilidade": "infraestrutura", "parque_equipamento_publico": "infraestrutura", "escola": "comercio_servico", "saude": "comercio_servico", "shopping_center": "comercio_servico", "supermercado_atacarejo": "comercio_servico", "universidade": "comercio_servico"}
SEGMENTS = (
    ("escola", "", "escola"), ("universidade", "", "universidade"), ("supermercado_atacarejo", "atac", "atacado"), ("supermercado_atacarejo", "", "supermercado"),
    ("saude", "hospital", "hospital"), ("saude", "laboratorio", "laboratorio"), ("saude", "clinica", "clinica"),
    ("mobilidade", "metro", "estacao_metro"), ("mobilidade", "trem", "estacao_trem"), ("mobilidade", "rodovi", "terminal_rodoviario"), ("mobilidade", "aeroporto", "aeroporto"), ("mobilidade", "onibus", "ponto_onibus"),
)
#: Property types by what a path or title says, in order; parts of words, whole words, or runs of words.
CLOSED = ("casa condominio", "condominio fechado")
PART_OF = {"kitnet": ("kitnet", "kitinete", "quitinete"), "terreno": ("terreno",), "apartamento": ("apartamento", "cobertura")}
WHOLE = {"terreno": ("lote",), "predio": ("predio",), "apartamento": ("flat",), "casa": ("casa", "casas")}
ROOMS = ("quarto", "quartos", "qt", "qts", "dormitorio", "dormitorios")
#: Words that stay small inside a name.
SMALL = ("de", "da", "do", "das", "dos", "e")


def _first(pairs: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for hit, name in reversed(pairs):
        out = F.when(hit, name).otherwise(out)
    return out


def sales_stage(status: Column, given: Column | None = None) -> Column:
    """Stage of sale: what is given, else by the status."""
    s = slug(status)
    found = _first([(s.rlike(p), name) for name, p in STAGES])
    return found if given is None else F.coalesce(filled(given), found)


def anchor_group(category: Column, given: Column | None = None) -> Column:
    """Group of an anchor: what is given, else by its category."""
    s = slug(category)
    found = _first([(s == c, g) for c, g in GROUPS.items()])
    return found if given is None else F.coalesce(filled(given), found)


def anchor_segment(category: Column, subcategory: Column, name: Column, given: Column | None = None) -> Column:
    """Segment of an anchor: what is given, else by its category and what its subcategory and name say."""
    s, detail = slug(category), slug(F.concat_ws(" ", subcategory, name))
    found = _first([((s == c) & detail.contains(d), g) for c, d, g in SEGMENTS])
    return found if given is None else F.coalesce(filled(given), found)


def _words(text: Column) -> Column:
    """Words of a path or title, without accents."""
    return F.filter(F.split(slug(text), "[^a-z0-9]+"), lambda w: w != "")


def property_type(text: Column) -> Column:
    """Property type by the first hint in a path or title."""

    def of(words: Column) -> Column:
        run = F.array_join(F.filter(words, lambda w: ~w.isin("em", "de")), " ")
        closed = F.lit(False)
        for phrase in CLOSED:
            closed = closed | run.contains(phrase)
        hints = [(closed, "casa_condominio")]
        for name in ("kitnet", "terreno", "predio", "apartamento", "casa"):
            part = _holds(words, PART_OF.get(name, ()))
            hints.append((part | F.arrays_overlap(words, F.array(*map(F.lit, WHOLE[name]))) if name in WHOLE else part, name))
        return _first(hints)

    return let(_words(text), of)


def _holds(words: Column, parts: tuple[str, ...]) -> Column:
    """Whether a word has one of the parts in it."""
    out = F.lit(False)
    for p in parts:
        out = out | F.exists(words, lambda w: w.contains(p))  # noqa: B023
    return out


def bedrooms(url: Column) -> Column:
    """Number of bedrooms that a path names: a number of one or two digits with a word for rooms right after it."""

    def of(words: Column) -> Column:
        pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda n, w: F.struct(n.alias("n"), w.alias("w")))
        return F.get(F.filter(pairs, lambda p: p["n"].rlike("^[0-9]{1,2}$") & p["w"].isin(*ROOMS)), 0)["n"].cast("int")

    return let(_words(url), of)


def title(name: Column) -> Column:
    """Each word with a capital, small ones but the first in lower case."""
    words = F.filter(F.split(F.lower(F.trim(name)), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*SMALL), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))), " ")


def direction_key(code: Column, direction: Column) -> Column:
    """``code|direction`` of a measuring point's direction."""
    return F.concat(F.trim(code), F.lit("|"), F.lower(F.trim(direction)))
