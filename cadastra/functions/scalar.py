"""Column functions: text to number, date or flag, keys, classes and shares.

An absent or unreadable value is NULL, never 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words read as yes and as no.
YES = ("1", "true", "sim", "yes", "y", "x", "verdadeiro")
NO = ("0", "false", "nao", "não", "no", "n", "falso")
#: Property types by orientation.
VERTICAL, HORIZONTAL = ("apartamento", "predio", "kitnet"), ("casa", "casa_condominio", "terreno")
#: How exact a position is.
EXACT = "(polygon_reference_point|building_reference_point|official_wfs_point)"
DOWNGRADING = "(low_spatial|medium_spatial|medium_coordinate|medium_high|user_supplied|approx|pending|centroid|jitter)"
_FIGURES, _AS_IS = r"^[-+]?[0-9.,]+\z", r"^[-+]?[0-9]*+\.?[0-9]++\z"
_CURRENCY = r"(?i)^\s*(?:R\$|BRL)\s*|\s*(?:R\$|BRL|reais)\s*$"
_UNIT = r"(?i)\s*(?:%|m²|m2|/m²|/m2)\s*$"
_ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuucnyy"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it occurs there."""
    return F.transform(F.array(value), use)[0]


def blank(c: Column) -> Column:
    """NULL or nothing but white space."""
    return F.coalesce(F.trim(c.cast("string")) == "", F.lit(True))


def filled(c: Column) -> Column:
    """The trimmed text, NULL where blank."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL where b is 0 or either is NULL."""
    return F.try_divide(a, F.nullif(b, F.lit(0)))


def number(text: Column) -> Column:
    """A number in either convention: the last separator is the decimal one, but for thousands."""

    def value(s: Column, currency: Column) -> Column:
        comma, dot = F.instr(F.reverse(s), ","), F.instr(F.reverse(s), ".")  # from the end
        commas, dots = F.length(s) - F.length(F.translate(s, ",", "")), F.length(s) - F.length(F.translate(s, ".", ""))
        plain = (
            F.when((comma > 0) & (dot > 0), F.when(comma < dot, F.translate(F.translate(s, ".", ""), ",", ".")).otherwise(F.translate(s, ",", "")))
            .when(comma > 0, F.when((commas > 1) | (comma == 4), F.translate(s, ",", "")).otherwise(F.translate(s, ",", ".")))
            .when((dots > 1) | ((dots == 1) & currency & (dot == 4)), F.translate(s, ".", ""))
            .otherwise(s)
        )
        return plain.try_cast("double")

    of = lambda x: F.when(x["s"].rlike(_FIGURES), value(x["s"], x["currency"]))
    bare = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, _CURRENCY, ""), _UNIT, ""), "[\\s\u00a0]", "")
    # most texts are figures alone, which have no currency, unit or blank to take off, and many need no look at their separators
    dressed = lambda t: let(F.struct(bare(t).alias("s"), t.rlike(_CURRENCY).alias("currency")), of)
    return let(F.trim(text), lambda t: F.when(t.rlike(_AS_IS), t.try_cast("double")).when(t.rlike(_FIGURES), value(t, F.lit(False))).when(t.rlike("[0-9]"), dressed(t)))


def integer(text: Column) -> Column:
    """The number's whole part, towards zero."""
    return let(number(text), lambda n: F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)))


def flag(text: Column) -> Column:
    """Yes or no; blank is no, and any other text is whether it is a number other than 0."""
    return let(F.lower(F.trim(F.coalesce(text, F.lit("")))), _flag)


def _flag(s: Column) -> Column:
    return F.when(s == "", False).when(s.isin(*YES), True).when(s.isin(*NO), False).otherwise(F.coalesce(number(s) != 0, F.lit(False)))


def flag_or_null(text: Column) -> Column:
    """Yes, no, or NULL for a blank or unknown word."""
    s = F.lower(F.trim(text))
    return F.when(s.isin(*YES), True).when(s.isin(*NO), False)


def calendar_date(text: Column) -> Column:
    """ISO, ``Date(y,m0,d)``, dd/mm/yyyy or a sheet serial; NULL unless the day exists."""
    s = F.trim(text)
    parts = [F.regexp_extract(s, r"^Date\((\d+),(\d+),(\d+)", i).try_cast("int") for i in (1, 2, 3)]
    serial = lambda n: F.when((n > 20000) & (n < 80000), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(n).cast("int")))
    return (
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))
        .when(s.rlike(r"^Date\(\d+,\d+,\d+"), F.try_to_date(F.format_string("%04d-%02d-%02d", parts[0], parts[1] + 1, parts[2]), "yyyy-MM-dd"))
        .when(s.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(s, "dd/MM/yyyy"))
        .when(s.rlike(r"^[0-9][0-9.,]*$"), let(number(s), serial))
    )


def month_key(text: Column) -> Column:
    """``yyyy-MM`` of an ISO date or month, ``Date(y,m0..)`` or mm/yyyy; NULL for a month that isn't."""
    s = F.trim(text)
    of = lambda year, month: F.when(month.between(1, 12), F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0")))
    return (
        F.when(s.rlike(r"^\d{4}-\d{2}"), of(F.substring(s, 1, 4), F.substring(s, 6, 2).try_cast("int")))
        .when(s.rlike(r"^Date\(\d{4},\d"), of(F.substring(s, 6, 4), F.regexp_extract(s, r"^Date\(\d{4},(\d+)", 1).try_cast("int") + 1))
        .when(s.rlike(r"^\d{1,2}/\d{4}$"), of(F.substring(s, -4, 4), F.substring_index(s, "/", 1).try_cast("int")))
    )


def coordinate(lat: Column, lon: Column) -> Column:
    """struct(lat, lon), NULL for half a pair, out of range, or (0, 0)."""
    ok = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon")))


def price_per_area(price: Column, area: Column, informed: Column, tolerance: float = 0.05) -> Column:
    """struct(value, computed, divergence, mismatch): an informed price wins over the computed one."""
    informed = F.when(informed > 0, informed)
    computed = F.when((price > 0) & (area > 0), F.try_divide(price, area))
    apart = F.try_divide(F.abs(computed - informed), informed)
    return F.struct(F.coalesce(informed, computed).alias("value"), computed.alias("computed"), apart.alias("divergence"), F.coalesce(apart > tolerance, F.lit(False)).alias("mismatch"))


def price(text: Column, area: Column, per_area: Column) -> Column:
    """A price whose one dot may part thousands: taken so if that is nearer to per_area * area."""
    return let(number(text), lambda n: _price(n, text, area, per_area))


def _price(n: Column, text: Column, area: Column, per_area: Column) -> Column:
    unclear = F.regexp_replace(text, r"\s", "").rlike(r"^-?\d{1,3}\.\d{3}$") & ~text.rlike(_CURRENCY) & (area > 0) & (per_area > 0)
    return F.when(unclear & (F.abs(1000 * n - area * per_area) < F.abs(n - area * per_area)), 1000 * n).otherwise(n)


def fraction(n: Column) -> Column:
    """struct(value, flag): up to 1 as it is, up to 100 as percentage points, beyond that unclear."""
    return F.struct(
        F.when(F.abs(n) <= 1, n).when(F.abs(n) <= 100, n / 100).otherwise(n).alias("value"),
        F.when((F.abs(n) > 1) & (F.abs(n) <= 100), "ESCALA_CONVERTIDA").when(F.abs(n) > 100, "ESCALA_INDETERMINADA").alias("flag"),
    )


def first_filled(*columns: Column) -> Column:
    """The first column that isn't blank: a canonical name before its aliases."""
    return F.coalesce(*map(filled, columns))


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(F.trim(text)), _ACCENTED, _PLAIN)


def slug(text: Column) -> Column:
    """Accent-free words joined by underscores."""
    return F.regexp_replace(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def roman(n: Column) -> Column:
    """Roman numeral of 1 to 399."""
    digit = lambda d, one, five, ten: F.element_at(F.array(*map(F.lit, ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten))), d.cast("int") + 1)
    return F.when(n.between(1, 399), F.concat(digit(F.floor(n / 100), "C", "D", "M"), digit(F.floor(n / 10) % 10, "X", "L", "C"), digit(n % 10, "I", "V", "X")))


def region_number(code: Column) -> Column:
    """Number of a code such as ``RA-XIX``; only the canonical numeral counts."""
    return let(F.trim(F.regexp_replace(F.upper(F.trim(code)), r"^RA[-\s]*", "")), lambda numeral: let(_roman_value(numeral), lambda value: F.when(numeral.rlike("^[IVXLC]+$") & (roman(value) == numeral), value)))


def _roman_value(numeral: Column) -> Column:
    return F.aggregate(
        F.reverse(F.filter(F.split(numeral, ""), lambda c: c != "")),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda a, c: let(F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000), strict=True) for x in p)), c), F.lit(0)), lambda v: F.struct((a["sum"] + F.when(v < a["last"], -v).otherwise(v)).alias("sum"), v.alias("last"))),
    )["sum"]


def region_id(n: Column) -> Column:
    """``RA_nn``."""
    return F.concat(F.lit("RA_"), F.substring(F.concat(F.lit("0"), n.cast("int").cast("string")), -2, 2))


def orientation(kind: Column) -> Column:
    """Vertical or horizontal, by property type."""
    key = F.lower(F.trim(kind))
    return F.when(key.isin(*VERTICAL), "vertical").when(key.isin(*HORIZONTAL), "horizontal")


def approximate(precision: Column, confidence: Column, status: Column) -> Column:
    """Whether a position is only roughly known."""
    p, c, s = (F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (precision, confidence, status))
    return ~(p.rlike(EXACT) & ~(c.rlike(DOWNGRADING) | s.rlike(DOWNGRADING) | s.rlike("geocode")))


def band(n: Column, edges: Sequence[float], names: Sequence[str], missing: str) -> Column:
    """Half-open bands; the last one is open."""
    out = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names[:-1], strict=True))):
        out = F.when(n < edge, name).otherwise(out)
    return F.when(n.isNull(), missing).otherwise(out)


def class_index(n: Column, breaks: Sequence[float], zero_is_absent: bool = False) -> Column:
    """Number of breaks that are not above the value; a value on a break goes up."""
    absent = n.isNull() | F.isnan(n) | (F.abs(n) == math.inf) | (F.lit(zero_is_absent) & (n == 0))
    return F.when(~absent, F.size(F.filter(F.array(*map(F.lit, breaks)), lambda b: n >= b)))


def change(new: Column, old: Column, digits: int = 4) -> Column:
    """Relative change; NULL where the old value is NULL or 0."""
    return F.bround(ratio(new - old, old), digits)


def canonical_url(url: Column) -> Column:
    """Without query and fragment, host in lower case; NULL unless http(s)."""
    s = F.trim(url)
    head, rest = F.lower(F.regexp_extract(s, r"(?i)^(https?://[^/?#]*)", 1)), F.regexp_extract(s, r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    return F.when(s.rlike(r"(?i)^https?://[^/?#\s]+"), F.concat(head, rest))


def url_host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def jitter(key: Column, lat: Column, lon: Column, most: float = 0.004) -> Column:
    """A point near (lat, lon) that follows from the key."""
    h = F.sha2(key, 256)
    part = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("double") / 0xFFFFFFFF
    angle, radius = part(1) * 2 * math.pi, F.sqrt(part(9)) * most
    return F.struct(F.round(lat + radius * F.sin(angle), 6).alias("lat"), F.round(lon + radius * F.cos(angle) / F.cos(F.radians(lat)), 6).alias("lon"))


def property_bag(text: Column) -> Column:
    """A JSON object as a map of texts; NULL for an array, a scalar or broken JSON."""
    return F.when(F.trim(text).startswith("{"), F.from_json(text, "map<string,string>"))


def label(segment: Column, category: Column) -> Column:
    """``segment · category``, the segment alone where they are equal but for case."""
    return F.when(F.lower(segment) == F.lower(category), segment).otherwise(F.concat_ws(" · ", segment, category))


def guarded(text: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(text.rlike(r"^[=+@\t\r-]"), F.concat(F.lit("'"), text)).otherwise(text)


def unguarded(text: Column) -> Column:
    return F.regexp_replace(text, r"^'(?=[=+@\t\r-])", "")
