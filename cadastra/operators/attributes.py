"""Custom attributes: values of any type in one column, checked by a table of definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions import scalar as S

#: Definitions that are broadcast; beyond that they are joined by a shuffle.
DEFINED = 10_000
#: The kinds that a definition may have.
KINDS = ("number", "integer", "flag", "date", "option", "text")


def _read(kind: Column, value: Column, unit: Column, options: Column) -> Column:
    """struct(json, reason): the value as JSON of its kind, or why it can't be."""
    bare = F.when(unit.isNotNull() & F.lower(value).endswith(F.lower(unit)), F.trim(F.substr(value, F.lit(1), F.char_length(value) - F.char_length(unit)))).otherwise(value)
    amount = S.number(bare)
    text = lambda v: F.get(F.regexp_extract_all(F.to_json(F.struct(v.alias("v"))), F.lit(r"(?s)^\{\"v\":(.*)\}$"), F.lit(1)), 0)
    of = lambda json, reason: S.let(json.cast("string"), lambda j: F.struct(j.alias("json"), F.when(j.isNull(), reason).alias("reason")))
    whole = S.let(amount, lambda n: F.when(n == F.floor(n), F.floor(n)))
    chosen = F.get(F.filter(options, lambda o: F.lower(o) == F.lower(value)), 0)
    return (
        F.when(kind == "number", of(amount, "not_a_number")).when(kind == "integer", of(whole, "not_an_integer"))
        .when(kind == "flag", of(S.flag_or_null(value), "not_a_flag")).when(kind == "date", of(text(S.calendar_date(value).cast("string")), "not_a_date"))
        .when(kind == "option", of(text(chosen), "not_an_option")).when(kind == "text", of(text(value), "not_a_text")).otherwise(of(F.lit(None), "unknown_kind"))
    )


def typed(values: DataFrame, definitions: DataFrame) -> DataFrame:
    """``ident, attribute, value, reason`` of ``values(ident, attribute, value)`` of texts: a VARIANT of the defined kind, or the reason why it is rejected.

    ``definitions(attribute, kind, unit, options)`` has a row an attribute; a number may carry its unit, an
    option is taken in the case of the definition. A blank value is no value, and a definition that is there
    twice rejects its values as ``ambiguous_attribute``, one that isn't as ``unknown_attribute``.
    """
    one = definitions.groupBy("attribute").agg(*(F.first(c).alias(c) for c in ("kind", "unit", "options")), F.count("*").alias("defined"))
    known = F.broadcast(one) if definitions.limit(DEFINED + 1).count() <= DEFINED else one
    rows = values.select("ident", "attribute", F.trim("value").alias("text")).filter(~S.blank(F.col("text"))).join(known, "attribute", "left")
    read = F.when(F.col("defined").isNull(), F.struct(F.lit(None).cast("string").alias("json"), F.lit("unknown_attribute").alias("reason"))).when(
        F.col("defined") > 1, F.struct(F.lit(None).cast("string").alias("json"), F.lit("ambiguous_attribute").alias("reason"))
    )
    rows = rows.withColumn("r", read.otherwise(_read(F.col("kind"), F.col("text"), F.col("unit"), F.col("options"))))
    return rows.select("ident", "attribute", F.parse_json("r.json").alias("value"), "r.reason")


def matching(values: DataFrame, attribute: str, least: float | None = None, most: float | None = None, options: list[str] | None = None) -> DataFrame:
    """Idents whose typed value lies in a range of numbers or is one of the options; both bounds count."""
    v = F.col("value")
    amount, chosen = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
    good = F.lit(True)
    if least is not None:
        good = good & (amount >= least)
    if most is not None:
        good = good & (amount <= most)
    if options is not None:
        good = good & chosen.isin(options)
    return values.filter((F.col("attribute") == attribute) & F.col("reason").isNull() & good).select("ident").distinct()


def deflated(panel: DataFrame, rates: DataFrame, series: str, year: str, value: str, base: int) -> DataFrame:
    """``panel`` with ``real``, the value at prices of the year ``base``, by chained annual rates.

    ``rates(series, year, rate)`` has a row a series and year, few a series. The index from one year to another
    is the product of one plus the rates between; where a year between has no rate, the value is NULL.
    """
    from pyspark.sql.window import Window

    own = rates.filter(F.col("rate").isNotNull() & (F.col("rate") > -1)).groupBy(series, year).agg(F.max("rate").alias("rate"))
    named = own.select(series, year, F.log1p("rate").alias("g"), F.lit(1).alias("k"))
    # the base and the panel's own years have an index without a rate of their own
    empty = [F.lit(0.0).alias("g"), F.lit(0).alias("k")]
    based = named.select(series).distinct().select(series, F.lit(base).cast(named.schema[year].dataType).alias(year), *empty)
    named = named.unionByName(based).unionByName(panel.select(series, year, *empty).distinct()).groupBy(series, year).agg(F.sum("g").alias("g"), F.sum("k").alias("k"))
    upto = Window.partitionBy(series).orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    run = named.select(series, year, F.sum("g").over(upto).alias("g"), F.sum("k").over(upto).alias("k"))
    at_base = run.filter(F.col(year) == base).select(series, F.col("g").alias("g0"), F.col("k").alias("k0"))
    index = run.join(at_base, series).select(series, year, F.when(F.col("k") - F.col("k0") == F.col(year) - base, F.exp(F.col("g") - F.col("g0"))).alias("index"))
    joined = panel.join(index, [series, year], "left")
    factor = F.when(F.col(year) == base, 1.0).otherwise(F.col("index"))
    return joined.withColumn("real", S.ratio(F.col(value), factor)).drop("index")
