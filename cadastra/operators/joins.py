"""Joins with a rule: editions, bridges, fallbacks, pairing, first wins, conflicts, validity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastra.functions.scalar import canonical_url, ratio, slug


def editions(old: DataFrame, new: DataFrame, key: str, values: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """Both editions of every key side by side, with a flag for each that is missing; changes follow."""
    a = old.select(key, *(F.col(v).alias(f"{v}_{names[0]}") for v in values), F.lit(True).alias("in_old"))
    b = new.select(key, *(F.col(v).alias(f"{v}_{names[1]}") for v in values), F.lit(True).alias("in_new"))
    out = a.join(b, key, "full_outer")
    flags = F.array_compact(F.array(F.when(F.col("in_old").isNull(), f"missing_{names[0]}"), F.when(F.col("in_new").isNull(), f"missing_{names[1]}")))
    x, y = (lambda v: F.col(f"{v}_{names[0]}")), (lambda v: F.col(f"{v}_{names[1]}"))
    deltas = [c for v in values for c in ((y(v) - x(v)).alias(f"{v}_delta"), F.bround(ratio(y(v) - x(v), x(v)), 4).alias(f"{v}_change"))]
    return out.select("*", *deltas, flags.alias("flags")).drop("in_old", "in_new")


def translate(df: DataFrame, code: str, bridge: DataFrame, aliases: Sequence[str], canonical: str) -> DataFrame:
    """The canonical key of a code that may be any of the bridge's aliases; an unknown code gives NULL."""
    keys = bridge.select(F.col(canonical).alias("canonical"), F.explode(F.array_distinct(F.array(*(F.upper(F.trim(F.col(a).cast("string"))) for a in aliases)))).alias("alias")).filter("alias is not null")
    single = keys.groupBy("alias").agg(F.min("canonical").alias("canonical"))
    return df.join(single, F.upper(F.trim(F.col(code))) == F.col("alias"), "left").drop("alias")


def with_blocks(spine: DataFrame, key: str, blocks: dict[str, DataFrame]) -> DataFrame:
    """Every row of the spine with the columns of each block, and ``missing`` names the absent ones."""
    out, flags = spine, []
    for name, block in blocks.items():
        out = out.join(block.withColumn(f"has_{name}", F.lit(True)), key, "left")
        flags.append(F.when(F.col(f"has_{name}").isNull(), f"{name}_missing"))
    return out.withColumn("missing", F.array_compact(F.array(*flags))).drop(*(f"has_{n}" for n in blocks))


def first_wins(df: DataFrame, keys: Sequence[str], position: Column) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and the keys that repeat with the number of rows dropped."""
    w = Window.partitionBy(*keys).orderBy(position)
    kept = df.withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_i")
    return kept, df.groupBy(*keys).agg((F.count("*") - 1).alias("dropped")).filter("dropped > 0")


def without_conflicts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that share no key value with another row; NULLs conflict with nothing."""
    out = df
    for k in keys:
        repeated = df.filter(F.col(k).isNotNull()).groupBy(k).count().filter("count > 1").select(k)
        out = out.join(repeated, k, "left_anti")
    return out


def paired(df: DataFrame, keys: Sequence[str], deal: str, value: str, sale: str, rent: str) -> DataFrame:
    """Sale and rent of a key side by side, the yield, and which side is missing."""
    side = lambda k: F.max(F.when(F.col(deal) == k, F.col(value)))
    out = df.filter(F.col(deal).isin(sale, rent)).groupBy(*keys).agg(side(sale).alias("sale"), side(rent).alias("rent"))
    quality = F.when(F.col("rent").isNull(), "partial_sale_only").when(F.col("sale").isNull(), "partial_rent_only").otherwise("ok")
    return out.select(*keys, "sale", "rent", ratio(F.col("rent"), F.col("sale")).alias("monthly"), (12 * ratio(F.col("rent"), F.col("sale"))).alias("yearly"), quality.alias("quality"))


def latest(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row of each key that is last in an order; a max_by with partial sums, no window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def valid_to(df: DataFrame, entity: str, start: str) -> DataFrame:
    """Each version with the start of the next; only the last is active."""
    end = F.lead(start).over(Window.partitionBy(entity).orderBy(start))
    return df.withColumn("valid_to", end).withColumn("active", F.col("valid_to").isNull())


def match_existing(incoming: DataFrame, row: str, candidates: Sequence[str], existing: DataFrame, key: str, ident: str) -> DataFrame:
    """The existing row that the first candidate key of an incoming row meets, or NULL."""
    keys = incoming.select(row, F.posexplode(F.array(*candidates)).alias("priority", "key")).filter("key is not null")
    hit = keys.join(existing.select(F.col(key).alias("key"), F.col(ident).alias("existing")), "key").groupBy(row).agg(F.min_by("existing", F.struct("priority", "existing")).alias("existing"))
    return incoming.join(hit, row, "left")


def known_listings(incoming: DataFrame, row: str, existing: DataFrame, ident: str) -> DataFrame:
    """``row, existing, matched_by`` of the incoming listings that are known already; of several the smallest ``ident``.

    Both sides have ``portal, token, url``. The token of the same portal (compared as slugs, so that case
    and accents don't count) comes first, then the address without query and fragment. A blank token and an
    address that isn't http(s) match nothing. The keys are hashed before the existing ones are grouped, so
    long addresses don't travel.
    """
    token = F.trim(F.coalesce("token", F.lit("")))
    named = F.when((token != "") & (slug(F.col("portal")) != ""), F.sha2(F.concat_ws("|", F.lit("token"), slug(F.col("portal")), token), 256))
    address = F.when(canonical_url(F.col("url")).isNotNull(), F.sha2(F.concat_ws("|", F.lit("address"), canonical_url(F.col("url"))), 256))
    keys = lambda df, c: df.select(c, F.explode(F.array_compact(F.array(F.struct(F.lit(0).alias("order"), named.alias("key")), F.struct(F.lit(1).alias("order"), address.alias("key"))))).alias("k")).select(c, "k.*").filter("key is not null")
    known = keys(existing, ident).groupBy("key").agg(F.min(ident).alias("existing"))
    found = keys(incoming, row).join(known, "key").groupBy(row).agg(F.min(F.struct("order", "existing")).alias("hit"))
    return found.select(row, F.col("hit.existing").alias("existing"), F.when(F.col("hit.order") == 0, "token").otherwise("address").alias("matched_by"))


def dominant(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """The value seen most often with a key; ties go to the one seen first."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def all_of(values: DataFrame, ident: str, attribute: str, rules: dict[str, Column]) -> DataFrame:
    """Ids for which every attribute has a value that passes its rule (entity-attribute-value rows)."""
    passes = F.lit(False)
    for name, rule in rules.items():
        passes = passes | ((F.col(attribute) == name) & rule)
    return values.filter(passes).groupBy(ident).agg(F.count_distinct(attribute).alias("n")).filter(F.col("n") == len(rules)).select(ident)


def attributes(values: DataFrame, ident: str, attribute: str, value: str, names: Sequence[str]) -> DataFrame:
    """Entity-attribute-value rows as a column an attribute."""
    return values.groupBy(ident).pivot(attribute, list(names)).agg(F.first(value, ignorenulls=True))


def enriched(df: DataFrame, other: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with the columns of ``other`` (a row a key), and one row ``matched, left_only, right_only``."""
    marked = other.withColumn("_right", F.lit(True))
    sides = df.select(key).distinct().withColumn("_left", F.lit(True)).join(marked.select(key, "_right"), key, "full_outer")
    both, left = F.col("_left").isNotNull() & F.col("_right").isNotNull(), F.col("_right").isNull()
    counts = sides.agg(F.count_if(both).alias("matched"), F.count_if(left).alias("left_only"), F.count_if(F.col("_left").isNull()).alias("right_only"))
    return df.join(other, key, "left"), counts


def resolved(df: DataFrame, text: str, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the ``id`` of their place, and those that have none.

    ``places(id, code, legacy, name)``: a text is looked for as an id, then as a code, an old code and a
    name without accents; the smallest id of equal ones is taken.
    """
    from cadastra.functions.scalar import fold

    keys = F.array(*(F.struct(F.lit(i).alias("rank"), k.alias("k")) for i, k in enumerate((F.col("id").cast("string"), F.col("code"), F.col("legacy"), fold(F.col("name"))))))
    known = places.select("id", F.explode(keys).alias("x")).filter("x.k is not null and x.k <> ''").select("id", "x.rank", "x.k").groupBy("rank", "k").agg(F.min("id").alias("id"))
    best = known.groupBy("k").agg(F.min(F.struct("rank", "id")).alias("b"))
    name = known.filter("rank = 3").select(F.col("k").alias("folded"), F.col("id").alias("by_name"))
    exact = best.filter("b.rank < 3").select(F.col("k").alias("_k"), F.col("b.id").alias("by_key"))
    t = F.trim(F.col(text))
    out = df.withColumn("_k", t).withColumn("folded", fold(t)).join(exact, "_k", "left").join(name, "folded", "left").withColumn("place_id", F.coalesce("by_key", "by_name")).drop("_k", "folded", "by_key", "by_name")
    return out.filter("place_id is not null"), out.filter("place_id is null").drop("place_id").withColumn("reason", F.lit("unknown_place"))
