"""Exact percentiles, ranks and pages without a task that holds a group or the whole table.

Distinct values are counted first, a group's and a value's rows as one. The counted rows are cut into ranges
of the value, each of about as many rows; sums a (group, range) tell in which range a position lies, and only
the ranges that are hit are sorted. A group that holds nearly all rows is so spread over nearly all ranges.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastra.session import cut

#: Counted rows of a range, and ranges at most (cut points go through the driver).
ROWS, RANGES = 100_000, 2_000


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on keys that may be NULL; the left keys stay."""
    if not keys:
        return left.join(F.broadcast(right), how=how)  # without keys the right side has one row
    named = right.withColumnsRenamed({k: f"_{i}_key" for i, k in enumerate(keys)})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(named[f"_{i}_key"]) for i, k in enumerate(keys)])
    return left.join(named, on, how).drop(*(f"_{i}_key" for i in range(len(keys))))


def _counted(df: DataFrame, keys: Sequence[str], value: Column, rows: int) -> tuple[DataFrame, DataFrame]:
    """``keys, _v, _n, _part`` of every distinct value of a group, and ``keys, _part, _s, _before, _total`` of every range of a group."""
    counted = cut(df.select(*keys, value.cast("double").alias("_v")).filter("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_n")))
    parts = min(RANGES, -(-counted.count() // rows))
    cuts = sorted({c for c in counted.approxQuantile("_v", [i / parts for i in range(1, parts)], 0.25 / parts)}) if parts > 1 else []
    parted = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_v", outputCol="_part").transform(counted) if cuts else counted.withColumn("_part", F.lit(0.0))
    sums = parted.groupBy(*keys, "_part").agg(F.sum("_n").alias("_s"))
    own = Window.partitionBy(*keys)  # a row a range of the group
    before = F.coalesce(F.sum("_s").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parted, sums.withColumn("_before", before).withColumn("_total", F.sum("_s").over(own))


def group_percentiles(df: DataFrame, keys: Sequence[str], value: Column, at: Sequence[float], names: Sequence[str], rows: int = ROWS) -> DataFrame:
    """``keys`` and the interpolated percentiles ``at`` of each group with a value, as ``names``."""
    parted, sums = _counted(df, keys, value, rows)
    place = lambda p: F.lit(float(p)) * (F.col("_total") - 1)
    wanted = F.array_distinct(F.array(*(f(place(p)).cast("long") for p in at for f in (F.floor, F.ceil))))
    hits = sums.withColumn("_wanted", F.filter(wanted, lambda i: (i >= F.col("_before")) & (i < F.col("_before") + F.col("_s")))).filter(F.size("_wanted") > 0)
    inside = null_safe(parted, hits.select(*keys, "_part", "_before", "_total", "_wanted"), [*keys, "_part"], "inner")
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("_upto", upto).select(*keys, "_total", "_v", F.explode(F.filter("_wanted", lambda i: (i < F.col("_upto")) & (i >= F.col("_upto") - F.col("_n")))).alias("_i"))
    of = found.groupBy(*keys).agg(F.first("_total").alias("_total"), F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_m"))  # a few positions a group

    def between(p: float) -> Column:
        low, high = F.floor(place(p)).cast("long"), F.ceil(place(p)).cast("long")
        below, above = F.element_at("_m", low), F.element_at("_m", high)
        return F.when(low == high, below).otherwise((high - place(p)) * below + (place(p) - low) * above)

    return of.select(*keys, *(between(p).alias(n) for p, n in zip(at, names, strict=True)))


def with_percentiles(groups: DataFrame, df: DataFrame, keys: Sequence[str], value: Column, at: Sequence[float], names: Sequence[str], rows: int = ROWS) -> DataFrame:
    """``groups``, a row a group of ``keys``, with percentiles of ``df``'s values; NULL where a group has none."""
    return null_safe(groups, group_percentiles(df, keys, value, at, names, rows), keys)


def group_ranks(df: DataFrame, keys: Sequence[str], value: str, rows: int = ROWS) -> DataFrame:
    """``df``'s rows with a value, and how many of their group are ``below``, how many are the ``same``, and ``of`` how many."""
    parted, sums = _counted(df, keys, F.col(value), rows)
    inside = null_safe(parted, sums.select(*keys, "_part", "_before", "_total"), [*keys, "_part"], "inner")
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = inside.select(*keys, "_v", (F.col("_before") + upto - F.col("_n")).alias("below"), F.col("_n").alias("same"), F.col("_total").alias("of"))
    has = df.filter(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    return null_safe(has, placed, [*keys, "_v"], "inner").drop("_v")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int, ranges: int = 200) -> DataFrame:
    """A 1-based page in ascending ``order`` (NULLs first); a page beyond the end is the last.

    Keys are cut into ranges by a sample and counted a range; only rows of the ranges that the page lies in
    are sorted. The order must tell all rows apart, else equal ones may be cut between two pages.
    """
    keyed = df.withColumn("_key", F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order))))
    n = df.count()
    last = max(1, -(-n // size))
    start = (min(max(1, number), last) - 1) * size
    cuts: list = []
    if n > ranges:
        sample = keyed.select("_key").sample(fraction=min(1.0, 20 * ranges / n), seed=7).distinct().orderBy("_key").collect()  # some 20 keys a range
        step = max(1, len(sample) // ranges)
        cuts = [r["_key"] for r in sample[step::step]]
    if not cuts:
        return keyed.orderBy("_key").offset(start).limit(size).drop("_key")
    spark, kind = df.sparkSession, keyed.schema["_key"].dataType
    bounds = spark.createDataFrame([(i, c) for i, c in enumerate(cuts)], f"_i int, _cut {kind.simpleString()}").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_cut"))), lambda x: x["_cut"]).alias("_cuts"))
    # one row of at most ``ranges`` cut points, met by halving
    steps = range(math.ceil(math.log2(len(cuts) + 1)))
    low, high = F.lit(0), F.lit(len(cuts))
    search = F.aggregate(F.array(*map(F.lit, steps)), F.struct(low.alias("a"), high.alias("b")), lambda s, _: F.when(s["a"] >= s["b"], s).otherwise(
        F.when(F.get("_cuts", F.floor((s["a"] + s["b"]) / 2).cast("int")) <= F.col("_key"), F.struct((F.floor((s["a"] + s["b"]) / 2).cast("int") + 1).alias("a"), s["b"].alias("b")))
        .otherwise(F.struct(s["a"].alias("a"), F.floor((s["a"] + s["b"]) / 2).cast("int").alias("b")))))["a"]
    ranged = keyed.join(F.broadcast(bounds)).withColumn("_range", search).drop("_cuts")
    counts = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    before, hit = 0, []
    skipped = 0
    for r in range(len(cuts) + 1):
        own = counts.get(r, 0)
        if before + own > start and before < start + size:
            if not hit:
                skipped = before
            hit.append(r)
        before += own
    return ranged.filter(F.col("_range").isin(hit)).orderBy("_key").offset(start - skipped).limit(size).drop("_key", "_range")
