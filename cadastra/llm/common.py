"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.registry import dealt
from cadastra.session import cut, shared_folder

#: Hot keys are the HOT largest ones, if they have more than HOT_LEAST rows; any other key has less than 1 / HOT of all rows.
HOT, HOT_LEAST = 10_000, 200
#: Places that a hot key's rows are dealt to.
SALTS = 64
#: Labels that have a smaller label themselves may be broadcast up to this many.
LABELS = 200_000
#: Graphs of up to so many ids have their labels broadcast.
IDS = 100_000


__all__ = ["components", "cut", "hot_keys", "shared_folder", "small", "spread_join", "table", "total_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, over all cores even if it is small."""
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def hot_keys(counts: DataFrame, on: Sequence[str], n: str = "count") -> DataFrame | None:
    """The HOT largest keys of ``counts`` (a row a key, ``n`` its rows) with more than HOT_LEAST rows; None if there is none.

    As there are HOT of them at most, they may go to the driver and be broadcast.
    """
    found = counts.filter(F.col(n) > HOT_LEAST).orderBy(F.desc(n), *on).limit(HOT).select(*on)
    rows = found.collect()
    return found.sparkSession.createDataFrame(rows, found.schema) if rows else None


def spread_join(many: DataFrame, one: DataFrame, on: Sequence[str], hot: DataFrame | None, deal: Sequence[str], how: str = "inner") -> DataFrame:
    """``many.join(one, on, how)`` where the rows of the ``hot`` keys are dealt to SALTS places.

    ``hot`` has at most HOT keys (``hot_keys``), so it is broadcast; the rows of ``one`` with such a
    key are repeated in each place. ``deal`` names the columns of ``many`` whose hash picks the place.
    """
    if hot is None:
        return many.join(one, list(on), how)
    mark = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    place = F.when(F.col("_hot"), F.pmod(F.xxhash64(*deal), F.lit(SALTS)).cast("int")).otherwise(0)
    places = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = many.join(mark, list(on), "left").withColumn("_place", place).drop("_hot")
    right = one.join(mark, list(on), "left").withColumn("_place", F.explode(places)).drop("_hot")
    return left.join(right, [*on, "_place"], how).drop("_place")


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def total_of(c: Column) -> Column:
    """Sum of long numbers, wide enough for any number of them."""
    return F.sum(c.cast("decimal(38,0)"))


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable id of every id in ``links(a, b)``: columns ``v, component``.

    Each round follows the label's own label and takes the smallest label among the neighbours, until no
    label changes. The labels of ``IDS`` ids or fewer are broadcast, so that a round is one shuffle of few
    tasks, of which the driver keeps a record each. Of more ids the links of a hub are dealt out; the labels
    that have a smaller one themselves are broadcast while they are few, and else the members of a large
    component, which share a label, are dealt out too. Minima are made partly before the shuffle.
    """
    pairs = F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")))  # an id is its own neighbour
    edges = cut(links.select("a", "b").filter("a <> b").select(F.inline(pairs)).distinct())
    now = cut(edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("l")))
    total, ids = now.agg(total_of(F.col("l")), F.count("*")).first()
    hubs = hot_keys(edges.groupBy("b").count(), ["b"]) if ids > IDS else None
    before = None
    while total != before:
        before = total
        if ids <= IDS:
            up = now.join(F.broadcast(now.select(F.col("v").alias("l"), F.col("l").alias("up"))), "l").select(F.col("v").alias("b"), "up")
            now = cut(edges.join(F.broadcast(up), "b").groupBy(F.col("a").alias("v")).agg(F.min("up").alias("l")))
        else:
            now = _relabelled(edges, now, hubs)
        total = now.agg(total_of(F.col("l"))).first()[0]
    return now.withColumnRenamed("l", "component")


def _relabelled(edges: DataFrame, now: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """A round over any number of ids."""
    low = spread_join(edges, now.withColumnRenamed("v", "b"), ["b"], hubs, ["a"]).groupBy("a").agg(F.min("l").alias("m"))
    now = cut(now.join(low, F.col("v") == F.col("a")).select("v", F.least("l", "m").alias("l")))
    labels = now.groupBy("l").count()
    up = cut(labels.join(now.select(F.col("v").alias("l"), F.col("l").alias("up")), "l").filter("up < l"))
    if up.count() > LABELS:
        return cut(spread_join(now, up.select("l", "up"), ["l"], hot_keys(up, ["l"]), ["v"], "left").select("v", F.coalesce("up", "l").alias("l")))
    # the next round reads the join as it is
    return now.join(F.broadcast(up.select("l", "up")), "l", "left").select("v", F.coalesce("up", "l").alias("l"))
