"""Statistics of groups and ranks: percentiles, suppression of small samples, classes, positions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastra.functions.scalar import ratio
from cadastra.operators.selection import group_ranks, with_percentiles


def comparables(df: DataFrame, keys: Sequence[str], value: str, active: Column, seen: Column, today: Column, recent_days: int = 90) -> DataFrame:
    """Size of the sample, how many have a value, are active and recent, and five points of the values."""
    base = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count(value).alias("n_value"), F.count_if(active).alias("n_active"), F.count_if(F.datediff(today, seen).between(0, recent_days)).alias("n_recent"),
        F.min(value).alias("least"), F.max(value).alias("most"),
    )
    return with_percentiles(base, df, keys, F.col(value), (0.25, 0.5, 0.75), ("p25", "median", "p75"))


def suppressed(df: DataFrame, keys: Sequence[str], value: str, for_median: int = 5, for_quartiles: int = 10) -> DataFrame:
    """Median and quartiles where the sample is large enough, and the reason where it isn't."""
    found = with_percentiles(df.groupBy(*keys).agg(F.count(value).alias("n")), df, keys, F.col(value), (0.25, 0.5, 0.75), ("p25", "median", "p75"))
    n = F.col("n")
    return found.select(
        *keys, "n", F.when(n >= for_median, F.col("median")).alias("median"), F.when(n >= for_quartiles, F.col("p25")).alias("p25"), F.when(n >= for_quartiles, F.col("p75")).alias("p75"),
        F.when(n < for_median, "few_for_median").when(n < for_quartiles, "few_for_quartiles").alias("reason"),
    )


def midrank(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``rank_pct``: 100 * (number below + (number equal - 1) / 2) / (n - 1), 100 for a single row.

    Distinct values are counted first; the running count over them is taken in ranges of the value and
    carried across, so there is no window over all rows in one task.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("same"))
    below = running_total(counts, value, "same").withColumn("below", F.col("total") - F.col("same"))
    n = counts.agg(F.sum("same")).first()[0] or 0
    share = F.lit(100.0) if n <= 1 else 100.0 * (F.col("below") + (F.col("same") - 1) / 2) / (n - 1)
    return df.join(below.select(value, share.alias("rank_pct")), value, "left")


def running_total(df: DataFrame, order: str, amount: str, rows: int = 100_000) -> DataFrame:
    """``df`` with ``total``, the sum up to each row in the order of a column of distinct numbers.

    The rows are cut into ranges of about ``rows`` rows (2 000 ranges at most); a window covers one range.
    """
    parts = min(2_000, -(-df.count() // rows))
    cuts = sorted({c for c in df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.25 / parts) if c is not None}) if parts > 1 else []
    part = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_order", outputCol="part")
    parted = part.transform(df.withColumn("_order", F.col(order).cast("double"))).drop("_order") if cuts else df.withColumn("part", F.lit(0.0))
    sums = parted.groupBy("part").agg(F.sum(amount).alias("s"))  # a row a range
    before = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.sum(amount).over(Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return parted.withColumn("own", own).join(F.broadcast(before), "part").withColumn("total", F.col("own") + F.col("before")).drop("part", "own", "before")


def quantile_breaks(df: DataFrame, value: str, classes: int) -> list[float]:
    """classes - 1 cuts at position floor(i / classes * n) of the sorted values; none for fewer values."""
    ranked = running_total(df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("same")), value, "same")
    n = df.filter(F.col(value).isNotNull()).count()
    if n < classes:
        return []
    at = F.array(*(F.lit(i * n // classes) for i in range(1, classes)))
    hits = ranked.withColumn("i", F.explode(F.filter(at, lambda i: (i < F.col("total")) & (i >= F.col("total") - F.col("same")))))
    return [r[value] for r in hits.orderBy("i").select(value).collect()]  # classes - 1 rows


def ranked(df: DataFrame, value: str, *peers: str) -> DataFrame:
    """Place (1 + number greater), number ranked and gap to the median among peers; NULLs have no place."""
    placed = group_ranks(df, peers, value).withColumn("place", (F.col("of") - F.col("below") - F.col("same") + 1).cast("int")).drop("below", "same")
    return with_percentiles(placed, df, peers, F.col(value), (0.5,), ("median",)).withColumn("gap", F.col(value) - F.col("median"))


def top_two(df: DataFrame, value: str, name: str, *keys: str) -> DataFrame:
    """Leader, runner-up and the gap between them; ties by name. Two rows a key at most leave each task."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), name)
    two = df.filter(F.col(value).isNotNull()).withColumn("i", F.row_number().over(w)).filter("i <= 2")
    pick = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    return two.groupBy(*keys).agg(pick(name, 1).alias("leader"), pick(name, 2).alias("runner_up"), (pick(value, 1) - pick(value, 2)).alias("gap"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's over complete pairs; NULL for fewer than three or without variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x).cast("double"), F.when(both, y).cast("double")
    return F.when(F.count(a) >= 3, ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def cumulative_share(df: DataFrame, share: str, order: str, *keys: str) -> DataFrame:
    """Running sum of shares, 100 at most."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cumulative", F.least(F.lit(100.0), F.sum(share).over(w)))


def strict_sum(value: Column) -> Column:
    """NULL if any value is."""
    return F.when(F.count(value) == F.count("*"), F.sum(value))


def ruler(price: Column, p25: Column, p75: Column) -> Column:
    """Where a price lies between two quartiles: 0 to 1, a half if they are equal."""
    return F.when(p75 == p25, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio(price - p25, p75 - p25))))
