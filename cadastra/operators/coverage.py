"""Coverage cubes, monthly metrics, history and freshness of listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions.scalar import ratio
from cadastra.operators.selection import with_percentiles
from cadastra.session import cut


def cube(listings: DataFrame, coarse: Sequence[str], fine: Sequence[str], source: str) -> DataFrame:
    """Count and distinct sources by (coarse + fine) and by coarse alone, where fine is ``TODOS``, in one pass."""
    keys = [*coarse, *fine]
    level = F.grouping_id(*keys)
    out = listings.groupingSets([[*map(F.col, keys)], [*map(F.col, coarse)]], *keys).agg(F.count("*").alias("n"), F.count_distinct(source).alias("sources"), level.alias("level"))
    return out.select(*coarse, *(F.when(F.col("level") > 0, "TODOS").otherwise(F.col(f)).alias(f) for f in fine), "n", "sources")


def status(n: Column, sources: Column, thin: int = 3) -> Column:
    return F.when(n == 0, "none").when(n == 1, "single").when(n < thin, "thin").when(sources <= 1, "single_portal").otherwise("ok")


def with_spine(counts: DataFrame, *dimensions: DataFrame) -> DataFrame:
    """Every combination of the dimensions' values (registers of fixed size), 0 where nothing was counted."""
    spine = dimensions[0]
    for d in dimensions[1:]:
        spine = spine.crossJoin(d)  # dimension values only, never rows of a fact
    out = spine.join(counts, spine.columns, "left")
    return out.select(*spine.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in counts.columns if c not in spine.columns))


def monthly(listings: DataFrame, keys: Sequence[str], month: str, price: str, source: str, active: Column) -> DataFrame:
    """Per month and key: counts, price points and sources, and the change to the calendar month before."""
    p = F.when(active, F.col(price))
    now = listings.groupBy(*keys, month).agg(
        F.count("*").alias("n"), F.count_if(active).alias("active"), F.count_distinct(source).alias("sources"),
    )
    now = cut(with_percentiles(now, listings, [*keys, month], p, (0.25, 0.5, 0.75), ("p25", "median", "p75")))
    before = now.select(*keys, F.add_months(month, 1).cast("date").alias(month), F.col("median").alias("median_before"), F.col("active").alias("active_before"))
    out = now.join(before, [*keys, month], "left")
    return out.withColumn("median_change", ratio(F.col("median") - F.col("median_before"), F.col("median_before"))).withColumn("active_change", ratio(F.col("active") - F.col("active_before"), F.col("active_before")))


def history(snapshot: DataFrame, month_end: Column, inactive_at: str, seen: str) -> DataFrame:
    """Status at a month's end: inactive, active only if seen in that month, else unverified."""
    state = F.when(F.col(inactive_at) <= month_end, "inactive").when(F.trunc(seen, "month") == F.trunc(month_end, "month"), "active").otherwise("unverified")
    return snapshot.withColumn("status", state)


def close_month(history_rows: DataFrame, path: str) -> None:
    """Rewrite the months that the rows hold and leave older ones untouched.

    The rows are gathered by month, a large month over several tasks, so there are few files a month and not
    one from every task. Months are replaced once all is written, so the rows may come from them.
    """
    history_rows.hint("rebalance", "reference_month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("reference_month").parquet(path)


def close_months(updates: DataFrame, path: str, state: str) -> None:
    """``close_month`` as a stream job: take what has arrived, then stop.

    Each batch rewrites the months it holds from the rows of the months as they are and its own, the newest
    row of an ``id`` (by ``seen``) winning; a batch that is run again gives the same.
    """

    def close(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        months = [r[0] for r in batch.select("reference_month").distinct().collect()]  # a row a month of the batch
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        rows = batch
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            rows = spark.read.schema(batch.schema).parquet(path).filter(F.col("reference_month").isin(months)).unionByName(batch)
        rest = [c for c in batch.columns if c not in ("reference_month", "id")]
        newest = rows.groupBy("reference_month", "id").agg(F.max_by(F.struct(*rest), F.struct("seen", *rest)).alias("r"))
        close_month(newest.select("reference_month", "id", "r.*"), path)

    updates.writeStream.foreachBatch(close).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def freshness(df: DataFrame, today: Column, seen: str, active: Column, days: int = 7) -> DataFrame:
    """One row: how many are active, recently seen, and the period they span."""
    recent = F.datediff(today, F.col(seen)).between(0, days)
    return df.agg(F.count("*").alias("n"), F.count_if(active).alias("active"), F.count_if(recent).alias("recent"), F.min(seen).alias("first"), F.max(seen).alias("last"))


def expected_categories(observed: DataFrame, regions: DataFrame, indicators: DataFrame) -> DataFrame:
    """Categories loaded against the most seen for the indicator anywhere, for every region and indicator.

    ``observed(region, indicator, category, suppressed)``.
    """
    own = observed.groupBy("region", "indicator").agg(F.count_distinct("category").alias("loaded"), F.count_if("suppressed").alias("hidden"))
    expected = own.groupBy("indicator").agg(F.max("loaded").alias("expected"))
    out = regions.crossJoin(indicators).join(own, ["region", "indicator"], "left").join(expected, "indicator", "left")
    state = F.when(F.col("loaded").isNull(), "missing").when(F.col("hidden") >= F.col("loaded"), "suppressed_source").when(F.col("loaded") < F.col("expected"), "partial").otherwise("complete")
    return out.select("region", "indicator", F.coalesce("loaded", F.lit(0)).alias("loaded"), "expected", state.alias("state"))
