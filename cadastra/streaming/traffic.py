"""Traffic streams: quarter hours of a day, daily flow, and arrivals without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators.traffic import INTERVALS, coverage_class

DELAY = "1 hour"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files as they arrive, with a time that can carry a watermark."""
    table = spark.read.parquet(path)
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(table.schema)
    if [f.rpartition("/")[2] for f in table.inputFiles()] == [name]:  # one file: the stream reads its folder
        rows = stream.option("pathGlobFilter", name).parquet(folder)
    else:
        rows = stream.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def unique(events: DataFrame, *keys: str, delay: str = DELAY) -> DataFrame:
    """An id or logical key that arrives again within the watermark is left out."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def daily_flow(events: DataFrame, *keys: str, delay: str = DELAY) -> DataFrame:
    """Sum of each day, given out when the day closes; late rows are dropped by the watermark."""
    out = events.withWatermark("ts", delay).groupBy(*keys, F.window("ts", "1 day").alias("w")).agg(F.sum("value").alias("flow"), F.count("*").alias("rows"))
    return out.select(*keys, F.to_date("w.start").alias("day"), "flow", "rows")


def interval_coverage(events: DataFrame, *keys: str, delay: str = DELAY, complete: int = INTERVALS) -> DataFrame:
    """Quarter hours first, then their number a day: two chained windows in append mode."""
    quarters = events.withWatermark("ts", delay).groupBy(*keys, F.window("ts", "15 minutes").alias("q")).agg(F.sum("value").alias("flow"))
    out = quarters.groupBy(*keys, F.window(F.window_time("q"), "1 day").alias("w")).agg(F.count("*").alias("intervals"), F.sum("flow").alias("flow"))
    return out.select(*keys, F.to_date("w.start").alias("day"), "intervals", "flow", coverage_class(F.col("intervals"), complete).alias("coverage"))
