"""Stream twins: a finite replay of events in Parquet; the days that close are compared with the batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators import coverage
from cadastra.plans.web import EVENT_KINDS, FOLD, checks
from cadastra.registry import query, table
from cadastra.session import shared_folder
from cadastra.streaming import lifecycle, traffic

_CLOSED = "(SELECT CAST(max(ts) - INTERVAL 1 HOUR AS DATE) FROM events)"


def replayed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Run a stream over what is there and read what it wrote."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    run = rows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


@query(f"SELECT event_type, CAST(ts AS DATE) AS day, round(sum(value), 2) AS flow, count(*) AS rows FROM events WHERE CAST(ts AS DATE) < {_CLOSED} GROUP BY 1, 2")
def stream_daily_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = traffic.read_events(spark, f"{sf_dir}/events.parquet")
    return replayed(spark, traffic.daily_flow(events, "event_type")).selectExpr("event_type", "day", "round(flow, 2) AS flow", "rows")


@query(f"""WITH q AS (SELECT CAST(ts AS DATE) AS day, hour(ts) * 4 + minute(ts) // 15 AS quarter, sum(value) AS flow FROM events WHERE CAST(ts AS DATE) < {_CLOSED} GROUP BY 1, 2)
SELECT day, count(*) AS intervals, round(sum(flow), 2) AS flow, CASE WHEN count(*) >= 96 THEN 'complete' ELSE 'partial' END AS coverage FROM q GROUP BY 1""")
def stream_interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = traffic.read_events(spark, f"{sf_dir}/events.parquet")
    return replayed(spark, traffic.interval_coverage(events)).selectExpr("day", "intervals", "round(flow, 2) AS flow", "coverage")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_unique_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event arrives twice and is kept once."""
    events = traffic.read_events(spark, f"{sf_dir}/events.parquet")
    return replayed(spark, traffic.unique(events.union(events), "event_id").select("event_id", "user_id", "event_type"))


@query(f"{FOLD} SELECT listing, deactivated, reactivated, price_change, price_unconfirmed FROM done WHERE deactivated + reactivated + price_change + price_unconfirmed > 0")
def stream_listing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all listings from checks that arrive in no order, in several batches; a last row moves the time on."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = checks(spark, sf_dir)
    rows.repartition(4, F.xxhash64("seq", F.lit("mixed"))).sortWithinPartitions(F.xxhash64("seq")).write.parquet(f"{folder}/in")
    end = rows.agg(F.lit(-1).cast(rows.schema["listing"].dataType).alias("listing"), (F.max("at") + F.expr("INTERVAL 5000 DAYS")).alias("at"), F.lit(0).cast("long").alias("seq"), F.lit("blocked").alias("outcome"), F.lit(None).cast("double").alias("price"))
    end.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    conf, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(conf, lifecycle.STORE)
    try:
        arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
        events = replayed(spark, lifecycle.lifecycle_unordered(arriving, "4000 days"))
    finally:
        spark.conf.set(conf, before)
    return events.groupBy("listing").agg(*(F.count_if(F.col("event") == e).cast("int").alias(e) for e in EVENT_KINDS))


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, o_custkey AS listing, count(*) AS n, CAST(arg_max(o_orderstatus, (CAST(o_orderdate AS DATE), o_orderkey)) AS VARCHAR) AS status FROM orders GROUP BY 1, 2""".replace("count(*) AS n, ", ""))
def stream_closed_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months closed by a stream from orders that arrive in parts, each month's newest row of a customer."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    seen = F.struct(F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("key"))
    rows = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("reference_month"), F.col("o_custkey").alias("id"), seen.alias("seen"), F.col("o_orderstatus").alias("status"))
    rows.repartition(3, F.xxhash64("seen")).write.parquet(f"{folder}/in")
    coverage.close_months(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state")
    return spark.read.schema(rows.schema).parquet(f"{folder}/out").select(F.col("reference_month").alias("month"), F.col("id").alias("listing"), "status")
