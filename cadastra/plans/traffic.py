"""Traffic from events: user_id % 5 = segment, parity of event_id = direction, event_type = class, value = flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators import traffic as T
from cadastra.registry import query, table

#: At sf0.01 no day has all 96 intervals; twelve make a day complete here.
COMPLETE = 12
_E = "e AS (SELECT ts, CAST(ts AS DATE) AS day, hour(ts) * 4 + minute(ts) // 15 AS quarter, user_id % 5 AS segment, CASE WHEN event_id % 2 = 0 THEN 'north' ELSE 'south' END AS direction, event_type, round(value, 2) AS value FROM events)"
_Q = f"{_E}, q AS (SELECT segment, direction, day, quarter, round(sum(value), 2) AS flow FROM e GROUP BY 1, 2, 3, 4)"
_D = f"""{_Q}, d AS (SELECT segment, direction, day, count(*) AS intervals, round(sum(flow), 2) AS flow,
  CASE WHEN segment = 4 AND day(day) = 7 THEN 'unknown' WHEN count(*) >= {COMPLETE} THEN 'complete' ELSE 'partial' END AS coverage FROM q GROUP BY 1, 2, 3)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type", (F.col("user_id") % 5).alias("segment"), F.when(F.col("event_id") % 2 == 0, "north").otherwise("south").alias("direction"), F.round("value", 2).alias("value"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.interval_coverage(records(spark, sf_dir), "segment", "direction", complete=COMPLETE)
    hidden = (F.col("segment") == 4) & (F.dayofmonth("day") == 7)
    return d.withColumn("coverage", F.when(hidden, "unknown").otherwise(F.col("coverage"))).withColumn("flow", F.round("flow", 2))


@query(f"WITH {_D} SELECT segment, direction, day, intervals, flow, coverage FROM d")
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days(spark, sf_dir).drop("peak")


@query(f"""WITH {_D} SELECT segment, direction, round(avg(flow) FILTER (coverage <> 'unknown'), 4) AS mean, round(avg(flow) FILTER (coverage = 'complete'), 4) AS mean_complete,
  count(*) FILTER (coverage <> 'unknown') AS days, count(*) FILTER (coverage = 'partial') AS partial_days, count(*) FILTER (coverage = 'unknown') AS excluded_days FROM d GROUP BY 1, 2""")
def avg_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.average_flow(days(spark, sf_dir), "segment", "direction")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "mean_complete")})


@query(f"""WITH {_D}, x AS (SELECT segment, day, sum(flow) AS flow, bool_or(coverage = 'unknown') AS bad FROM d GROUP BY 1, 2)
SELECT segment, CAST(date_trunc('month', day) AS DATE) AS month, round(sum(flow) FILTER (NOT bad), 2) AS flow, count(*) FILTER (NOT bad) AS measured, count(*) FILTER (bad) AS excluded, max(day(last_day(day)))::INT AS days_in_month FROM x GROUP BY 1, 2""")
def monthly_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.monthly_flow(days(spark, sf_dir), "segment").withColumn("flow", F.round("flow", 2))


@query(f"""WITH {_D} SELECT segment, direction, CAST(date_trunc('month', day) AS DATE) AS month, round(sum(flow), 2) AS flow FROM d GROUP BY GROUPING SETS ((segment, direction, 3), (segment, direction))""")
def flow_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month rows of each segment and direction, and one of the whole period with a NULL month."""
    d = days(spark, sf_dir).withColumn("month", F.trunc("day", "month"))
    keys = [F.col("segment"), F.col("direction")]
    return d.groupingSets([[*keys, F.col("month")], keys], "segment", "direction", "month").agg(F.round(F.sum("flow"), 2).alias("flow"))


@query(f"""WITH {_Q} SELECT segment, direction, day, flow, CAST(quarter AS BIGINT) AS quarter FROM q QUALIFY row_number() OVER (PARTITION BY segment, direction ORDER BY flow DESC, day, quarter) = 1""")
def peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    quarters = r.groupBy("segment", "direction", F.to_date("ts").alias("day"), (F.hour("ts") * 4 + F.floor(F.minute("ts") / 15)).alias("quarter")).agg(F.round(F.sum("value"), 2).alias("flow"))
    return T.peak(quarters.withColumn("peak", F.struct("flow", "quarter")), "segment", "direction")


@query(f"""WITH {_D}, x AS (SELECT segment, day, sum(flow) FILTER (direction = 'north') AS a, sum(flow) FILTER (direction = 'south') AS b FROM d WHERE NOT (direction = 'south' AND day(day) % 3 = 0) GROUP BY 1, 2)
SELECT segment, round(sum(a), 2) AS north, round(sum(b), 2) AS south, round(sum(a + b), 2) AS two_way, count(a + b) AS both_days, count(*) - count(a + b) AS single_days FROM x GROUP BY 1""")
def bidirectional_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = days(spark, sf_dir).filter("not (direction = 'south' and day(day) % 3 = 0)")
    return T.both_directions(d, "direction", ("north", "south"), "segment").withColumns({c: F.round(c, 2) for c in ("north", "south", "two_way")})


@query(f"""WITH {_E} SELECT segment, event_type, round(sum(value), 2) AS total, count(DISTINCT day) AS days FROM e GROUP BY 1, 2""")
def class_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("segment", "event_type").agg(F.round(F.sum("value"), 2).alias("total"), F.count_distinct(F.to_date("ts")).alias("days"))


@query(f"""WITH {_E}, c AS (SELECT segment, day, sum(value) AS total, sum(value) FILTER (event_type <> 'click') AS classes FROM e GROUP BY 1, 2)
SELECT segment, count(*) FILTER (abs(total - coalesce(classes, 0)) > 1) AS days, round(sum(abs(total - coalesce(classes, 0))), 2) AS apart FROM c GROUP BY 1""")
def divergence_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = records(spark, sf_dir).groupBy("segment", F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"), F.sum(F.when(F.col("event_type") != "click", F.col("value"))).alias("classes"))
    apart = F.abs(F.col("total") - F.coalesce("classes", F.lit(0.0)))
    return c.groupBy("segment").agg(F.count_if(apart > 1).alias("days"), F.round(F.sum(apart), 2).alias("apart"))


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN user_id WHEN user_id % 3 = 1 THEN 100000 + user_id % 10 END AS segment_id FROM events""")
def segment_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    e = table(spark, sf_dir, "events").select("event_id", u.alias("segment"), F.when(u % 3 == 1, F.concat(F.lit("c"), u % 10)).otherwise("none").alias("code"))
    register = table(spark, sf_dir, "events").filter("user_id % 3 = 0").select(u.alias("segment_id")).distinct()
    aliases = table(spark, sf_dir, "events").filter("user_id % 3 = 1").select(F.concat(F.lit("c"), u % 10).alias("code"), (100000 + u % 10).alias("segment_id")).distinct()
    return T.attach_segments(e, register, aliases).select("event_id", "segment_id")


@query("""SELECT user_id, count(*) AS rows, round(avg(CASE WHEN event_type <> 'error' THEN value END), 4) AS mean, min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last, arg_max(value, (ts, event_id)) AS latest FROM events GROUP BY 1""")
def traffic_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    return e.groupBy("user_id").agg(F.count("*").alias("rows"), F.round(F.avg(F.when(F.col("event_type") != "error", F.col("value"))), 4).alias("mean"), F.min(day).alias("first"), F.max(day).alias("last"), F.max_by("value", F.struct("ts", "event_id")).alias("latest"))
