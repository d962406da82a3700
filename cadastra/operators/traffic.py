"""Traffic counts: coverage of intervals, daily and monthly flow, peaks, both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERVALS = 96


def coverage_class(n: Column, complete: int = INTERVALS) -> Column:
    """complete, partial, or unknown for no interval at all."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, "unknown").when(n >= complete, "complete").otherwise("partial")


def interval_coverage(events: DataFrame, *keys: str, complete: int = INTERVALS) -> DataFrame:
    """Quarter hours with events, by key and day: distinct intervals first, then their number."""
    quarters = events.groupBy(*keys, F.to_date("ts").alias("day"), (F.hour("ts") * 4 + F.floor(F.minute("ts") / 15)).alias("quarter")).agg(F.sum("value").alias("flow"))
    out = quarters.groupBy(*keys, "day").agg(F.count("*").alias("intervals"), F.sum("flow").alias("flow"), F.max_by(F.struct("flow", "quarter"), F.struct("flow", -F.col("quarter"))).alias("peak"))
    return out.withColumn("coverage", coverage_class(F.col("intervals"), complete))


def average_flow(days: DataFrame, *keys: str) -> DataFrame:
    """Mean of usable days; partial ones are used and counted, unknown ones left out; complete ones also alone."""
    usable = F.col("coverage") != "unknown"
    return days.groupBy(*keys).agg(
        F.avg(F.when(usable, F.col("flow"))).alias("mean"), F.avg(F.when(F.col("coverage") == "complete", F.col("flow"))).alias("mean_complete"),
        F.count_if(usable).alias("days"), F.count_if(F.col("coverage") == "partial").alias("partial_days"), F.count_if(~usable).alias("excluded_days"),
    )


def monthly_flow(days: DataFrame, *keys: str) -> DataFrame:
    """Directions summed to days, days to months; the worst coverage of a day counts, and days of the month."""
    worst = F.min(F.when(F.col("coverage") == "unknown", 0).when(F.col("coverage") == "partial", 1).otherwise(2))
    day = days.groupBy(*keys, "day").agg(F.sum("flow").alias("flow"), worst.alias("worst"))
    return day.groupBy(*keys, F.trunc("day", "month").alias("month")).agg(
        F.sum(F.when(F.col("worst") > 0, F.col("flow"))).alias("flow"), F.count_if(F.col("worst") > 0).alias("measured"), F.count_if(F.col("worst") == 0).alias("excluded"), F.max(F.dayofmonth(F.last_day("day"))).alias("days_in_month")
    )


def both_directions(days: DataFrame, direction: str, names: tuple[str, str], *keys: str) -> DataFrame:
    """Totals a direction, and the two-way total of days that have both."""
    side = lambda d: F.sum(F.when(F.col(direction) == d, F.col("flow")))
    day = days.groupBy(*keys, "day").agg(side(names[0]).alias("a"), side(names[1]).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return day.groupBy(*keys).agg(F.sum("a").alias(names[0]), F.sum("b").alias(names[1]), F.sum(F.when(both, F.col("a") + F.col("b"))).alias("two_way"), F.count_if(both).alias("both_days"), F.count_if(~both).alias("single_days"))


def peak(days: DataFrame, *keys: str) -> DataFrame:
    """Largest quarter-hour flow of a key with its day and quarter; the first on ties."""
    p = F.struct(F.col("peak.flow").alias("flow"), (-F.datediff("day", F.lit("1970-01-01").cast("date"))).alias("d"), (-F.col("peak.quarter")).alias("q"))
    return days.groupBy(*keys).agg(F.max_by(F.struct("day", "peak"), p).alias("m")).select(*keys, "m.day", F.col("m.peak.flow").alias("flow"), F.col("m.peak.quarter").alias("quarter"))


def attach_segments(records: DataFrame, register: DataFrame, aliases: DataFrame) -> DataFrame:
    """Records with the register's id: their own if it is known, else by their source code; else NULL (orphans)."""
    known = register.select(F.col("segment_id").alias("own"))
    alias = aliases.groupBy("code").agg(F.min("segment_id").alias("by_alias"))
    return records.join(known, records["segment"] == known["own"], "left").join(alias, "code", "left").withColumn("segment_id", F.coalesce("own", "by_alias")).drop("own", "by_alias")


def unmatched(days: DataFrame, register: DataFrame, directions: DataFrame) -> DataFrame:
    """Codes with traffic that are in no register, with what the direction map knows of them: ``code, days, flow, ..``.

    ``directions(code, ..)`` has a row a code and direction; the first in order of its columns counts.
    """
    out = days.groupBy("code").agg(F.count_distinct("day").alias("days"), F.sum("flow").alias("flow")).join(register.select("code").distinct(), "code", "left_anti")
    rest = [c for c in directions.columns if c != "code"]
    known = directions.groupBy("code").agg(F.min(F.struct(*rest)).alias("m")).select("code", "m.*")
    return out.join(known, "code", "left")


def project_direction(days: DataFrame, directions: DataFrame, corridors: DataFrame, names: tuple[str, str]) -> DataFrame:
    """``days`` with ``project`` and ``corridor`` of their code and direction.

    The direction map ``code, direction, project, corridor`` comes first, where it has both; else the
    corridor's record ``code, corridor, toward_a, toward_b`` (the smallest corridor of a code) tells which of
    its two directions, called ``names``, it is. A code in no corridor has neither.
    """
    both = directions.filter("project is not null and corridor is not null").groupBy("code", "direction").agg(F.min(F.struct("project", "corridor")).alias("_own"))
    point = corridors.filter("corridor is not null").groupBy("code").agg(F.min(F.struct("corridor", "toward_a", "toward_b")).alias("_point"))
    side = F.when(F.col("direction") == F.col("_point.toward_a"), names[0]).when(F.col("direction") == F.col("_point.toward_b"), names[1])
    out = days.join(both, ["code", "direction"], "left").join(point, "code", "left")
    return out.withColumn("project", F.coalesce("_own.project", side)).withColumn("corridor", F.coalesce("_own.corridor", "_point.corridor")).drop("_own", "_point")


def point_summary(days: DataFrame, shown: str | None = None) -> DataFrame:
    """A row for each measuring point ``code``: both sides, two ways, days, and days whose sides don't add up.

    ``days(code, role, day, a, b, two_way)``. Points are never added to each other: a code with more than
    one role is ``mixed`` and has no totals. With ``shown`` (``a`` or ``b``) the other side and the two-way
    total are left out, as they aren't of that direction.
    """
    apart = F.col("two_way") - (F.col("a") + F.col("b"))
    out = days.groupBy("code").agg(
        (F.count_distinct("role") > 1).alias("mixed"), F.count_distinct("day").alias("days"), F.min("day").alias("first"), F.max("day").alias("last"),
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("two_way").alias("two_way"), F.count_if(apart != 0).alias("mismatch_days"),
    )
    hidden = {None: (), "a": ("b", "two_way"), "b": ("a", "two_way")}[shown]
    return out.withColumns({c: F.when(~F.col("mixed") & F.lit(c not in hidden), F.col(c)) for c in ("a", "b", "two_way")})
