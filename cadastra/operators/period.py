"""Metrics of a period, each aggregated by its kind.

A flow is summed, a stock averaged over the months that have it, a price or rate is a ratio of sums over
the months that have both sides, and what can't be added is refused for more than one month. A value
published for the single month, or for the year to date where the period is exactly that, wins over
the recomputed one. Absent is NULL, never 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastra.functions.scalar import ratio

DIVERGENCE = 0.005


@dataclass(frozen=True)
class Metric:
    """``kind``: flow, stock, ratio or refused; a ratio names its two sides; ``ytd`` a published column."""

    name: str
    kind: str
    over: tuple[str, str] | None = None
    scale: float = 1.0
    ytd: str | None = None


def registry(metrics: Sequence[Metric]) -> dict[str, Metric]:
    """Metrics by name; a kind that isn't known is an error."""
    for m in metrics:
        if m.kind not in ("flow", "stock", "ratio", "refused") or (m.kind == "ratio") != (m.over is not None):
            raise ValueError(f"metric {m.name} of kind {m.kind}")
    return {m.name: m for m in metrics}


def _whole_year_so_far() -> Column:
    """January to the last month of one year without a gap."""
    first, last = F.min("month"), F.max("month")
    return (F.month(first) == 1) & (F.year(first) == F.year(last)) & (F.count_distinct("month") == F.month(last))


def _value(m: Metric, has: Sequence[str]) -> tuple[Column, Column, Column]:
    """Value, origin and number of months used."""
    single = F.count_distinct("month") == 1
    if m.kind == "ratio":
        n, d = (F.col(c) for c in m.over)
        both = n.isNotNull() & d.isNotNull()
        computed = ratio(F.sum(F.when(both, n)) * m.scale, F.sum(F.when(both, d)))
        used = F.count(F.when(both, 1))
        published = F.max(F.col(m.name)) if m.name in has else F.lit(None).cast("double")
        value = F.when(single, F.coalesce(published, computed)).otherwise(computed)
        origin = F.when(single & published.isNotNull(), "published").otherwise("ratio_of_sums")
    elif m.kind == "refused":
        value, used = F.when(single, F.max(m.name)).cast("double"), F.count(m.name)
        origin = F.when(single, "published").otherwise("unsupported")
    else:
        value, used = (F.sum if m.kind == "flow" else F.avg)(F.col(m.name).cast("double")), F.count(m.name)
        origin = F.lit("sum" if m.kind == "flow" else "mean")
    if m.ytd:
        ytd = F.max_by(m.ytd, "month").cast("double")
        wins = _whole_year_so_far() & ytd.isNotNull()
        value, origin = F.when(wins, ytd).otherwise(value), F.when(wins, "published_ytd").otherwise(origin)
    return value, F.when(value.isNull() & (origin != "unsupported"), "absent").otherwise(origin), used


def aggregate(months: DataFrame, metrics: Sequence[Metric], *keys: str) -> DataFrame:
    """``keys, metric, value, origin, months, missing`` from one row a month (and key): one shuffle."""
    known = registry(metrics)
    cells = [F.struct(F.lit(m.name).alias("metric"), *(c.alias(a) for c, a in zip(_value(m, months.columns), ("value", "origin", "months"), strict=True)), F.count_distinct("month").alias("of")) for m in known.values()]
    rows = months.groupBy(*keys).agg(F.array(*cells).alias("cells")).select(*keys, F.explode("cells").alias("c")).select(*keys, "c.*")
    return rows.select(*keys, "metric", "value", "origin", "months", (F.col("of") - F.col("months")).alias("missing"))


def divergences(months: DataFrame, pairs: dict[str, Column]) -> DataFrame:
    """Months in which a published value is more than ``DIVERGENCE`` off the recomputed one, which it replaces."""
    cells = F.array(*(F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("published"), c.alias("computed")) for name, c in pairs.items()))
    rows = months.select("month", F.explode(cells).alias("c")).select("month", "c.*")
    apart = ratio(F.abs(F.col("published") - F.col("computed")), F.greatest(F.abs("published"), F.abs("computed")))
    return rows.withColumn("apart", apart).filter(F.col("apart") > DIVERGENCE)


def running(months: DataFrame, metrics: Sequence[Metric], *keys: str, by_year: bool = True) -> DataFrame:
    """Every month re-aggregated from January (or from the first month), a column a metric."""
    part = [*keys, *([F.year("month")] if by_year else [])]
    w = Window.partitionBy(*part or [F.lit(0)]).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    out = []
    for m in metrics:
        if m.kind == "ratio":
            n, d = (F.col(c) for c in m.over)
            both = n.isNotNull() & d.isNotNull()
            out.append(ratio(F.sum(F.when(both, n)).over(w) * m.scale, F.sum(F.when(both, d)).over(w)).alias(m.name))
        else:
            out.append((F.sum if m.kind == "flow" else F.avg)(F.col(m.name).cast("double")).over(w).alias(m.name))
    return months.select(*keys, "month", *out)


def compared(months: DataFrame, columns: Sequence[str], shift: int, *keys: str) -> DataFrame:
    """Every month beside the one ``shift`` calendar months before; NULL where that is missing."""
    before = months.select(*keys, F.add_months("month", shift).alias("month"), *(F.col(c).alias(f"{c}_before") for c in columns))
    out = months.select(*keys, "month", *columns).join(before, [*keys, "month"], "left")
    return out.select(*keys, "month", *columns, *(f"{c}_before" for c in columns), *(ratio(F.col(c) - F.col(f"{c}_before"), F.col(f"{c}_before")).alias(f"{c}_change") for c in columns))


def window(months: DataFrame, kind: str, reference: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of a period: month, last12 (rows, not calendar months), ytd, year, all or custom (bounds in any order)."""
    last = months.agg(F.max("month")).first()[0]
    ref = F.lit(reference or last).cast("date")
    if kind == "all":
        return months
    if kind == "custom":
        a, b = sorted((start, end))
        return months.filter(F.col("month").between(F.lit(a).cast("date"), F.lit(b).cast("date")))
    if kind == "month":
        return months.filter(F.col("month") == ref)
    if kind == "last12":
        kept = [r[0] for r in months.filter(F.col("month") <= ref).select("month").distinct().orderBy(F.desc("month")).limit(12).collect()]
        return months.filter(F.col("month").isin(kept))
    same = F.year("month") == F.year(ref)
    return months.filter(same & (F.col("month") <= ref) if kind == "ytd" else same)


def spine(months: DataFrame) -> DataFrame:
    """Every calendar month from the first to the last."""
    return months.agg(F.min("month").alias("a"), F.max("month").alias("b")).filter("a is not null").select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
