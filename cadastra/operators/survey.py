"""Survey shares, series over regions, fallbacks between registers, column sanitation and run status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions.scalar import filled, number, ratio


def group_shares(df: DataFrame, group: str, part: str, weight: str, *keys: str) -> DataFrame:
    """Share of each part in its group, and of the group in all, by key."""
    n = df.groupBy(*keys, group, part).agg(F.sum(weight).alias("n"))
    by_group = n.groupBy(*keys, group).agg(F.sum("n").alias("in_group"))
    total = by_group.groupBy(*keys).agg(F.sum("in_group").alias("all"))
    out = n.join(by_group, [*keys, group]).join(total, list(keys))
    return out.select(*keys, group, part, "n", ratio(F.col("n"), F.col("in_group")).alias("share"), ratio(F.col("in_group"), F.col("all")).alias("group_share"))


def region_series(df: DataFrame, time: str, share: str, count: str) -> DataFrame:
    """Unweighted mean of the regions that have a number, counts summed, and how many regions had one."""
    return df.groupBy(time).agg(F.avg(share).alias("mean"), F.sum(count).alias("total"), F.count(share).alias("regions"))


def scatter(df: DataFrame, name: str, x: Column, y: Column) -> DataFrame:
    """Points with both axes, the gap of y to x, and the rest marked as missing."""
    both = x.isNotNull() & y.isNotNull()
    return df.select(name, x.alias("x"), y.alias("y"), F.when(both, ratio(y - x, x)).alias("gap"), (~both).alias("missing"))


def axis_ranges(df: DataFrame, key: str, value: str) -> DataFrame:
    """Least and most of each axis, zero included."""
    return df.groupBy(key).agg(F.least(F.min(value), F.lit(0.0)).alias("least"), F.greatest(F.max(value), F.lit(0.0)).alias("most"))


def with_fallback(df: DataFrame, key: str, first: DataFrame, second: DataFrame, value: str) -> DataFrame:
    """A value from the first register that has it, and where it comes from."""
    a, b = (r.select(key, F.col(value).alias(n)) for r, n in ((first, "_a"), (second, "_b")))
    out = df.join(a, key, "left").join(b, key, "left")
    origin = F.when(F.col("_a").isNotNull(), "first").when(F.col("_b").isNotNull(), "second").otherwise("none")
    return out.withColumn(value, F.coalesce("_a", "_b")).withColumn("origin", origin).drop("_a", "_b")


def ambiguous_names(df: DataFrame, name: str) -> DataFrame:
    """Rows with whether another row has their name."""
    n = df.groupBy(name).agg((F.count("*") > 1).alias("ambiguous"))
    return df.join(n, name, "left")


def resolve_aliases(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Each canonical column from itself or the first alias that is there and isn't blank; points are divided by 100.

    An alias that ends in ``/100`` is in percentage points.
    """
    out = []
    for name, others in aliases.items():
        options = [filled(F.col(name))] if name in df.columns else []
        for o in others:
            column, _, scale = o.partition("/")
            if column in df.columns:
                options.append((number(F.col(column).cast("string")) / float(scale)).cast("string") if scale else filled(F.col(column)))
        out.append(F.coalesce(*options, F.lit(None).cast("string")).alias(name))
    return df.select(*[c for c in df.columns if c not in aliases], *out)


def drift(df: DataFrame, declared: Sequence[str]) -> dict[str, list[str]]:
    """Declared columns that are missing and columns that weren't declared, by name."""
    return {"missing": [c for c in declared if c not in df.columns], "unknown": [c for c in df.columns if c not in declared]}


def sanitised(df: DataFrame, ident: str, money: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Money texts as numbers where they can be read, else left, and one log row for each cell changed."""
    parsed = {c: number(F.col(c)) for c in money}
    new = df.select(*[c for c in df.columns if c not in money], *(F.coalesce(parsed[c].cast("string"), F.col(c)).alias(c) for c in money))
    cells = F.array_compact(F.array(*(F.when(parsed[c].isNotNull() & ~parsed[c].cast("string").eqNullSafe(F.col(c)), F.struct(F.lit(c).alias("field"), F.col(c).alias("before"), parsed[c].cast("string").alias("after"))) for c in money)))
    return new, df.select(ident, F.explode(cells).alias("c")).select(ident, "c.*")


def refresh_allowed(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> list[str]:
    """Why a refresh of several tables must not happen: columns or rows that are missing; nothing if it may."""
    out = []
    for name, (df, columns) in tables.items():
        out += [f"{name}: column {c} is missing" for c in columns if c not in df.columns]
        if df.limit(1).count() == 0:
            out.append(f"{name}: no rows")
    return out


def run_status(checks: DataFrame, run: str, outcome: str) -> DataFrame:
    """Counts a run and its status: failed if nothing was read, partial with an error, else success."""
    out = checks.groupBy(run).agg(F.count("*").alias("checks"), F.count_if(F.col(outcome).isin("ok", "gone")).alias("read"), F.count_if(F.col(outcome) == "error").alias("errors"))
    return out.withColumn("status", F.when(F.col("read") == 0, "failed").when(F.col("errors") > 0, "partial").otherwise("success"))


def long_panel(df: DataFrame, keys: Sequence[str], variables: Sequence[str], source: str) -> DataFrame:
    """``keys, variable, value, source``: one row a cell that is there."""
    cells = F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables))
    return df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*", F.lit(source).alias("source")).filter("value is not null")
