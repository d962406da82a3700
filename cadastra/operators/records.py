"""Rows of tables as records: declared types, roles of columns, and one record set of several entities."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions import scalar as S

KINDS: dict[str, Callable[[Column], Column]] = {
    "text": S.filled, "date": S.calendar_date, "integer": S.integer, "number": S.number, "flag": S.flag,
    "fraction": lambda c: S.fraction(S.number(c))["value"], "url": S.canonical_url,
}
#: Endings that tell a derived column's role.
ROLES = (
    ("ytd", r"^.+?_ytd(?:_[a-z0-9_]+)?$"), ("check", r"^.+?_(?:calc|check)(?:_[a-z0-9_]+)?$"),
    ("check", r"^.+?_(?:diff|variance)(?:_[a-z0-9_]+)?$"), ("variation", r"^.+?_(?:mom|yoy)(?:_[a-z0-9_]+)?$"),
)
#: Columns of the common record.
RECORD = ("kind", "id", "title", "category", "locality", "lat", "lon", "price", "area", "price_per_area", "status", "approximate")


def coerced(df: DataFrame, schema: Mapping[str, str], month: str) -> DataFrame:
    """Declared columns of texts by their kind, absent ones left absent, on a month axis.

    ``month`` is any readable date, cut to day 1; a row without one is dropped. ``year, month_number,
    period, quarter`` are derived from it where the table doesn't bring them; what it brings stays.
    """
    day = F.coalesce(S.calendar_date(F.col(month)), F.to_date(F.concat(S.month_key(F.col(month)), F.lit("-01"))))
    cast = [KINDS[kind](F.col(c).cast("string")).alias(c) for c, kind in schema.items() if c in df.columns and c != month]
    out = df.select(F.trunc(day, "month").alias(month), *cast).filter(F.col(month).isNotNull())
    m = F.col(month)
    derived = {
        "year": F.year(m), "month_number": F.month(m), "period": F.date_format(m, "yyyy-MM"),
        "quarter": F.concat(F.year(m).cast("string"), F.lit("-T"), F.quarter(m).cast("string")),
    }
    for name, value in derived.items():
        out = out.withColumn(name, F.coalesce(F.col(name), value.cast(out.schema[name].dataType)) if name in out.columns else value)
    return out


def roles(columns: Sequence[str], metrics: Sequence[str], metadata: Sequence[str]) -> dict[str, str]:
    """Role of each column: metric, metadata, or by its ending ytd, check or variation; else unknown.

    A derived column of an undeclared metric is ``undeclared``.
    """
    out = {}
    for c in columns:
        found = next((role for role, pattern in ROLES if re.match(pattern, c)), None)
        base = re.split(r"_(?:ytd|calc|check|diff|variance|mom|yoy)(?:_|$)", c)[0]
        if c in metrics:
            out[c] = "metric"
        elif c in metadata:
            out[c] = "metadata"
        elif found:
            out[c] = found if base in metrics else "undeclared"
        else:
            out[c] = "unknown"
    return out


def shaped(df: DataFrame, kind: str, columns: Mapping[str, Column]) -> DataFrame:
    """``df`` as records of one kind, what ``columns`` doesn't name NULL; rows without an id have ``id`` NULL."""
    types = {"lat": "double", "lon": "double", "price": "double", "area": "double", "price_per_area": "double", "approximate": "boolean"}
    cells = [columns.get(c, F.lit(kind) if c == "kind" else F.lit(None)).cast(types.get(c, "string")).alias(c) for c in RECORD]
    out = df.select(*cells)
    return out.withColumn("id", S.filled(F.col("id"))).withColumn("title", S.filled(F.col("title")))


def record_set(parts: Sequence[DataFrame]) -> DataFrame:
    """All records as one set; ``dropped`` marks those without an id, which are counted and not shown."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.withColumn("dropped", F.col("id").isNull())


def with_index(survey: DataFrame, scalars: DataFrame, bridge: DataFrame) -> DataFrame:
    """Survey rows ``region, year`` with the scalars ``code, year, ..`` of their region; ``bridge(region, code)``.

    A region outside the bridge is ``blocked`` and gets no scalar.
    """
    known = bridge.groupBy("region").agg(F.min("code").alias("code"))
    return survey.join(known, "region", "left").withColumn("blocked", F.col("code").isNull()).join(scalars, ["code", "year"], "left")


def latest_gap(df: DataFrame, locality: str, month: str, value: str, gap: str) -> DataFrame:
    """Of each locality the newest month with its value and its published difference to the whole area."""
    last = df.groupBy(locality).agg(F.max_by(F.struct(F.col(month).alias("month"), F.col(value).alias("value"), F.col(gap).alias("gap")), month).alias("x"))
    side = F.when(F.col("gap").isNotNull(), F.when(F.col("gap") < 0, "below").otherwise("above"))
    return last.select(locality, "x.*").withColumn("side", side)


def ranked_with_reference(df: DataFrame, name: str, band: str, month: str, value: str, total_name: str) -> DataFrame:
    """Rows of each band's newest month with ``place``; the total row is ``reference`` and has no place.

    Ties by name; a row without a value isn't ranked either and is ``unranked``. Places are counted within
    a band, whose rows are its names in one month.
    """
    from pyspark.sql.window import Window

    newest = df.groupBy(band).agg(F.max(month).alias("_newest"))
    rows = df.join(newest, band).filter(F.col(month) == F.col("_newest")).drop("_newest")
    rows = rows.withColumn("reference", F.col(name) == total_name).withColumn("unranked", ~F.col("reference") & F.col(value).isNull())
    takes = ~F.col("reference") & ~F.col("unranked")
    place = F.row_number().over(Window.partitionBy(band, takes).orderBy(F.desc(value), name))
    return rows.withColumn("place", F.when(takes, place))
