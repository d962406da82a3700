"""Filters with what they leave out, the panels they feed, and option lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions.scalar import blank


def active(status: Column) -> Column:
    """Whether a row's version is in use: no status, or ``active``."""
    return blank(status) | (F.lower(F.trim(status)) == "active")


def active_versions(df: DataFrame, status: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows in use whose columns are among the wanted values; an empty list wants all."""
    for column, wanted in groups.items():
        if wanted:
            df = df.filter(F.col(column).isin(list(wanted)))
    return df.filter(active(F.col(status)))


def traffic_filter(days: DataFrame, *, start: str | None = None, end: str | None = None, vehicle: str | None = None, **equal: str | None) -> DataFrame:
    """Days within a range whose columns equal the given values, for all vehicles or one class.

    ``days`` has ``day, flow, peak, divergence`` and the map ``classes``. A class puts its own count into
    ``flow``, and peak and divergence, which are known for all vehicles only, become NULL.
    """
    if start:
        days = days.filter(F.col("day") >= F.lit(start).cast("date"))
    if end:
        days = days.filter(F.col("day") <= F.lit(end).cast("date"))
    for column, value in equal.items():
        if value is not None:
            days = days.filter(F.col(column) == value)
    if vehicle is None:
        return days
    return days.withColumns({"flow": F.try_element_at("classes", F.lit(vehicle)), "peak": F.lit(None).cast(days.schema["peak"].dataType), "divergence": F.lit(None).cast(days.schema["divergence"].dataType)})


def published_roads(roads: DataFrame, least: float, arterial: Sequence[str], box: tuple[float, float, float, float], margin: float) -> DataFrame:
    """``roads`` with ``published`` and the ``reason`` why not: ``rank`` or ``outside``.

    A road is shown if its percentile reaches ``least`` or it is arterial, and no vertex lies outside
    the box (west, south, east, north) widened by the margin.
    """
    west, south, east, north = box
    inside = F.forall("coords", lambda p: p["lon"].between(west - margin, east + margin) & p["lat"].between(south - margin, north + margin))
    shown = (F.col("percentile") >= least) | F.col("highway").isin(list(arterial))
    reason = F.when(~inside, "outside").when(~shown | shown.isNull(), "rank")
    return roads.withColumn("reason", reason).withColumn("published", F.col("reason").isNull())


def cells_in_box(cells: DataFrame, box: tuple[float, float, float, float], values: Sequence[str]) -> DataFrame:
    """``cells`` with ``inside`` (their centroid is in the box) and ``detail`` (and has people or dwellings in an edition).

    A cell without any still counts as a child of its parent, so it keeps ``inside``.
    """
    west, south, east, north = box
    inside = F.coalesce(F.col("lon").between(west, east) & F.col("lat").between(south, north), F.lit(False))
    lived = F.greatest(*(F.coalesce(F.col(v), F.lit(0)) for v in values)) > 0
    return cells.withColumn("inside", inside).withColumn("detail", inside & lived)


def comparables(df: DataFrame, ident: str, kind: str, targets: DataFrame) -> DataFrame:
    """``target, ident`` of the rows of each target's kind, without the target itself."""
    wanted = targets.select(F.col(ident).alias("target"), F.col(kind).alias("_kind"))
    return df.join(wanted, (F.col(kind) == F.col("_kind")) & (F.col(ident) != F.col("target"))).select("target", ident)


def drill_down(df: DataFrame, codes: Sequence[str], code: str, **equal: object) -> DataFrame:
    """Raw rows of the wanted codes where the given columns equal the given values."""
    for column, value in equal.items():
        df = df.filter(F.col(column) == F.lit(value))
    return df.filter(F.col(code).isin(list(codes)))


def categories(df: DataFrame, category: str) -> DataFrame:
    """``df`` with ``invalid`` (only digits) and ``is_total``, which is never summed with the others."""
    c = F.trim(F.col(category))
    return df.withColumn("invalid", F.coalesce(c.rlike(r"^[0-9]+$"), F.lit(False))).withColumn("is_total", F.coalesce(F.lower(c) == "total", F.lit(False)))


def yes_cards(df: DataFrame, indicator: str, category: str, multiple: DataFrame) -> DataFrame:
    """Rows of indicators of multiple choice only where the answer is yes; ``multiple`` holds those indicators."""
    several = multiple.select(F.col(indicator), F.lit(True).alias("_several")).distinct()
    yes = F.col(category).rlike(r"(?:^|· )Sim$")
    return df.join(several, indicator, "left").filter(F.col("_several").isNull() | yes).drop("_several")


def api_filter(df: DataFrame, month: str, start: str | None, end: str | None, most: int, order: Sequence[str], **equal: str | None) -> DataFrame:
    """Rows by exact values and a range of months, at most ``most`` (5000 at the outside), in a fixed order."""
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    if start:
        df = df.filter(F.col(month) >= start)
    if end:
        df = df.filter(F.col(month) <= end)
    return df.orderBy(*order).limit(min(max(1, most), 5000))


def index_series(df: DataFrame, area: str, month: str, official: str, calculated: str, **equal: str) -> DataFrame:
    """``month, value, source`` of one area's series: the official value, else the calculated one."""
    for column, wanted in {"area": area, **equal}.items():
        df = df.filter(F.col(column) == wanted)
    return df.select(F.col(month).alias("month"), F.coalesce(official, calculated).alias("value"), F.when(F.col(official).isNotNull(), "official").when(F.col(calculated).isNotNull(), "calculated").alias("source"))


def options(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``list, value, place``: the distinct filled values of each column and their place in order.

    Places are counted within a list, which is as long as the number of its distinct values.
    """
    from pyspark.sql.window import Window

    cells = F.array(*(F.struct(F.lit(c).alias("list"), F.trim(F.col(c).cast("string")).alias("value")) for c in columns))
    values = df.select(F.explode(cells).alias("c")).select("c.*").filter("value <> ''").distinct()
    return values.withColumn("place", F.row_number().over(Window.partitionBy("list").orderBy("value")))


def visible_kpis(df: DataFrame, visible: Column, kind: str) -> DataFrame:
    """One row: visible rows, those with a place, those only roughly placed, median price an area, and counts by kind.

    ``df`` has ``lat, lon, approximate, price_per_area``; the median is of the positive prices.
    """
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    price = F.when(F.col("price_per_area") > 0, F.col("price_per_area"))
    seen = df.filter(visible)
    by = seen.groupBy(kind).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("by_kind"))  # a row a kind
    total = seen.agg(F.count("*").alias("visible"), F.count_if(placed).alias("mappable"), F.count_if(placed & F.col("approximate")).alias("approximate"))
    middle = exact_median(seen.select(price.alias("price")), "price")
    return total.join(F.broadcast(middle)).join(F.broadcast(by))  # one row each


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """One row ``median``: values are counted first, and only the two at the middle of the running count are looked at."""
    from cadastra.operators.stats import running_total

    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ranked = running_total(counted, "v", "n").withColumn("before", F.col("total") - F.col("n")).drop("total")
    n = counted.agg(F.sum("n").alias("total"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    at = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
    mid = ranked.join(F.broadcast(n)).filter(at(low) | at(high))  # one row is broadcast
    return mid.agg(((F.min("v") + F.max("v")) / 2).alias("median"))


def metric_cells(metrics: DataFrame, cells: DataFrame, metric: str, year: int, most: int) -> DataFrame:
    """Cells of one metric and year with their value, at most ``most`` by id, and whether more were left out."""
    rows = metrics.filter((F.col("metric") == metric) & (F.col("year") == year)).join(cells, "cell")
    more = rows.limit(most + 1).count() > most
    return rows.orderBy("cell").limit(most).withColumn("truncated", F.lit(more))


def metric_catalogue(metrics: DataFrame) -> DataFrame:
    """Rows of every dataset, metric and year."""
    return metrics.groupBy("dataset", "metric", "year").agg(F.count("*").alias("rows"))


#: Criteria that hold for one kind of record only, and hide the others when they are asked for.
ONLY = {"sales_stage": "development", "anchor_group": "anchor", "anchor_segment": "anchor", "property_type": "listing"}
#: Fields that a text is looked for in.
SEARCHED = ("title", "locality", "address", "property_type", "developer_name", "category", "anchor_segment")


def record_filter(df: DataFrame, *, kinds: Sequence[str] = (), active_only: bool = False, text: str | None = None, least_price: float | None = None, most_price: float | None = None, bedrooms: int | None = None, orientation: str | None = None, **equal: str | None) -> DataFrame:
    """Records that meet all criteria; a criterion that isn't given restricts nothing.

    A record without the value that a criterion asks for doesn't meet it. Prices overlap as ranges
    (``price_min`` to ``price_max``, else ``price``), bedrooms reach the number (``bedrooms_max``, else
    ``bedrooms``), the orientation is compared without case and blanks, the text without accents in any
    searched field, and an inactive listing is left out if only active ones are wanted.
    """
    from cadastra.functions.scalar import fold

    has = lambda c: F.col(c) if c in df.columns else F.lit(None)
    out = df
    if kinds:
        out = out.filter(F.col("kind").isin(list(kinds)))
    if active_only:
        out = out.filter(~((F.col("kind") == "listing") & (F.lower(F.trim(F.coalesce(has("status"), F.lit("")))) == "inactive")))
    if text and text.strip():
        shown = F.concat_ws(" ", *(has(c) for c in SEARCHED))
        out = out.filter(fold(shown).contains(fold(F.lit(text))))
    if orientation:
        out = out.filter(F.lower(F.trim(F.coalesce(has("building_orientation"), F.lit("")))) == orientation.strip().lower())
    for column, value in equal.items():
        if value:
            if column in ONLY:
                out = out.filter(F.col("kind") == ONLY[column])
            out = out.filter(has(column) == value)
    if least_price is not None:
        out = out.filter(F.coalesce(has("price_max"), has("price")) >= least_price)
    if most_price is not None:
        out = out.filter(F.coalesce(has("price_min"), has("price")) <= most_price)
    if bedrooms is not None:
        out = out.filter(F.coalesce(has("bedrooms_max"), has("bedrooms")) >= bedrooms)
    return out


def list_filter(df: DataFrame, *, lists: Mapping[str, str | None], ranges: Mapping[str, tuple[float | None, float | None]], box: tuple[float, float, float, float] | None = None, text: str | None = None, fields: Sequence[str] = (), status: str = "active") -> DataFrame:
    """Rows of a listing table by lists of values parted by commas, ranges, a box of (west, south, east, north) and a text.

    A list that is given but holds no value matches nothing; the status is ``active`` unless another, or
    ``all``, is asked for; the text may be in any of the fields.
    """
    from cadastra.functions.scalar import fold

    out = df if status == "all" else df.filter(F.col("status") == status)
    for column, values in lists.items():
        if values is not None:
            wanted = [v.strip() for v in values.split(",") if v.strip()]
            out = out.filter(F.col(column).isin(wanted) if wanted else F.lit(False))
    for column, (least, most) in ranges.items():
        if least is not None:
            out = out.filter(F.col(column) >= least)
        if most is not None:
            out = out.filter(F.col(column) <= most)
    if box is not None:
        out = out.filter(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    if text and text.strip():
        hits = [fold(F.col(c)).contains(fold(F.lit(text))) for c in fields]
        out = out.filter(F.coalesce(F.exists(F.array(*hits), lambda x: x), F.lit(False)))
    return out


def files_in_box(bounds: DataFrame, box: tuple[float, float, float, float]) -> list[str]:
    """Paths of the files whose bounds ``path, west, south, east, north`` cross a box; a row a file."""
    west, south, east, north = box
    rows = bounds.filter((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south))
    return sorted(r["path"] for r in rows.select("path").distinct().collect())
