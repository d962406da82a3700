"""Roll-ups of cells: 200 m to 1 km over two editions, hexagons to their parents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions.scalar import change
from cadastra.operators.stats import strict_sum


def to_parents(cells: DataFrame, edition: str, values: Sequence[str]) -> DataFrame:
    """``parent`` with each value in one edition: the strict sum of its children, or of the whole cell.

    ``cells(parent, whole, values..)``: ``whole`` marks a cell that wasn't subdivided. A parent with both
    in one edition is marked ``mixed`` and has no values.
    """
    child = ~F.col("whole")
    mixed = (F.count_if("whole") > 0) & (F.count_if(child) > 0)
    return cells.groupBy("parent").agg(
        *(F.when(~mixed, strict_sum(F.col(v))).alias(f"{v}_{edition}") for v in values),
        F.count_if(child).alias(f"children_{edition}"), F.any_value("whole").alias(f"whole_{edition}"), mixed.alias(f"mixed_{edition}"),
    )


def two_editions(a: DataFrame, b: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Both editions of every parent; ``resolution_changed`` where one was subdivided and the other not."""
    out = a.join(b, "parent", "full_outer")
    return out.withColumn("resolution_changed", F.coalesce(F.col(f"whole_{names[0]}") != F.col(f"whole_{names[1]}"), F.lit(False)))


def edition_totals(detail: DataFrame, overview: DataFrame, region: str, names: tuple[str, str]) -> DataFrame:
    """Households and population of each region in two editions, each place counted once an edition.

    Both sides have ``region``, ``quality_flags`` and for each edition ``dom_``, ``pop_``; the cells of
    ``overview`` also ``children`` and for each edition ``children_``. A cell of ``detail`` counts in both
    editions, one of ``overview`` in those in which it wasn't subdivided (``children`` where the edition has
    no count of its own; no count is none), so a cell whose resolution changed goes over to its children.
    Sums leave out what is absent and are NULL where all is. A cell is partial if it has no households in an
    edition that it counts in, or says so in its flags. A null or empty region is ``SEM_RA``.
    """
    old, new = names
    place = F.coalesce(F.nullif(F.col(region), F.lit("")), F.lit("SEM_RA")).alias(region)
    values = [f"{v}_{e}" for v in ("dom", "pop") for e in names]
    whole = lambda e: F.coalesce(f"children_{e}", "children", F.lit(0)) == 0
    cells = detail.select(place, "quality_flags", *values, *(F.lit(True).alias(f"in_{e}") for e in names))
    cells = cells.unionByName(overview.select(place, "quality_flags", *values, *(whole(e).alias(f"in_{e}") for e in names)))
    cells = cells.filter(F.col(f"in_{old}") | F.col(f"in_{new}"))
    here = lambda v, e: F.when(F.col(f"in_{e}"), F.col(f"{v}_{e}"))
    hole = (F.col(f"in_{old}") & F.col(f"dom_{old}").isNull()) | (F.col(f"in_{new}") & F.col(f"dom_{new}").isNull())
    out = cells.groupBy(region).agg(
        *(F.sum(here("dom", e)).alias(f"households_{e}") for e in names), *(F.sum(here("pop", e)).alias(f"pop_{e}") for e in names),
        *(F.count(here("dom", e)).alias(f"cells_{e}") for e in names), F.count_if(hole | F.coalesce(F.array_contains("quality_flags", "partial_children"), F.lit(False))).alias("cells_partial"),
    )
    first, last = F.col(f"households_{old}"), F.col(f"households_{new}")
    return out.withColumn("households_delta", last - first).withColumn("households_growth", change(last, first))


def hex_parent(cell: Column, resolution: int) -> Column:
    """Parent of a hexagon index (a bigint) at a coarser resolution: its digits below are set to all ones."""
    ones = (1 << 3 * (15 - resolution)) - 1
    cleared = cell.bitwiseAND(F.lit(~(0xF << 52)))
    return cleared.bitwiseOR(F.lit(resolution << 52)).bitwiseOR(F.lit(ones))


def hex_number(text: Column) -> Column:
    """The bigint of an index of fifteen hexadecimal digits."""
    return F.conv(text, 16, 10).try_cast("long")
