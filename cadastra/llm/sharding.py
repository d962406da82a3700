"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` equal cells; the hash of a row gives its cell, and each shard stands at
``VIRTUAL`` of them. A row belongs to the next virtual node clockwise. A shard takes rows of its own
arcs up to its capacity; the rest continue clockwise to the first shard with room. Only the number of
rows in each cell (at most ``CELLS`` numbers) goes to the driver, which works out the ranks of each
cell that a shard takes; every row then finds its shard and slot by its rank in its cell.

With ``slack`` 0 capacities differ by one at most and are all used, so shard counts do too (law
``rows``); with a slack of 0.1 a shard holds up to a tenth more than the mean and fewer rows move.

Rows: a null text counts as empty. The hash is of doc_id, length and checksum, so equal texts of
different doc_ids are spread; repeated rows get slots of their own. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL_BITS, VIRTUAL = 13, 32
CELLS = 1 << CELL_BITS
Segment = tuple[int, int, int, int, int]


def ring(shards: int) -> tuple[list[int], list[int]]:
    """Cells of the virtual nodes in clockwise order, and the shard of each."""
    nodes = sorted((zlib.crc32(f"shard {s} node {v}".encode()) >> (32 - CELL_BITS), s) for s in range(shards) for v in range(VIRTUAL))
    return [cell for cell, _ in nodes], [shard for _, shard in nodes]


def segments(counts: dict[int, int], shards: int, slack: float) -> list[Segment]:
    """(cell, first rank, end rank, shard, slot of the first) for the rows of every cell."""
    total = sum(counts.values())
    if slack:
        room = [int(-(-total * (1 + slack) // shards))] * shards
    else:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    cells, owner = ring(shards)
    used = [0] * shards
    out: list[Segment] = []

    def take(cell: int, first: int, end: int, shard: int) -> int:
        n = min(end - first, room[shard] - used[shard])
        if n:
            out.append((cell, first, first + n, shard, used[shard]))
            used[shard] += n
        return first + n

    left = []
    for cell, n in sorted(counts.items()):
        at = bisect_left(cells, cell) % len(cells)
        first = take(cell, 0, n, owner[at])
        if first < n:
            left.append((cell, first, n, at))
    for cell, first, n, at in left:
        while first < n:
            at = (at + 1) % len(cells)
            first = take(cell, first, n, owner[at])
    return out


def shard(docs: DataFrame, shards: int, slack: float = 0.0) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "size", "text_crc32")).withColumn("cell", F.shiftrightunsigned("h", 64 - CELL_BITS))
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # at most CELLS rows
    plan = docs.sparkSession.createDataFrame(segments(counts, shards, slack), "cell long, first long, end long, shard int, slot0 long")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("h", "doc_id", "size", "text_crc32")) - 1)
    placed = ranked.join(F.broadcast(plan), "cell").filter("rank >= first and rank < end")  # at most CELLS + shards rows are broadcast
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"))
