"""Hard negatives by angular triangle filtering.

Every vector is stored with its norm and its angles to some reference directions. By the triangle inequality
on the sphere the angle of an anchor and a row lies, for each reference, between the difference and the sum
of their two angles; the cosines of the tightest bounds times the norms, rounded outwards, enclose the
integer score. Only rows whose bounds reach what is still wanted (the fifth best of the positives, a
positive's window of scores and its tenth best of the negatives) are scored with integers, so the bounds
never change a result. Anchors are the rows whose vec_id is divisible by ``every``, the stated query set;
they meet all rows in blocks: a cell of the grid (block of rows, block of anchors) is one task's work, and
returns a few rows an anchor.

Rows: those with a null vec_id, a null label or vector, or a null or non-finite component take no part;
identical rows count once, different rows under one vec_id are rows of their own; a vector is as if filled
with zeros to the longest one it meets; a vector of zeros has score 0 with all. Equal scores go by the
smaller vec_id, then by a hash of the row. Scores beyond a long are set to its ends. Other columns are
ignored. An empty table has an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.common import cut
from cadastra.session import ship

#: Positives of an anchor, negatives of a positive, and the window of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Rows and anchors of a cell, and reference directions, which are rows of the table picked by a hash.
BLOCK_ROWS, BLOCK_ANCHORS, REFERENCES = 32_768, 8_192, 8
#: What the bounds are widened by: of an angle, and of a score as a share of the norms.
_ANGLE, _SHARE = 1e-6, 1e-9
#: Below this, a sum of products is exact as a double.
_EXACT = 2.0**52
_LONG = 2**63 - 1
_PREPARED = "row binary, vec_id long, label long, q array<long>, norm double, angles array<double>"
_POSITIVE = "anchor binary, anchor_id long, row binary, vec_id long, score long"
_NEGATIVE = "anchor binary, anchor_id long, positive binary, positive_id long, positive_score long, row binary, vec_id long, score long"


def quantised(vectors: DataFrame) -> DataFrame:
    """Rows that take part: vec_id, label after the planted change, and q, the components as floor(256 * x)."""
    parts = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    real = F.forall(parts, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    label = F.col("label").cast("long")
    kept = vectors.filter(F.col("vec_id").isNotNull() & label.isNotNull() & F.col("embedding").isNotNull() & F.coalesce(real, F.lit(False)))
    relabelled = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    limit = F.lit(float(2**62))  # a component beyond it makes a score beyond a long with all but tiny partners
    whole = F.transform(parts, lambda x: F.floor(F.greatest(F.least(x * 256, limit), -limit)).cast("long"))
    found = kept.select(F.col("vec_id").cast("long").alias("vec_id"), relabelled.alias("label"), whole.alias("q"))
    return found.withColumn("row", F.unhex(F.md5(F.to_json(F.struct("vec_id", "label", "q")).cast("binary")))).dropDuplicates(["row"])


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Rows of numbers, filled with zeros to the longest."""
    lists = lists.combine_chunks()
    size = np.diff(np.asarray(lists.offsets))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(size.max()) if len(size) else 0
    out = np.zeros((len(size), width), flat.dtype)
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out


def _norms(q: np.ndarray) -> np.ndarray:
    scaled = q.astype(np.float64)
    return np.sqrt((scaled * scaled).sum(1))


def _angles(references: list[list[int]]) -> Callable:
    """Adds the norm and the angles to the references; the angle to a zero vector is a right one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(map(len, references), default=0)
        for batch in batches:
            q = _matrix(pa.chunked_array([batch.column("q")]))
            norm = _norms(q)
            refs = np.zeros((len(references), max(width, q.shape[1])))
            for i, r in enumerate(references):
                refs[i, : len(r)] = r
            refs /= np.maximum(_norms(refs), 1)[:, None]
            cosine = (q.astype(np.float64) @ refs[:, : q.shape[1]].T) / np.maximum(norm, 1)[:, None]
            angles = np.arccos(np.clip(cosine, -1, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("vec_id"), batch.column("label"), batch.column("q"), pa.array(norm), pa.array(list(angles), pa.list_(pa.float64()))], names=[c.split()[0] for c in _PREPARED.split(", ")]
            )

    return run


def prepared(vectors: DataFrame, references: int = REFERENCES) -> DataFrame:
    """``quantised`` with norm and stored angles, as a table; the references are a few rows picked by hash."""
    rows = quantised(vectors)
    picked = rows.filter(F.exists("q", lambda x: x != 0)).orderBy(F.xxhash64("row"), "row").limit(references)
    return cut(rows.select("row", "vec_id", "label", "q").mapInArrow(_angles([r.q for r in picked.select("q").collect()]), _PREPARED))


class _Cell:
    """Rows and anchors that meet in a task."""

    def __init__(self, rows: pa.Table, anchors: pa.Table) -> None:
        order = np.argsort(rows.column("vec_id").to_numpy(), kind="stable")
        self.rows = rows.take(pa.array(order))
        self.q, self.anchor_q = _matrix(self.rows.column("q")), _matrix(anchors.column("q"))
        self.width = min(self.q.shape[1], self.anchor_q.shape[1])
        self.norm, self.anchor_norm = self.rows.column("norm").to_numpy(), anchors.column("norm").to_numpy()
        self.angles, self.anchor_angles = np.ascontiguousarray(_matrix(self.rows.column("angles")).T), _matrix(anchors.column("angles"))
        self.id, self.label, self.row = self.rows.column("vec_id").to_numpy(), self.rows.column("label").to_numpy(), self.rows.column("row").to_pylist()
        self.exact = self.q.astype(np.float64)[:, : self.width] if len(self.norm) and len(self.anchor_norm) and self.norm.max() * self.anchor_norm.max() < _EXACT else None

    def bounds(self, i: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the score of anchor i and each of the rows is at least and at most."""
        low, high = np.zeros(len(which)), np.full(len(which), math.pi)
        for r in range(len(self.angles)):
            a, b = self.anchor_angles[i, r], self.angles[r, which]
            np.maximum(low, np.abs(a - b), out=low)
            np.minimum(high, np.minimum(a + b, 2 * math.pi - a - b), out=high)
        scale = self.anchor_norm[i] * self.norm[which]
        slack = scale * _SHARE + 1
        return scale * np.cos(np.minimum(high + _ANGLE, math.pi)) - slack, scale * np.cos(np.maximum(low - _ANGLE, 0)) + slack

    def scores(self, i: int, which: np.ndarray) -> np.ndarray:
        """Integer inner products; sums of products below 2**52 are exact as doubles, others are made of unbounded integers."""
        if self.exact is not None:
            return (self.exact[which] @ self.anchor_q[i, : self.width].astype(np.float64)).astype(np.int64)
        own = [int(x) for x in self.anchor_q[i, : self.width]]
        return np.array([max(-_LONG - 1, min(_LONG, sum(x * int(y) for x, y in zip(own, self.q[j, : self.width], strict=True)))) for j in which], np.int64)

    def best(self, which: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """Places in ``which`` of the k highest scores; equal ones by id, then by the row's hash."""
        if len(which) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            near = np.flatnonzero(score >= least)
        else:
            near = np.arange(len(which))
        return np.array(sorted(near, key=lambda j: (-score[j], self.id[which[j]], self.row[which[j]]))[:k], np.int64)


def _positives(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """The best rows of the anchor's label in this cell."""
    out: list[tuple] = []
    if not (rows.num_rows and anchors.num_rows):
        return _rows(out, _POSITIVE)
    anchors = _own_names(anchors)
    cell = _Cell(rows, anchors)
    of_label = {x: np.flatnonzero(cell.label == x) for x in np.unique(cell.label)}
    for i, (name, anchor_id, label) in enumerate(zip(*(anchors.column(c).to_pylist() for c in ("row", "vec_id", "label")), strict=True)):
        which = of_label.get(label, np.zeros(0, np.int64))
        _, most = cell.bounds(i, which)
        start = np.argsort(-most, kind="stable")[: 8 * (POSITIVES + 1)]
        known = np.sort(cell.scores(i, which[start]))[::-1]
        least = known[POSITIVES] if len(known) > POSITIVES else -np.inf  # one more than needed, as the anchor itself may be among them
        open_ = which[most >= least]
        score = cell.scores(i, open_)
        for j in cell.best(open_, score, POSITIVES + 1):
            if cell.row[open_[j]] != name:
                out.append((name, anchor_id, cell.row[open_[j]], int(cell.id[open_[j]]), int(score[j])))
    return _rows(out, _POSITIVE)


def _negatives(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """The best rows of other labels in the window of each of the anchor's positives in this cell."""
    out: list[tuple] = []
    if not (rows.num_rows and anchors.num_rows):
        return _rows(out, _NEGATIVE)
    anchors = _own_names(anchors)
    cell = _Cell(rows, anchors)
    other = {x: np.flatnonzero(cell.label != x) for x in set(anchors.column("label").to_pylist())}
    for i, (name, anchor_id, label, positives) in enumerate(zip(*(anchors.column(c).to_pylist() for c in ("row", "vec_id", "label", "positives")), strict=True)):
        windows = [(-(-LOW * p["score"] // 100), HIGH * p["score"] // 100) for p in positives]  # whole scores from, to
        which = other[label]
        least, most = cell.bounds(i, which)
        overlaps = np.zeros(len(which), bool)
        for a, b in windows:
            overlaps |= (most >= a) & (least <= b) & (a <= b)
        open_ = which[overlaps]
        score = cell.scores(i, open_)
        for p, (a, b) in zip(positives, windows, strict=True):
            inside = np.flatnonzero((score >= a) & (score <= b))
            for j in inside[cell.best(open_[inside], score[inside], NEGATIVES)]:
                out.append((name, anchor_id, p["row"], p["vec_id"], p["score"], cell.row[open_[j]], int(cell.id[open_[j]]), int(score[j])))
    return _rows(out, _NEGATIVE)


def _own_names(anchors: pa.Table) -> pa.Table:
    return anchors.rename_columns([c.removeprefix("of_") for c in anchors.column_names])


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    fields = pa.schema([(name, pa.int64() if kind == "long" else pa.binary()) for name, kind in (c.split() for c in schema.split(", "))])
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)


def _met(rows: DataFrame, anchors: DataFrame, kernel: Callable, schema: str, blocks: tuple[int, int]) -> DataFrame:
    """Each block of anchors meets each block of rows in one task; blocks are dealt by the rows' hash."""
    places = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    left = rows.withColumn("rows_of", block(blocks[0])).withColumn("anchors_of", places(blocks[1]))
    right = anchors.select(*(F.col(c).alias(f"of_{c}") for c in anchors.columns), block(blocks[1]).alias("of_anchors")).withColumn("of_rows", places(blocks[0]))
    return left.groupBy("rows_of", "anchors_of").cogroup(right.groupBy("of_rows", "of_anchors")).applyInArrow(kernel, schema)


def hard_negatives(vectors: DataFrame, every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of all anchors and their positives."""
    ship(vectors.sparkSession)
    rows = prepared(vectors)
    anchors = rows.filter(F.col("vec_id") % every == 0)
    n, n_anchors = rows.count(), anchors.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-n // BLOCK_ROWS), min(cores, -(-n // 1024)), 1), max(1, -(-n_anchors // BLOCK_ANCHORS))
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    found = _met(rows, anchors, _positives, _POSITIVE, blocks).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= POSITIVES)
    positives = found.groupBy("anchor").agg(F.collect_list(F.struct("row", "vec_id", "score")).alias("positives"))
    mining = anchors.join(positives.withColumnRenamed("anchor", "row"), "row")
    rank = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id", "row")
    mined = _met(rows, cut(mining), _negatives, _NEGATIVE, blocks).withColumn("rank", F.row_number().over(rank).cast("int")).filter(F.col("rank") <= NEGATIVES)
    return mined.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
