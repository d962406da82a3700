"""Document fingerprints by consistent weighted sampling.

A document is its 5-word shingles (a shorter text is one) weighted by how often they occur. For every
term f and sample k the hash of (f, k) picks a triple r, c ~ Gamma(2, 1) and b ~ U(0, 1). With weight w,
t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1); sample k is the (f, t) of the least a. Two
documents agree in a sample with the probability of their generalised Jaccard similarity,
sum of min weights / sum of max weights.

Terms are 64-bit numbers throughout. r, c and b are quantiles, ``DRAWS`` each, which a worker works out
once, so that a term costs no logarithm; which of them a term has for a sample follows from 48 bits of
its hash, and where several terms of a document have the least ln a, 32 other ones of these
bits decide and go into the sample. So terms that differ aren't taken for one, however long the text is.

A fingerprint is ``SAMPLES`` numbers of 16 bits in hexadecimal digits. Null and wordless texts have
the fingerprint of the empty set, which is like itself only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm.textkit import Words, chunks, mix
from cadastra.session import ship

SAMPLES, SHINGLE = 64, 5
DRAWS = 1 << 16
#: Bytes of text and rows of a range of doc_ids; most ranges; keys looked at for a range's bound.
RANGE_BYTES, RANGE_ROWS, RANGES, LOOK = 12 << 20, 100_000, 20_000, 60
EMPTY = np.full(SAMPLES, 0xFFFF, np.uint16)
_K = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))
_ODD = _K | np.uint64(1)
_SHIFT, _HALF, _QUARTER, _MASK, _LOW = np.uint64(48), np.uint64(32), np.uint64(16), np.uint64(DRAWS - 1), np.uint64(0xFFFFFFFF)
_STEP, _LAST = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_quantiles: list[tuple[np.ndarray, np.ndarray]] = []


def _sortable(a: np.ndarray) -> np.ndarray:
    """32-bit floats as 64-bit numbers of the same order, in the upper half."""
    bits = a.view(np.uint32)
    bits ^= (bits.view(np.int32) >> 31).view(np.uint32) | np.uint32(1 << 31)
    return bits.astype(np.uint64) << _HALF


def quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) and their logarithms, by Newton's method on 1 - (1 + x) exp(-x)."""
    if not _quantiles:
        p = (np.arange(DRAWS) + 0.5) / DRAWS
        x = np.sqrt(2 * p)
        for _ in range(60):
            x = np.maximum(x - (p - 1 + (1 + x) * np.exp(-x)) / (-x * np.exp(-x)), x / 2)
        _quantiles.append((x.astype(np.float32), np.log(x).astype(np.float32)))
    return _quantiles[0]


def _hashed(terms: np.ndarray, k: int, out: np.ndarray, other: np.ndarray) -> np.ndarray:
    """64 bits of each term for sample k, in ``out``."""
    np.multiply(terms, _ODD[k], out=out)
    np.right_shift(out, _HALF, out=other)
    np.bitwise_xor(out, other, out=out)
    return np.multiply(out, _LAST, out=out)


def _samples(terms: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of samples for each of the sets, whose distinct terms stand one after the other.

    A sample is a number with ln a above and 32 bits of (f, t) below; the least one of a set is taken.
    """
    gamma, log_gamma = quantiles()
    doc = np.repeat(np.arange(len(sizes)), sizes)
    out = np.full((SAMPLES, len(sizes)), np.iinfo(np.uint64).max, np.uint64)
    single = weights == 1
    for one in (True, False):
        own = single if one else ~single
        part, of = terms[own], doc[own]
        if not len(part):
            continue
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        sets = of[starts]
        buffer, other = np.empty_like(part), np.empty_like(part)
        w = None if one else np.log(weights[own].astype(np.float32))
        for k in range(SAMPLES):
            h = _hashed(part, k, buffer, other)
            r = gamma[np.right_shift(h, _SHIFT, out=other).astype(np.int64)]
            c = log_gamma[np.bitwise_and(np.right_shift(h, _HALF, out=other), _MASK, out=other).astype(np.int64)]
            b = np.bitwise_and(np.right_shift(h, _QUARTER, out=other), _MASK, out=other).astype(np.float32)
            b = (b + np.float32(0.5)) * np.float32(1 / DRAWS)
            if one:
                key = _sortable(c - r * (1 - b))
            else:
                t = np.floor(w / r + b)
                key = _sortable(c - r * (t - b + 1))
                h = h + t.astype(np.int64).view(np.uint64) * _STEP
            key |= np.bitwise_and(h, _LOW, out=h)
            out[k, sets] = np.minimum(out[k, sets], np.minimum.reduceat(key, starts))
    values = (mix((out & _LOW).T ^ _K) >> np.uint64(48)).astype(np.uint16)
    values[sizes == 0] = EMPTY
    return values


def _prints(texts: pa.Array) -> np.ndarray:
    """A row of samples for every text."""
    out = [np.zeros((0, SAMPLES), np.uint16)]
    for _, _, data, offsets in chunks(texts):
        words = Words(data, offsets, lower=True)
        grams, _ = words.grams(SHINGLE)
        terms, weights = [], []
        for a, b in zip(words.of[:-1], words.of[1:], strict=True):
            own = grams[a : b - SHINGLE + 1] if b - a >= SHINGLE else mix(np.array([words.hash[a:b].sum() + np.uint64(b - a)], np.uint64)) if b > a else grams[:0]
            distinct, n = np.unique(own, return_counts=True)
            terms.append(distinct)
            weights.append(n)
        out.append(_samples(np.concatenate(terms), np.concatenate(weights), np.array([len(x) for x in terms])))
    return np.concatenate(out)


def _hex(prints: np.ndarray) -> pa.Array:
    return pa.array([p.astype(">u2").tobytes().hex() for p in prints], pa.string())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), _hex(_prints(batch.column(1)))], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every row."""
    ship(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fingerprint string")


def likeness(a: Column | str, b: Column | str) -> Column:
    """Share of samples in which two fingerprints agree."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    same = F.filter(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda k: a.substr(k * 4 + 1, F.lit(4)) == b.substr(k * 4 + 1, F.lit(4)))
    return F.size(same) / F.lit(float(SAMPLES))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (bucket, tail, document): each is compared with the row after it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held: tuple | None = None  # bucket, tail, doc_id, text, fingerprint of the row that waits for the next
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            prints = _prints(part.column(3))
            rows = list(zip(*(c.to_pylist() for c in part.columns[:3]), [t or "" for t in part.column(3).to_pylist()], prints, strict=True))
            if held is not None:
                rows.insert(0, held)
            held = rows[-1]
            pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if a[0] == b[0] and a[1] == 0]
            texts = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs]
            after = _prints(pa.array(texts, pa.large_string()))
            own, following = (np.array([p[i][4] for p in pairs], np.uint16).reshape(-1, SAMPLES) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[2] for a, _ in pairs], pa.int64()), pa.array([len(a[3]) for a, _ in pairs], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()), _hex(own), _hex(after), pa.array((own == after).mean(axis=1)), pa.array((own == following).mean(axis=1))],
                names=names,
            )


def _keys(first: pd.Series, second: pd.Series) -> np.ndarray:
    """Pairs of signed numbers as 16 bytes that sort like them."""
    out = np.empty((len(first), 2), ">u8")
    for i, s in enumerate((first, second)):
        out[:, i] = s.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(out).view("S16").ravel()


def _bucket(bounds: np.ndarray) -> Callable:
    @F.pandas_udf("int")
    def bucket(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, _keys(first, second), "left").astype(np.int32))

    return bucket


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and the next.

    Order: descending doc_id, nulls last, rows of one doc_id by the hash of their text. The rows are cut
    into ranges of that order, as many as their bytes and their number ask for, by a sample of the keys
    (about LOOK a range). Each range also gets the first row of the next one (the last range: the very
    first row), so that no row is far from the one after it. A task sorts a range and streams over it, so
    beyond RANGES ranges these grow and spill. Rows of one doc_id are cut by their text; rows that are
    equal in both lie in one range and give a row each.
    """
    spark = ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # ascending keys: null doc_ids come last, ~doc_id turns the order of the others
    texts = texts.withColumn("null", F.col("doc_id").isNull()).withColumn("first", F.coalesce(F.bitwise_not("doc_id"), F.lit(2**63 - 1))).withColumn("second", F.xxhash64("text", "null"))
    rows, size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = min(RANGES, max(1, -(-rows // RANGE_ROWS), -(-(size or 0) // RANGE_BYTES)))
    bounds = np.zeros(0, "S16")
    if parts > 1:
        share = min(1.0, LOOK * parts / rows)
        some = texts.filter(F.xxhash64("first", "second", F.lit("look")) <= min(2**63 - 1, int(share * 2**64) - 2**63)).select("first", "second").toPandas()  # about LOOK a range
        keys = np.sort(_keys(some["first"], some["second"]))
        bounds = np.unique(keys[np.arange(1, parts) * len(keys) // parts]) if len(keys) else bounds
    ranged = texts.withColumn("bucket", _bucket(bounds)("first", "second")) if len(bounds) else texts.withColumn("bucket", F.lit(0))
    # the first row of every range goes to the range before it as well
    tops = ranged.groupBy("bucket").agg(F.min(F.struct("first", "second")).alias("t")).orderBy("bucket").collect()  # a row a range
    above = spark.createDataFrame([(r["bucket"], i, r["t"]["first"], r["t"]["second"], (i - 1) % len(tops)) for i, r in enumerate(tops)], "bucket int, place int, tfirst long, tsecond long, tail_of int")
    tail = (F.col("first") == F.col("tfirst")) & (F.col("second") == F.col("tsecond"))
    # every range is a partition; ``place`` numbers the ranges that have rows
    rows = ranged.join(F.broadcast(above), "bucket").select(
        "doc_id", "text", "first", "second",
        F.explode(F.array_compact(F.array(F.struct(F.col("place"), F.lit(0).alias("tail")), F.when(tail, F.struct(F.col("tail_of").alias("place"), F.lit(1).alias("tail")))))).alias("p"),
    ).select("p.place", "p.tail", "doc_id", "text", "first", "second")
    rows = rows.repartitionById(max(1, len(tops)), "place").sortWithinPartitions("place", "tail", "first", "second").select("place", "tail", "doc_id", "text")
    return rows.mapInArrow(_edited, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
