"""Substring dedup by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words. Its minimiser is the smallest hash of its ``M``-word grams,
so windows of equal words have equal minimisers; consecutive windows that share one form a
super-k-mer, and only these travel:

1. minimisers are counted; one that stands alone has no repeated window;
2. super-k-mers of a repeated minimiser are grouped by their content, a 64-bit hash of their words
   beside the hash of the minimiser (partial aggregation first, and joins that deal out a minimiser or
   content that very many share, so that a text with very many copies is not gathered). All but the
   first of equal ones are repeats;
3. first ones whose minimiser has others of another content travel as one packed string each to the
   bucket of the minimiser, where windows are compared in order of (doc_id, start), word for word. A
   bucket of over ``STRINGS`` strings is dealt out by window instead, so no bucket grows unbounded;
4. the words covered by a repeated window are removed.

Windows are judged on the input. Null and wordless texts have no window and become empty; texts of
fewer words than a window keep all. Rows without a doc_id keep all words and are compared with
nothing. Rows of one doc_id and equal text count as one; other texts of one doc_id are documents of their
own, one after the other in order of a hash of the text. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.common import cut, hot_keys, small, spread_join
from cadastra.llm.textkit import Words, chunks, mix, powers
from cadastra.session import ship

WINDOW, M = 20, 6
STRINGS = 5_000
#: Bits of ``start`` below the number of a text among those of its doc_id.
PLACE = 31
_LOW = np.uint64(0xFFFFF)


def _runs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each super-k-mer."""
    n = len(words)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams, _ = words.grams(M)
    least = (grams & ~_LOW) | (np.arange(n, dtype=np.uint64) & _LOW)
    width, span = WINDOW - M + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    windows = np.flatnonzero(np.repeat(words.of[1:], np.diff(words.of)) - np.arange(n) >= WINDOW)
    if not len(windows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    new = np.ones(len(windows), bool)
    new[1:] = (np.diff(windows) > 1) | (least[windows[1:]] != least[windows[:-1]])
    at = np.flatnonzero(new)
    return windows[at], np.diff(np.append(at, len(windows))), least[windows[at]] >> np.uint64(20)


def _super_kmers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, data, offsets in chunks(batch.column(1)):
            words = Words(data, offsets, lower=False)
            start, n, minimiser = _runs(words)
            power, inverse = powers(len(words))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash * power[: len(words)], dtype=np.uint64)])
            content = mix((total[start + n + WINDOW - 1] - total[start]) * inverse[start] + n.astype(np.uint64))
            row = np.searchsorted(words.of, start, "right") - 1
            version = batch.column(2).slice(at, end - at).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(minimiser.view(np.int64)), pa.array(content.view(np.int64)), batch.column(0).slice(at, end - at).take(pa.array(row)), pa.array(start - words.of[row] + (version[row] << PLACE)), pa.array(n.astype(np.int32))],
                names=["minimiser", "content", "doc_id", "start", "n"],
            )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, kmers, version) to one packed string a super-k-mer, or one a window where parts > 1."""
    names = ["minimiser", "part", "doc_id", "start", "words"]
    for batch in batches:
        for at, end, data, offsets in chunks(batch.column(1)):
            words, raw = Words(data, offsets, lower=False), data.tobytes()
            whole, _ = words.grams(WINDOW)
            versions = batch.column(3).slice(at, end - at).to_pylist()
            ids, kmers = batch.column(0).slice(at, end - at).to_pylist(), batch.column(2).slice(at, end - at).to_pylist()
            rows: list[tuple] = []
            for i, own in enumerate(kmers):
                of = words.of[i]
                for k in own:
                    a = of + (k["start"] & ((1 << PLACE) - 1))
                    pieces = [(a, k["n"], 0)] if k["parts"] == 1 else [(a + j, 1, int(whole[a + j]) % k["parts"]) for j in range(k["n"])]
                    for b, n, part in pieces:
                        last = b + n + WINDOW - 1
                        rows.append((k["minimiser"], part, ids[i], int(b - of) + (versions[i] << PLACE), b" ".join([raw[s:e] for s, e in zip(words.start[b:last].tolist(), words.end[b:last].tolist(), strict=True)])))
            for low in range(0, len(rows), 20_000):
                part = list(zip(*rows[low : low + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=names)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows met before in their bucket; rows come in order of bucket, doc_id and start."""
    bucket, seen, last = None, set(), None
    for batch in batches:
        docs, starts, ns = [], [], []
        for minimiser, part, doc, start, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (minimiser, part) != bucket:
                bucket, seen, last = (minimiser, part), set(), None
            if last == (doc, start):  # of a repeated row
                continue
            last = doc, start
            gaps = [-1, *[i for i, x in enumerate(words) if x == 32], len(words)]
            for j in range(len(gaps) - WINDOW):
                window = words[gaps[j] + 1 : gaps[j + WINDOW]]
                if window not in seen:
                    seen.add(window)
                elif docs and docs[-1] == doc and starts[-1] + ns[-1] == start + j:
                    ns[-1] += 1
                else:
                    docs.append(doc)
                    starts.append(start + j)
                    ns.append(1)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(ns, pa.int32())], names=["doc_id", "start", "n"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, data, offsets in chunks(batch.column(1)):
            words = Words(data, offsets, lower=False)
            change = np.zeros(len(words) + 1, np.int64)
            own = batch.column(2).slice(at, end - at)
            flat, sizes = own.flatten(), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            first = np.repeat(words.of[:-1], sizes) + flat.field("start").to_numpy(zero_copy_only=False)
            np.add.at(change, first, 1)
            np.add.at(change, first + flat.field("n").to_numpy(zero_copy_only=False) + WINDOW - 1, -1)
            keep = np.cumsum(change[:-1]) == 0
            stays, doc = np.flatnonzero(keep), words.doc()
            edge = np.zeros(len(data) + 1, np.int8)
            edge[words.start[stays]] += 1
            edge[words.end[stays]] -= 1
            inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
            followed = stays[:-1][doc[stays[:-1]] == doc[stays[1:]]]
            out = data.copy()
            inside[words.end[followed]], out[words.end[followed]] = True, 32
            ends = np.concatenate([[0], np.cumsum(inside)])[offsets].astype(np.int64)
            text = pa.LargeStringArray.from_buffers(end - at, pa.py_buffer(ends), pa.py_buffer(out[inside])).cast(pa.string())
            kept = np.concatenate([[0], np.cumsum(keep)])[words.of]
            total = np.diff(words.of)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(total), pa.array(total - np.diff(kept)), text], names=["doc_id", "n_words", "n_removed", "kept"])


def _versions(texts: DataFrame) -> DataFrame:
    """``texts`` with the number of each row's text among the different ones of its doc_id; nearly always 0."""
    hashed = texts.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"))
    several = cut(hashed.distinct().groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if several.isEmpty():
        return texts.withColumn("version", F.lit(0).cast("long"))
    order = Window.partitionBy("doc_id").orderBy("h")
    numbers = cut(hashed.join(several, "doc_id", "left_semi").distinct().withColumn("version", F.row_number().over(order).cast("long") - 1).filter("version > 0"))
    found = texts.withColumn("h", F.xxhash64("text")).join(small(numbers, 500_000), ["doc_id", "h"], "left")
    return found.select("doc_id", "text", F.coalesce("version", F.lit(0).cast("long")).alias("version"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: each text without the words of repeated windows."""
    ship(docs.sparkSession)
    texts = _versions(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    runs = texts.filter("doc_id is not null").mapInArrow(_super_kmers, "minimiser long, content long, doc_id long, start long, n int")
    # four bytes of the minimiser are enough to set aside nearly all that stand alone
    runs = runs.withColumn("key", F.hash("minimiser"))
    several = cut(runs.groupBy("key").count().filter("count > 1"))
    runs = spread_join(runs, several.select("key"), ["key"], hot_keys(several, ["key"]), ["doc_id", "start"], "left_semi")
    runs = cut(runs.select("minimiser", "content", "doc_id", "start", "n"))

    firsts = cut(runs.groupBy("minimiser", "content").agg(F.min(F.struct("doc_id", "start", "n")).alias("f"), F.count("*").alias("rows")).select("minimiser", "content", "f.*", "rows"))
    repeated = firsts.filter("rows > 1").select("minimiser", "content", F.col("doc_id").alias("d"), F.col("start").alias("s"))
    copies = spread_join(runs, repeated, ["minimiser", "content"], hot_keys(firsts, ["minimiser", "content"], "rows"), ["doc_id", "start"])
    copies = copies.filter("doc_id <> d or start <> s").select("doc_id", "start", "n")
    mixed = firsts.groupBy("minimiser").count().filter("count > 1")
    travel = spread_join(firsts, mixed.select("minimiser", F.ceil(F.col("count") / STRINGS).alias("parts")), ["minimiser"], hot_keys(mixed, ["minimiser"]), ["content"])
    version, place = F.shiftright("start", PLACE), F.col("start").bitwiseAND((1 << PLACE) - 1).cast("int")
    travel = travel.groupBy("doc_id", version.alias("version")).agg(F.collect_list(F.struct("minimiser", "start", "n", "parts")).alias("kmers"))
    packed = texts.join(travel, ["doc_id", "version"]).select("doc_id", "text", "kmers", "version").mapInArrow(_packed, "minimiser long, part long, doc_id long, start long, words binary")
    # a cut, so that the texts and strings dealt out here have left the disk when the texts are dealt out again below
    windows = cut(packed.repartition("minimiser", "part").sortWithinPartitions("minimiser", "part", "doc_id", "start").mapInArrow(_repeats, "doc_id long, start long, n int"))

    repeats = copies.unionByName(windows).groupBy("doc_id", version.alias("version")).agg(F.collect_list(F.struct(place.alias("start"), "n")).alias("repeats"))
    return texts.join(repeats, ["doc_id", "version"], "left").select("doc_id", "text", "repeats").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")
