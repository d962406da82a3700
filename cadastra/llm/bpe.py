"""Byte-level BPE over a table of distinct words, and decoding through an id-to-piece join.

Whole documents travel in blocks of some megabytes. A block's words (the parts that the tokenizer's own
pattern cuts, which cover the text) are made distinct and go by hash to buckets; a bucket's task encodes each
distinct word once, whatever number of blocks has it, and sends its ids back to the blocks. There they are
joined by position: every word of every document takes the ids of its place in the block's list of distinct
words. Nothing of the corpus is held by the driver or by one task: a task holds one block (one text, if that
is longer than a block) or the distinct words of a bucket, of which there are more as the input grows.

Decoding joins each id with its piece, a table as long as the vocabulary, keeps the order and decodes the
joined bytes as UTF-8; bytes that aren't UTF-8 become U+FFFD, and an id without a piece gives nothing.

Rows: a null text is empty and has no ids; a repeated row is encoded again; a null doc_id is kept; other
columns are ignored. Files with a normalizer, another pre-tokenizer, a post-processor or added tokens that
take white space are encoded by whole texts in place of words. The tokenizer decides on each character's
class, so its version of Unicode holds.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cadastra.session import ship

#: Bytes of text in a block, of which some twenty times as much is held, and bytes that are cut into words at a time.
BLOCK, PART = 4 << 20, 1 << 20
#: Buckets of distinct words for each partition of the documents.
BUCKETS = 1
TOKENS = "doc_id long, ids array<int>"
_BLOCK = pa.schema([("block", pa.string()), ("docs", pa.binary())])
_WORDS = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("words", pa.binary())])
_IDS = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("digest", pa.int64()), ("ids", pa.binary())])
_UNKNOWN, _LETTER, _NUMBER, _SPACE, _OTHER = range(5)
#: The endings that the pattern cuts off after an apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_splitters: dict[str, Splitter] = {}
_pieces_of: dict[str, tuple[np.ndarray, np.ndarray]] = {}


class Splitter:
    """Cuts texts where the tokenizer's pattern does; classes of characters are asked from the tokenizer once each."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        file = json.loads(self.tokenizer.to_str())
        steps = file["pre_tokenizer"] or {}
        added = [t for t in file["added_tokens"]]
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"]) and t["content"] for t in added)
        self.by_word = file["normalizer"] is None and file["post_processor"] is None and steps.get("type") == "ByteLevel" and steps.get("use_regex") is True and not steps.get("add_prefix_space") and plain
        self.added = sorted((t["content"] for t in added), key=len, reverse=True)
        self.classes = np.zeros(0x110000, np.uint8)

    def classify(self, points: np.ndarray) -> np.ndarray:
        """The class of each code point."""
        found = self.classes[points]
        if not found.all():
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
            for c in np.unique(points[found == _UNKNOWN]).tolist():
                kinds = [kind for kind, side in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, ".")) if len(cut(side + chr(c) + side)) == 1]
                self.classes[c] = kinds[0] if kinds else _SPACE
            found = self.classes[points]
        return found

    def words(self, text: str, ends: np.ndarray) -> np.ndarray:
        """Where in ``text`` the words begin; texts end at ``ends`` (in characters), and so do words."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = len(points)
        hard = np.zeros(n + 1, bool)
        hard[0] = True
        hard[ends] = True
        inside = []
        for token in self.added:
            at = text.find(token)
            while at >= 0:
                stop = at + len(token)
                if not hard[at + 1 : stop].any():
                    hard[[at, stop]] = True
                    inside.append((at + 1, stop))
                    at = text.find(token, stop)
                else:
                    at = text.find(token, at + 1)
        kind = self.classify(points)
        begin = np.empty(n + 1, bool)
        begin[0] = begin[n] = True
        begin[1:n] = kind[1:] != kind[:-1]
        begin |= hard
        space, blank = kind == _SPACE, points == 32
        # the last of a run of white space before other characters stands apart; a blank goes with these
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~hard[1:n])
        begin[last] = True
        begin[last[blank[last]] + 1] = False
        mark = np.flatnonzero((points == 39) & begin[:n] & begin[1:])  # an apostrophe that stands alone so far
        for at in mark[(mark + 1 < n)].tolist():
            if kind[at + 1] == _LETTER and not hard[at + 1]:
                for ending in _ENDINGS:
                    stop = at + 1 + len(ending)
                    if text.startswith(ending, at + 1) and not hard[at + 1 : stop].any():
                        begin[at + 1 : stop] = False
                        begin[stop] = True
                        break
        for a, b in inside:
            begin[a:b] = False
        return np.flatnonzero(begin[:n])

    def cut(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of all texts as places in the list of distinct ones, and where each text's begin."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        parts, counts, at = [], [], 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART, "right")) - 1)
            raw, own = data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            starts = own[:-1][np.diff(own) > 0]
            if self.by_word and len(raw):
                lead = np.flatnonzero((raw & 0xC0) != 0x80)  # the byte at which each character begins
                ends = np.searchsorted(lead, own[1:-1])
                starts = lead[self.words(raw.tobytes().decode(), ends[ends < len(lead)])]
            bounds = np.append(starts, len(raw)).astype(np.int64)
            words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw.tobytes())])
            parts.append(words.dictionary_encode())
            counts.append(np.diff(np.searchsorted(starts, own)))
            at = end
        if not parts:
            return pa.array([], pa.large_string()).dictionary_encode(), np.zeros(1, np.int64)
        whole = pa.chunked_array(parts).unify_dictionaries()
        indices = pa.concat_arrays([c.indices for c in whole.chunks])
        return pa.DictionaryArray.from_arrays(indices, whole.chunk(0).dictionary), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def _splitter(path: str) -> Splitter:
    if path not in _splitters:
        _splitters[path] = Splitter(path)
    return _splitters[path]


def _packed(table: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def _opened(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in order as blocks of about ``BLOCK`` bytes, named by what they hold."""
    held, size = [], 0

    def block() -> pa.RecordBatch:
        docs = pa.concat_batches(held) if len(held) > 1 else held[0]
        packed = _packed(docs)
        name = f"{docs.num_rows}:{zlib.crc32(packed):08x}:{zlib.adler32(packed):08x}:{docs.column(0)[0].as_py()}"
        held.clear()
        return pa.RecordBatch.from_arrays([[name], [packed]], schema=_BLOCK)

    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        docs = pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "text"])
        sizes, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
        while at < docs.num_rows:
            before = int(sizes[at - 1]) if at else 0
            end = max(at + (not held), int(np.searchsorted(sizes, before + BLOCK - size, "right")))
            if end > at:
                held.append(docs.slice(at, end - at))
                size += int(sizes[end - 1]) - before
            if end < docs.num_rows or size >= BLOCK:
                yield block()
                size = 0
            at = end
    if held:
        yield block()


def _by_bucket(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words in order of their bucket, and where each bucket's begin."""
    bucket = np.fromiter((zlib.crc32(w) for w in words.cast(pa.large_binary()).to_pylist()), np.int64, len(words)) % buckets
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _digest(words: pa.Array) -> int:
    return zlib.crc32("\0".join(words.to_pylist()).encode())


def _words(path: str, buckets: int) -> Callable:
    """The distinct words of each block, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, docs in zip(batch.column(0), batch.column(1), strict=True):
                found = _splitter(path).cut(_opened(docs.as_py()).column("text"))[0].dictionary
                order, begin = _by_bucket(found, buckets)
                found = found.take(pa.array(order))
                full = np.flatnonzero(np.diff(begin))
                packed = [_packed(pa.RecordBatch.from_arrays([found.slice(begin[b], begin[b + 1] - begin[b])], names=["word"])) for b in full]
                yield pa.RecordBatch.from_arrays([[name.as_py()] * len(full), pa.array(full, pa.int32()), packed], schema=_WORDS)

    return run


def _encoded(path: str) -> Callable:
    """The ids of each block's words of a bucket; rows come by bucket, and a distinct word of it is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        now = None
        for batch in batches:
            for name, bucket, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    known, now = {}, bucket
                words = _opened(packed).column("word")
                _learn(_splitter(path), known, words.to_pylist())
                yield pa.RecordBatch.from_arrays([[name], pa.array([bucket], pa.int32()), pa.array([_digest(words)]), [_packed(_lists([known[w] for w in words.to_pylist()]))]], schema=_IDS)

    return run


def _learn(splitter: Splitter, known: dict[str, bytes], words: list[str]) -> None:
    new = [w for w in words if w not in known]
    for i in range(0, len(new), 10_000):
        part = new[i : i + 10_000]
        for word, found in zip(part, splitter.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
            known[word] = np.array(found.ids, "<i4").tobytes()


def _lists(ids: list[bytes]) -> pa.RecordBatch:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    offsets = pa.py_buffer(np.append(0, np.cumsum(sizes)))
    values = pa.Array.from_buffers(pa.int32(), int(sizes.sum()), [None, pa.py_buffer(b"".join(ids))])
    return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.large_list(pa.int32()), len(ids), [None, offsets], children=[values])], names=["ids"])


def _placed(path: str, buckets: int) -> Callable:
    """Joins the ids back by position; what a lost task left of another division into words is encoded here."""

    def run(key: tuple, blocks: pa.Table, ids: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})
        docs = _opened(blocks.column("docs")[0].as_py())
        splitter = _splitter(path)
        found, of = splitter.cut(docs.column("text"))
        words = found.dictionary
        order, begin = _by_bucket(words, buckets)
        got = {b: (d, i) for b, d, i in zip(*(ids.column(c).to_pylist() for c in ("bucket", "digest", "ids")), strict=True)} if ids.num_rows else {}
        lists = []
        for b in np.flatnonzero(np.diff(begin)).tolist():
            own = words.take(pa.array(order[begin[b] : begin[b + 1]]))
            digest, packed = got.get(b, (None, None))
            if digest == _digest(own):
                lists.append(_opened(packed).column("ids"))
            else:
                known: dict[str, bytes] = {}
                _learn(splitter, known, own.to_pylist())
                lists.append(_lists([known[w] for w in own.to_pylist()]).column(0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        if lists:
            table = pa.concat_arrays(lists)
            starts, values = np.asarray(table.offsets).astype(np.int64), table.flatten().to_numpy()
            which = place[found.indices.to_numpy()]
            sizes = np.diff(starts)[which]
            ends = np.append(0, np.cumsum(sizes))
            at = np.repeat((starts[:-1] - starts[0])[which] - ends[:-1], sizes) + np.arange(ends[-1])
            texts, values = ends[of], values[at]
        else:
            texts, values = np.zeros(len(of), np.int64), np.zeros(0, np.int32)
        out = pa.ListArray.from_arrays(pa.array(texts, pa.int32()), pa.array(values, pa.int32()))
        # of a block that repeats, with the same name and rows, each copy is written
        return pa.concat_tables([pa.table({"doc_id": docs.column("doc_id"), "ids": out})] * blocks.num_rows)

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``TOKENS`` of every document, as the tokenizer file at ``path`` encodes its whole text without special tokens."""
    ship(docs.sparkSession)
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    buckets = BUCKETS * max(rows.rdd.getNumPartitions(), 1)
    blocks = rows.mapInArrow(_blocks, "block string, docs binary").repartition("block")
    words = blocks.mapInArrow(_words(path, buckets), "block string, bucket int, words binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    ids = words.mapInArrow(_encoded(path), "block string, bucket int, digest long, ids binary")
    return blocks.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_placed(path, buckets), TOKENS)


def pieces(path: str) -> dict[int, bytes]:
    """The bytes of each id of a byte-level file."""
    from tokenizers import Tokenizer

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    tokenizer = Tokenizer.from_file(path)
    return {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}


def _decoded(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _pieces_of:
            table = pieces(path)
            raw = [table.get(i, b"") for i in range(max(table, default=-1) + 2)]  # the last stands for unknown ids
            _pieces_of[path] = np.append(0, np.cumsum([*map(len, raw)])), np.frombuffer(b"".join(raw), np.uint8)
        starts, data = _pieces_of[path]
        unknown = len(starts) - 2
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            lists, texts = batch.column(1), []
            for i in range(len(lists)):
                own = lists[i].values
                ids = own.fill_null(-1).to_numpy() if own is not None else np.zeros(0, np.int64)
                ids = np.where((ids < 0) | (ids > unknown), unknown, ids)
                sizes = starts[ids + 1] - starts[ids]
                ends = np.append(0, np.cumsum(sizes))
                at = np.repeat(starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])
                texts.append(data[at].tobytes().decode("utf-8", "replace") if own is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return run


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` (doc_id, ids) with the text that the ids stand for; special tokens are written out, null ids have a null text."""
    ship(tokens.sparkSession)
    return tokens.select("doc_id", "ids").mapInArrow(_decoded(path), f"{TOKENS}, text string")
