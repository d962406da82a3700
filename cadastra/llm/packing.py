"""Sum-of-squares online packing of token sequences.

Every task packs its own partition of documents, one after the other. ``counts[h]`` is the number of
open windows filled to level h; a document (or what is left of a long one after whole windows are cut
off) goes to the level that makes the sum of squared counts smallest, among equals to the fullest.
When the input ends, the emptiest open windows are cut to fill the others, and the last one is cut at
powers of two, so that a task ends without padding. A task holds the ids of its open windows only; when
these exceed ``HELD`` ids (texts of just over half a window leave every window open), the emptiest are
cut to fill the others in the same way, which bounds the memory and costs no padding.

Rows: a null text is empty, and an empty text is its end id alone; a long text takes whole windows of
its own first. Rows are packed as they come, so repeated ones are packed again; among levels of equal
cost the fullest is taken; a null doc_id is kept. Other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cadastra.llm.textkit import Words, chunks
from cadastra.session import ship

CAPACITY = 4096
#: Words whose ids a worker remembers.
REMEMBERED = 150_000
#: Ids that a task's open windows may hold.
HELD = 4 << 20
#: The normalizers and pattern of tokenizer files whose texts are encoded word by word.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Punctuation that may follow a word as a run of its own; not what begins a suffix or a special token.
_TAIL = ".,:;!?|#%&$*()[]{}/-+=~^@"
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts, as 32-bit numbers; a worker remembers the ids of words by their 64-bit hash.

    Where the file's pattern is ``PATTERN``, which never matches across white space, a text's ids are
    those of its words; with any other file each text is encoded whole. A repeated word has the same
    ids; a long one is encoded like any other.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words: dict[int, bytes] = {}
        self.runs: dict[str, bytes] = {}
        file = json.loads(self.tokenizer.to_str())
        steps = (file["normalizer"] or {}).get("normalizers") or []
        splits = (file["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        odd = any(not t["content"].startswith("<") or any(map(str.isspace, t["content"])) for t in file["added_tokens"])
        self.by_word = [s["type"] for s in steps] == NORMALIZERS and len(splits) == 2 and splits[0].get("pattern") == {"Regex": PATTERN} and splits[0].get("invert") is True and not splits[1].get("add_prefix_space") and not splits[1].get("use_regex") and not odd

    def run(self, run: str) -> bytes:
        """Ids of lower-case letters or of punctuation alone."""
        ids = self.runs.get(run)
        if ids is None:
            shown = run if run.isascii() else self.letters.pre_tokenize_str(run)[0][0]
            ids = np.array([x.id for x in self.tokenizer.model.tokenize(shown)], "<u4").tobytes()
            if len(self.runs) < REMEMBERED // 2:
                self.runs[run] = ids
        return ids

    def word(self, word: str) -> bytes:
        """Ids of one word, together from those of its letters and of the punctuation after them if it has no other parts."""
        letters = word.rstrip(_TAIL)
        if len(letters) < 200 and letters.isalpha() and "Σ" not in letters:
            low = letters.lower()
            if word.isascii() or (low.isalpha() and unicodedata.is_normalized("NFC", letters) and unicodedata.is_normalized("NFC", low)):
                return self.run(low) + self.run(word[len(letters) :]) if len(letters) < len(word) else self.run(low)
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a chunk, one after the other, and where each text's begin."""
        if not self.by_word:
            raw = data.tobytes()
            ids = [self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return np.array([x for own in ids for x in own], "<u4"), np.cumsum([0, *map(len, ids)])
        words, raw = Words(data, offsets, lower=False), data.tobytes()
        hashes, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
        ids = [self.words.get(h) for h in hashes.tolist()]
        for i in [i for i, x in enumerate(ids) if x is None]:
            ids[i] = self.word(raw[words.start[first[i]] : words.end[first[i]]].decode())
            if len(self.words) < REMEMBERED:
                self.words[int(hashes[i])] = ids[i]
        sizes = np.array([len(x) for x in ids], np.int64) // 4
        starts, each = np.cumsum(sizes) - sizes, sizes[which]
        ends = np.concatenate([[0], np.cumsum(each)])
        at = np.repeat(starts[which] - ends[:-1], each) + np.arange(ends[-1])
        return np.frombuffer(b"".join(ids), "<u4")[at], ends[words.of]


class Packer:
    """Windows of one task; a piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first: int, capacity: int) -> None:
        self.capacity, self.next = capacity, first
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}
        self.rows: list[tuple] = []
        self.held = 0

    def close(self, window: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in window:
            self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total, whole = len(ids) // 4, 4 * self.capacity
        at = 0
        while len(ids) - at >= whole:
            self.close([(doc, at // 4, ids[at : at + whole], total)])
            at += whole
        if at < len(ids):
            self.place((doc, at // 4, ids[at:], total))
            if self.held > HELD:
                self.fill()

    def place(self, piece: tuple) -> None:
        counts, size = self.counts, len(piece[2]) // 4
        levels = np.flatnonzero(counts[: self.capacity - size + 1])
        best, level = 2 * counts[size] + 1, 0
        if len(levels):
            filled = levels + size
            cost = np.where(filled == self.capacity, 1 - 2 * counts[levels], 2 * (counts[filled] - counts[levels]) + 2)
            i = len(cost) - 1 - int(np.argmin(cost[::-1]))
            if cost[i] <= best:
                level = int(levels[i])
        window = []
        if level:
            window = self.open[level].pop()
            counts[level] -= 1
        window.append(piece)
        if level + size == self.capacity:
            self.close(window)
            self.held -= level
        else:
            self.put(level + size, window)
            self.held += size

    def put(self, level: int, window: list[tuple]) -> None:
        self.counts[level] += 1
        self.open.setdefault(level, []).append(window)

    def fill(self) -> None:
        """Fill the fullest open windows from the emptiest; one window at most stays open."""
        left = [(level, window) for level in sorted(self.open, reverse=True) for window in self.open[level]]
        i, j = 0, len(left) - 1
        while i < j:
            level, window = left[i]
            while level < self.capacity and i < j:
                given, other = left[j]
                doc, start, ids, total = other.pop()
                take = min(self.capacity - level, len(ids) // 4)
                window.append((doc, start, ids[: 4 * take], total))
                if 4 * take < len(ids):
                    other.append((doc, start + take, ids[4 * take :], total))
                level += take
                left[j] = (given - take, other)
                if not other:
                    j -= 1
            if level < self.capacity:
                left[i] = (level, window)
                break
            self.close(window)
            i += 1
        self.counts[:] = 0
        self.open, self.held = {}, 0
        if i == j:
            self.put(*left[i])
            self.held = left[i][0]

    def end(self) -> None:
        """Fill what is open; cut the last window at powers of two."""
        self.fill()
        for level, (pieces,) in self.open.items():
            pieces = pieces[::-1]
            while level:
                size = 1 << (level.bit_length() - 1)
                window, room = [], size
                while room:
                    doc, start, ids, total = pieces.pop()
                    take = min(room, len(ids) // 4)
                    window.append((doc, start, ids[: 4 * take], total))
                    if 4 * take < len(ids):
                        pieces.append((doc, start + take, ids[4 * take :], total))
                    room -= take
                self.close(window)
                level -= size
        self.open = {}


def _packed(path: str, end_id: int, capacity: int) -> Callable:
    """Packs a partition's rows as they come; a null text is empty, repeated ones are packed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 7
        names = [c.split()[0] for c in PIECES.split(", ")]
        end = struct.pack("<I", end_id)
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)

        def ready() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 7, types, strict=True)], names=names)

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for at, last, data, offsets in chunks(batch.column(1)):
                ids, of = encoder.encode(data, offsets)
                for i in range(at, last):
                    packer.add(docs[i], ids[of[i - at] : of[i - at + 1]].tobytes() + end)
            yield ready()
        packer.end()
        yield ready()

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document with their place: ``PIECES``; ``tokenizer`` is the path of its file."""
    ship(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_packed(tokenizer, end_id, capacity), PIECES)
