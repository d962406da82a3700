"""Words and shingles of whole texts as numpy arrays, from Arrow string columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D; as these are ASCII, UTF-8 text can be cut
on bytes. Hashes are 64 bits wide. Rows are worked on in chunks of about ``CHUNK`` bytes, so memory
does not follow the batch; one text longer than that is a chunk of its own, and takes some 80 bytes of
memory a byte while it is worked on.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
ODD = _rng.integers(1, 2**63 - 1, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def give_back() -> None:
    """Return what a worker no longer uses to the system, as workers live on for other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least n + 1 of each.

    A worker keeps those that a usual chunk needs (9 MB); more are made anew for a longer text.
    """
    if n <= CHUNK and CHUNK in _powers:
        return _powers[CHUNK]
    size = max(CHUNK, n)
    made = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, p, np.uint64)]), dtype=np.uint64) for p in (_P, pow(_P, -1, 2**64)))
    if size == CHUNK:
        _powers[CHUNK] = made
    return made


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte offset of each row and the end); null texts are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words:
    """Words of the texts of a chunk: byte ``start`` and ``end``, ``hash``, and per text the first word ``of``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool) -> None:
        n = len(data)
        data = LOWER[data] if lower else data
        inside = ~SEPARATOR[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.start, offsets)
        power, inverse = powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """The row in the chunk of each word."""
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether these lie in one text."""
        n = len(self)
        out = np.zeros(n, np.uint64)
        for j in range(min(k, n)):
            out[: n - j] += self.hash[j:] * ODD[j]
        whole = np.repeat(self.of[1:], np.diff(self.of)) - np.arange(n) >= k
        return mix(out), whole

    def shingles(self, k: int) -> Iterator[np.ndarray]:
        """Per text its sorted distinct k-word shingles; a shorter text is one shingle, an empty one none."""
        grams, _ = self.grams(k)
        for a, b in zip(self.of[:-1], self.of[1:], strict=True):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield mix(np.array([np.sum(np.append(self.hash[a:b] * ODD[: b - a], ODD[40 + (b - a) % 20]))], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
