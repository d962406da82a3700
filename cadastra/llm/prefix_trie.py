"""Prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns. Conversations are first made one row each of turn hashes;
those with the same turns become one row, with the hash of their ids. These rows are sorted by their turns
and cut into ranges. A task peels its range: it descends from the greatest depth, merges the conversations
that end there with the nodes that survived from below, emits the finished nodes, strips the last turn and
regroups, so nodes are found and summed in one pass. Only the prefixes of the first and of the last row of a
range can go on in a neighbouring range; what the range holds for them is carried as two rows with a
contribution at each depth, and the next round peels these in the same way. Every round leaves two rows a
range, so there are as many rounds as the logarithm of the rows, at any depth, and a prefix that a third of
all conversations share is dealt to as many ranges as they fill.

Rows: null role or text is empty; rows without a conv_id belong to no conversation and take no part; turns
go by their number, null first, those of one number by a hash of role and text, so repeated rows are turns
of their own next to each other. An empty table has no node, not even a root. Other columns are ignored.
A turn is known by the MD5 hash of its role and text, and a task holds the hashes of a whole conversation
(16 bytes a turn), as it would hold one text. The hash of the ids that end in a node is a sequential one by
contract: its task reads them in order from pieces, and holds one batch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import cut, hot_keys, spread_join
from cadastra.session import ship

#: Rows of a range, and conversation ids of a piece of the list that is hashed.
RANGE_ROWS, PIECE_IDS = 20_000, 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: A row to be peeled: turn hashes and text lengths, then what it holds for the nodes of its own path at the depths ``at``.
PATH = "path array<binary>, sizes array<long>, at array<int>, n array<long>, conv array<long>, children array<long>, leaves array<long>, saved array<long>, ends array<string>"
_PEELED = f"{NODE}, key binary, parent_key binary, {PATH}"
_NONE = np.iinfo(np.int64).max
_PIECE = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
_ENDS = pa.schema([("key", pa.binary()), ("ends", pa.string())])


def rebuilt(turns: DataFrame) -> DataFrame:
    """Each conversation with the first h turns of the conversation c - c % 100 in place of its own: conv_id, path, sizes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    hashed = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", hashed.alias("hash"), F.char_length(text).cast("long").alias("size")).alias("t"))
    rows = rows.filter("conv_id IS NOT NULL").withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    own = rows.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    first = own.filter("conv_id = base").select("base", F.slice("own", 1, 5).alias("first"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    begin = F.when(F.col("first").isNotNull(), F.slice("first", F.lit(1), taken)).otherwise(F.slice("own", 1, 0))
    whole = F.concat(begin, F.slice("own", taken + 1, F.size("own")))
    found = own.join(first, "base", "left").select("conv_id", whole.alias("turns"))
    return found.select("conv_id", F.col("turns.hash").alias("path"), F.col("turns.size").alias("sizes"))


def _key(path: Column) -> Column:
    """16 bytes that stand for a sequence of turns."""
    return F.unhex(F.md5(F.array_join(F.transform(path, F.hex), "").cast("binary")))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) as pieces (key, first conv_id, decimal ids joined by commas); ids that repeat are kept."""
    key, ids = None, []
    made: list[tuple] = []

    def flush() -> None:
        if ids:
            made.append((key, ids[0], ",".join(map(str, ids))))
            ids.clear()

    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key or len(ids) >= PIECE_IDS:
                flush()
                key = k
            ids.append(c)
        if made:
            yield _table(made, _PIECE)
            made.clear()
    flush()
    if made:
        yield _table(made, _PIECE)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of (key, first conv_id) as one SHA-256 a key."""
    key, state = None, None
    for batch in batches:
        made = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if state is None or k != key:
                if state is not None:
                    made.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if made:
            yield _table(made, _ENDS)
    if state is not None:
        yield _table([(key, state.hexdigest())], _ENDS)


def ended(convs: DataFrame, ranges: int) -> DataFrame:
    """One row for each distinct whole conversation of ``rebuilt``, as a ``PATH`` with one contribution at its last depth.

    Equal conversations are summed before the shuffle; their ids travel apart from the turns, are sorted over
    ``ranges`` ranges and hashed from pieces, so many copies of one conversation don't gather in a task.
    """
    keyed = convs.withColumn("key", _key(F.col("path")))
    sums = keyed.groupBy("key").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("conv"))
    ids = keyed.select("key", "conv_id").repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = ids.mapInArrow(_pieces, "key binary, first long, ids string")
    hashes = pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends string")
    one = lambda c: F.array(c)
    zero = F.array(F.lit(0).cast("long"))
    return sums.join(hashes, "key").select(
        "path", "sizes", one(F.size("path")).alias("at"), one(F.col("n")).alias("n"), one(F.col("conv")).alias("conv"), zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), one(F.col("ends")).alias("ends")
    )


def _shared(paths: list[bytes]) -> np.ndarray:
    """Of each row the number of first turns that it shares with the row before; -1 for the first."""
    out = np.full(len(paths), -1, np.int64)
    for i in range(1, len(paths)):
        a, b = paths[i - 1], paths[i]
        low, high = 0, min(len(a), len(b)) // 16
        while low < high:  # the largest number of turns that are equal
            mid = (low + high + 1) // 2
            low, high = (mid, high) if a[: 16 * mid] == b[: 16 * mid] else (low, mid - 1)
        out[i] = low
    return out


class _Peel:
    """Peels the sorted rows of one range; ``last`` says that there is no other range."""

    def __init__(self, rows: pa.Table, last: bool) -> None:
        self.paths = [b"".join(p) for p in rows.column("path").to_pylist()]
        self.sizes = [np.array(s, np.int64) for s in rows.column("sizes").to_pylist()]
        self.depth = np.array([len(p) // 16 for p in self.paths], np.int64)
        self.lcp, self.last = _shared(self.paths), last
        lists = {c: rows.column(c).combine_chunks() for c in ("at", "n", "conv", "children", "leaves", "saved", "ends")}
        row = np.repeat(np.arange(len(self.paths)), np.diff(np.asarray(lists["at"].offsets)))
        flat = {c: lists[c].flatten() for c in lists}
        at = flat["at"].to_numpy(zero_copy_only=False)
        order = np.lexsort((row, at))
        self.row, self.at = row[order], at[order]
        self.value = {c: flat[c].to_numpy(zero_copy_only=False)[order] for c in ("n", "conv", "children", "leaves", "saved", "ends")}
        self.nodes: list[dict[str, np.ndarray]] = []
        #: What is held for the open prefixes of the first and of the last row: lists (depth, n, conv, children, leaves, saved, ends).
        self.open: dict[int, list[tuple]] = {0: [], len(self.paths) - 1: []}

    def key(self, row: int, depth: int) -> bytes:
        return hashlib.md5(self.paths[row][: 16 * depth]).digest()

    def run(self) -> None:
        """From the greatest depth to the root."""
        ends, below = len(self.at), {c: np.zeros(0, np.int64) for c in ("row", "n", "conv", "leaves", "saved", "node")}
        closing = len(self.paths) - 1
        for d in range(int(self.depth.max()), -1, -1):
            begins = int(np.searchsorted(self.at, d, "left"))
            own = slice(begins, ends)
            ends = begins
            k, m = len(below["row"]), len(self.row[own])
            items = np.concatenate([below["row"], self.row[own]])
            order = np.argsort(items, kind="stable")
            held_rows = items[order]
            start = np.flatnonzero((self.lcp[held_rows] < d) & (np.diff(held_rows, prepend=-1) != 0))
            group = np.empty(k + m, np.int64)
            group[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, k + m)))
            first, of_below, of_own = held_rows[start], group[:k], group[k:]
            closed = below["node"] >= 0
            n, children, leaves, saved = (self._sums(of_own, self.value[c][own], len(start)) for c in ("n", "children", "leaves", "saved"))
            children += np.bincount(of_below[closed], minlength=len(start))
            for total, c in ((n, "n"), (leaves, "leaves"), (saved, "saved")):
                total += self._sums(of_below, below[c], len(start))
            conv = np.full(len(start), _NONE)
            np.minimum.at(conv, of_below, below["conv"])
            np.minimum.at(conv, of_own, self.value["conv"][own])
            ended = np.full(len(start), None, object)
            some = np.array([x is not None for x in self.value["ends"][own]], bool)
            ended[of_own[some]] = self.value["ends"][own][some]
            shared = np.zeros(len(start), bool)
            if not self.last:
                shared[0] = first[0] == 0
                shared[-1] |= self.depth[closing] >= d
            done = np.flatnonzero(~shared)
            leaves[done] = np.where(children[done] == 0, 1, leaves[done])
            if d:
                saved[done] += (n[done] - 1) * np.array([self.sizes[r][d - 1] for r in first[done]], np.int64)
            for g in np.flatnonzero(shared):
                at = 0 if first[g] == 0 else closing
                self.open[at].append((d, int(n[g]), int(conv[g]), int(children[g]), int(leaves[g]), int(saved[g]), ended[g]))
            if self.nodes:  # the nodes of the depth below learn of their parents
                held = self.nodes[-1]
                held["parent"][below["node"][closed]] = np.where(shared[of_below[closed]], _NONE, conv[of_below[closed]])
                held["parent_first"][below["node"][closed]] = first[of_below[closed]]
            self.nodes.append({
                "conv": conv[done], "depth": np.full(len(done), d), "parent": np.full(len(done), _NONE), "parent_first": np.full(len(done), -1), "n": n[done], "children": children[done],
                "leaves": leaves[done], "saved": saved[done], "ends": ended[done], "first": first[done],
            })
            node = np.full(len(start), -1, np.int64)
            node[done] = np.arange(len(done))
            zero = np.where(shared, 0, 1)
            below = {"row": first, "n": n * zero, "conv": np.where(shared, _NONE, conv), "leaves": leaves * zero, "saved": saved * zero, "node": node}

    @staticmethod
    def _sums(group: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size, np.int64)
        np.add.at(out, group, value.astype(np.int64))
        return out

    def batches(self, keys: bool) -> Iterator[pa.RecordBatch]:
        """Finished nodes, and rows of what is open; ``keys``: with the key of each node, for its children of an earlier round."""
        schema = _arrow_schema()
        path_columns = [f.name for f in schema][10:]
        for held in self.nodes:
            size = len(held["conv"])
            if not size:
                continue
            depth = int(held["depth"][0])
            pending = (held["parent"] == _NONE) & (held["parent_first"] >= 0)
            parent_key = [self.key(int(r), depth - 1) if p else None for p, r in zip(pending, held["parent_first"], strict=True)]
            columns = {
                "conv_id": pa.array(held["conv"]), "depth": pa.array(held["depth"]), "parent_conv_id": pa.array(held["parent"], mask=held["parent"] == _NONE),
                "n_convs": pa.array(held["n"]), "n_children": pa.array(held["children"]), "n_leaves": pa.array(held["leaves"]), "saved_tokens": pa.array(held["saved"]),
                "ends_sha256": pa.array([x if x is not None else NO_ENDS for x in held["ends"]], pa.string()),
                "key": pa.array([self.key(int(r), depth) for r in held["first"]] if keys else [None] * size, pa.binary()), "parent_key": pa.array(parent_key, pa.binary()),
            }
            columns |= {c: pa.nulls(size, schema.field(c).type) for c in path_columns}
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)
        if self.last:
            return
        for row, held in self.open.items():
            if held:
                at, *values = (list(c) for c in zip(*held[::-1], strict=True))
                path = [self.paths[row][i : i + 16] for i in range(0, len(self.paths[row]), 16)]
                filled = dict(zip(path_columns, [path, self.sizes[row].tolist(), at, *values], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([filled.get(f.name)], f.type) for f in schema], schema=schema)


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in _PEELED.split(", "))])


def _peeled(last: bool, keys: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if sum(b.num_rows for b in rows):
            peel = _Peel(pa.Table.from_batches(rows), last)
            peel.run()
            yield from peel.batches(keys)

    return run


def prefix_trie(turns: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: ``NODE``; ``range_rows`` conversations are peeled by a task."""
    ship(turns.sparkSession)
    names = [c.split()[0] for c in PATH.split(", ")]
    convs = cut(rebuilt(turns))
    paths = cut(ended(convs, -(-max(1, convs.count()) // range_rows)))
    found: list[DataFrame] = []
    while True:
        left = paths.count()
        last = left <= max(2, min(range_rows, 1000)) or (not found and left <= range_rows)
        dealt = paths.coalesce(1).sortWithinPartitions("path") if last else paths.repartitionByRange(-(-left // range_rows), "path").sortWithinPartitions("path")
        peeled = cut(dealt.mapInArrow(_peeled(last, keys=bool(found)), _PEELED))
        found.append(peeled.filter("conv_id IS NOT NULL").drop(*names))
        if last:
            break
        paths = peeled.filter("conv_id IS NULL").select(names)
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    if len(found) > 1:  # children of nodes that ranges shared; the root's may be a third of all
        parents = nodes.filter("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
        waiting = nodes.filter("parent_key IS NOT NULL")
        hot = hot_keys(waiting.groupBy("parent_key").count(), ["parent_key"])
        known = spread_join(waiting, parents, ["parent_key"], hot, ["conv_id", "depth"]).withColumn("parent_conv_id", F.col("_parent"))
        nodes = nodes.filter("parent_key IS NULL").unionByName(known.drop("_parent"))
    return nodes.select(*(c.split()[0] for c in NODE.split(", ")))
