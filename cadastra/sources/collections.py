"""Large JSON collections as Spark data sources: scans that split inside one file, and a canonical sink.

A collection is one JSON object with a long array, such as the features of a FeatureCollection or the edges of
a graph. Whether a byte lies inside a string, and at which depth, depends on all bytes before it; so a first
scan gives a few numbers for each range of bytes, for either state that the range may begin in, and folding
these (a row a range) tells the true state at every begin. The second scan then cuts each range's elements
exactly, whatever braces, quotes or nested arrays they hold; an element belongs to the range it begins in.

The sink writes lines in order of their id as parts that make one valid file when joined in order of their
names. Each task gives its count, bytes, box and digest, and the commit folds these in order; the digest is a
polynomial of the bytes that can be joined, so it doesn't depend on how the lines were cut into parts. A task
that is retried writes a part of another name, and only what is committed stays.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers need no copy of the package

#: Bytes of a range, and of the ranges that one task reads one after the other.
SPLIT = TASK = 32 << 20
#: The digest's modulus and base: a sum of bytes times powers of the base.
MODULUS, BASE = 2**31 - 1, 1_000_003
HEAD, TAIL = b'{"type":"FeatureCollection","features":[', b"\n]}\n"
#: Bytes read at once, and those first read to find the end of an element that goes on behind its range.
_STEP, _AHEAD = 1 << 20, 1 << 12


class Joined:
    """The files of a folder in order of their names, or one file, as one run of bytes."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        self.files, where = fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)
        info = self.files.get_file_info(where)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        parts = [info] if info.is_file else sorted((x for x in self.files.get_file_info(fs.FileSelector(where)) if x.is_file and x.base_name[0] not in "._"), key=lambda x: x.path)
        self.parts = [(x.path, x.size) for x in parts]
        self.size = sum(size for _, size in self.parts)

    def read(self, start: int, end: int) -> bytes:
        out, at = [], 0
        for path, size in self.parts:
            a, b = max(start, at), min(end, at + size)
            if a < b:
                with self.files.open_input_file(path) as f:
                    out.append(f.read_at(b - a, a - at))
            at += size
        return b"".join(out)

    def escapes(self, at: int) -> int:
        """How many backslashes stand right before a byte."""
        n, low = 0, at
        while low > 0:
            data = self.read(max(0, low - 64), low)
            own = len(data) - len(data.rstrip(b"\\"))
            n += own
            if own < len(data):
                break
            low -= len(data)
        return n


def _marks(data: bytes, escapes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether a string that is closed at the begin is open there, and the change of depth it would make outside of strings."""
    raw = np.frombuffer(data, np.uint8)
    slash = raw == 92
    quote = raw == 34
    if escapes or slash.any():  # a quote after an odd number of backslashes is part of the string
        n = len(raw)
        last = np.maximum.accumulate(np.where(slash, -1, np.arange(n)))  # the last byte that is no backslash
        before = np.empty(n, np.int64)
        if n:
            before[0] = escapes
            run = np.arange(n - 1) - last[:-1]
            before[1:] = np.where(last[:-1] < 0, run + escapes, run)
        quote &= before % 2 == 0
    inside = (np.cumsum(quote) % 2).astype(bool)
    change = np.zeros(len(raw), np.int8)
    change[(raw == 123) | (raw == 91)] = 1
    change[(raw == 125) | (raw == 93)] = -1
    return inside, change


def _ranges(size: int, split: int) -> list[tuple[int, int]]:
    return [(a, min(a + split, size)) for a in range(0, size, split)]


@dataclass
class Range(InputPartition):
    start: int
    end: int
    inside: bool = False
    depth: int = 0
    opens: int = 0


@dataclass
class Ranges(InputPartition):
    """Neighbouring ranges that one task reads; small ranges so make no more tasks than large ones."""

    own: list[Range]


def _grouped(ranges: list[Range], task: int) -> list[Ranges]:
    groups: dict[int, list[Range]] = {}
    for r in ranges:
        groups.setdefault(r.start // task, []).append(r)
    return [Ranges(own) for own in groups.values()]


class RangeSource(DataSource):
    """First scan: for each range and each state it may begin in, what it does to the state."""

    @classmethod
    def name(cls) -> str:
        return "json_ranges"

    def schema(self) -> str:
        return "start long, quoted boolean, ends_quoted boolean, depth long, least long, opens long, opens_depth long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RangeReader(self.options)


class RangeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.key, self.split = options["path"], options["key"], int(options["split"])
        self.task = int(options.get("task", self.split))

    def partitions(self) -> list[InputPartition]:
        return _grouped([Range(a, b) for a, b in _ranges(Joined(self.path).size, self.split)], self.task)

    def read(self, partition: Ranges) -> Iterator[tuple]:
        source = Joined(self.path)
        for own in partition.own:
            yield from self.told(source, own)

    def told(self, source: Joined, partition: Range) -> Iterator[tuple]:
        data = source.read(partition.start, partition.end)
        inside, change = _marks(data, source.escapes(partition.start))
        # a key may go on in the next range: it belongs to the range in which it begins
        ahead = source.read(partition.end, partition.end + len(self.key) + 64)
        found = [(m.start(), m.end()) for m in re.finditer(rb'"' + re.escape(self.key.encode()) + rb'"[\x20\t\r\n]*:[\x20\t\r\n]*\[', data + ahead) if m.start() < len(data)]
        for quoted in (False, True):
            depth = np.cumsum(np.where(inside ^ quoted, 0, change), dtype=np.int64)
            # a key's opening quote is inside of a string, what comes before it isn't
            keys = [(int(depth[a - 1]) if a else 0, partition.start + b) for a, b in found if bool(inside[a]) ^ quoted]
            at_depth, opens = min(keys, default=(None, None))
            yield partition.start, quoted, bool(inside[-1]) ^ quoted, int(depth[-1]), int(depth.min()), opens, at_depth


class ElementSource(DataSource):
    """Second scan: the elements of the array, each with the place of its first byte."""

    @classmethod
    def name(cls) -> str:
        return "json_elements"

    def schema(self) -> str:
        return "at long, element string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ElementReader(self.options)


class ElementReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.ranges, self.task = options["path"], [Range(*r) for r in json.loads(options["ranges"])], int(options.get("task", 1))

    def partitions(self) -> list[InputPartition]:
        return _grouped(self.ranges, self.task) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        source = Joined(self.path)
        for own in partition.own:
            yield from self.elements(source, own)

    def elements(self, source: Joined, partition: Range) -> Iterator[tuple]:
        at, depth, quoted = partition.start, partition.depth, partition.inside
        begun, held, ahead = None, [], _AHEAD
        if partition.opens > at:  # the array opens inside this range
            data = source.read(at, partition.opens)
            inside, change = _marks(data, source.escapes(at))
            depth += int(np.where(inside ^ quoted, 0, change).sum())
            quoted, at = bool(inside[-1]) ^ quoted, partition.opens
        while at < source.size and (at < partition.end or begun is not None):
            if at < partition.end:
                data = source.read(at, min(at + _STEP, partition.end))
            else:
                data, ahead = source.read(at, at + ahead), min(2 * ahead, _STEP)
            inside, change = _marks(data, source.escapes(at))
            level = depth + np.cumsum(np.where(inside ^ quoted, 0, change), dtype=np.int64)
            before = np.concatenate([[depth], level[:-1]])
            moved = level != before
            events = np.flatnonzero(moved & (((before == 2) & (level == 3)) | ((before == 3) & (level == 2)) | (level == 1)))
            from_ = 0
            for e in events.tolist():
                if level[e] == 1:  # the array ends
                    return
                if level[e] == 3 and begun is None:
                    if at + e >= partition.end:
                        return
                    begun, from_ = at + e, e
                elif level[e] == 2 and begun is not None:
                    held.append(data[from_ : e + 1])
                    yield begun, b"".join(held).decode()
                    begun, held = None, []
                    if at + e + 1 >= partition.end:
                        return
            if begun is not None:
                held.append(data[from_:] if begun >= at else data)
            depth, quoted, at = int(level[-1]), bool(inside[-1]) ^ quoted, at + len(data)


def folded(told: dict[tuple[int, bool], tuple], size: int, split: int) -> list[tuple]:
    """The true state at the begin of each range that the array meets: start, end, inside a string, depth, where the array opens."""
    ranges, depth, quoted, opened, over = [], 0, False, None, False
    for a, b in _ranges(size, split):
        _, _, ends_quoted, change, least, opens, opens_depth = told[a, quoted]
        began = depth
        if opened is None and opens is not None and depth + opens_depth == 1:
            opened = opens
        if opened is not None and not over:
            ranges.append((a, b, quoted, began, opened))
            # it is over in a range that begins behind the opening and comes back to the root's depth
            over = opened <= a and began + least <= 1
        depth, quoted = depth + change, ends_quoted
    return ranges


def scan_elements(spark: SparkSession, path: str, key: str, split: int = SPLIT) -> DataFrame:
    """``at, element``: each object of the array that the root object of a JSON file holds under ``key``, as text.

    ``path`` is a file or a folder of parts; it is cut in ranges of ``split`` bytes, and a task reads
    one or more, so that there are some tasks a core, or one for ``TASK`` bytes. A file without the key, or
    an empty one, has no element. The folded states are a few numbers a range.
    """
    spark.dataSource.register(RangeSource)
    spark.dataSource.register(ElementSource)
    size = Joined(path).size
    task = max(split, min(TASK, -(-size // (4 * spark.sparkContext.defaultParallelism))))
    rows = spark.read.format("json_ranges").options(path=path, key=key, split=split, task=task).load().collect() if size else []
    ranges = folded({(r.start, r.quoted): tuple(r) for r in rows}, size, split)
    return spark.read.format("json_elements").options(path=path, ranges=json.dumps(ranges), task=task).load()


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    count: int
    size: int
    digest: int
    box: list


def digest_of(data: bytes) -> int:
    """The polynomial of some bytes: the digest of joined bytes follows from theirs."""
    raw, total = np.frombuffer(data, np.uint8).astype(np.uint64), 0
    powers = _powers()
    for i in range(0, len(raw), len(powers)):
        own = raw[i : i + len(powers)]
        total = (total * pow(BASE, len(own), MODULUS) + int((own * powers[len(powers) - len(own) :] % MODULUS).sum())) % MODULUS
    return total


_made: list[np.ndarray] = []


def _powers() -> np.ndarray:
    """Powers of the base, falling to 1."""
    if not _made:
        powers = np.ones(4096, np.uint64)
        for i in range(len(powers) - 2, -1, -1):
            powers[i] = powers[i + 1] * np.uint64(BASE) % np.uint64(MODULUS)
        _made.append(powers)
    return _made[0]


def joined(left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int]:
    """(digest, size) of bytes one after the other."""
    return (left[0] * pow(BASE, right[1], MODULUS) + right[0]) % MODULUS, left[1] + right[1]


class CanonicalSink(DataSource):
    """``id, json, west, south, east, north`` as parts of one file."""

    @classmethod
    def name(cls) -> str:
        return "canonical_collection"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return CanonicalWriter(self.options)


class CanonicalWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.first = options["path"], options.get("first")

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if re.match(r"[a-z0-9]+:", self.path) else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        from pyspark import TaskContext

        files, where = self._files()
        part = TaskContext.get().partitionId()
        name = f"part-{part:08d}-{uuid.uuid4().hex}.json"
        count, state, box = 0, (0, 0), [None] * 4
        files.create_dir(where)
        with files.open_output_stream(f"{where}/_{name}") as out:
            for row in iterator:
                line = (b"\n" if str(row["id"]) == self.first else b",\n") + row["json"].encode()
                out.write(line)
                state = joined(state, (digest_of(line), len(line)))
                count += 1
                for i, (side, pick) in enumerate((("west", min), ("south", min), ("east", max), ("north", max))):
                    if row[side] is not None:
                        box[i] = row[side] if box[i] is None else pick(box[i], row[side])
        return Written(part, name, count, state[1], state[0], box)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Name the parts that count, and fold what they hold in order."""
        files, where = self._files()
        for old in files.get_file_info(_selector(where)):
            if old.is_file and not old.base_name.startswith("_part-"):
                files.delete_file(old.path)
        state, count, box = (digest_of(HEAD), len(HEAD)), 0, [None] * 4
        _put(files, f"{where}/part-00000000-.json", HEAD)
        for m in sorted((m for m in messages if m is not None and m.count), key=lambda m: m.part):
            files.move(f"{where}/_{m.name}", f"{where}/{m.name}")
            state, count = joined(state, (m.digest, m.size)), count + m.count
            for i, pick in enumerate((min, min, max, max)):
                box[i] = m.box[i] if box[i] is None else box[i] if m.box[i] is None else pick(box[i], m.box[i])
        _put(files, f"{where}/part-99999999.json", TAIL)
        state = joined(state, (digest_of(TAIL), len(TAIL)))
        for left in files.get_file_info(_selector(where)):
            if left.base_name.startswith("_part-"):  # of tasks that were lost or empty
                files.delete_file(left.path)
        _put(files, f"{where}.manifest.json", json.dumps({"features": count, "bytes": state[1], "digest": state[0], **dict(zip(("west", "south", "east", "north"), box, strict=True))}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, where = self._files()
        for m in messages:
            if m is not None:
                files.delete_file(f"{where}/_{m.name}")


def _selector(where: str):
    from pyarrow import fs

    return fs.FileSelector(where)


def _put(files, path: str, data: bytes) -> None:
    with files.open_output_stream(path) as out:
        out.write(data)


MANIFEST = "features long, bytes long, digest long, west double, south double, east double, north double"


def write_collection(lines: DataFrame, path: str) -> DataFrame:
    """Write ``id, json, west, south, east, north`` in order of id as one canonical collection in parts; its manifest as one row.

    Ids are distinct; a row without one is an error. A collection that was at ``path`` is replaced.
    """
    spark = lines.sparkSession
    spark.dataSource.register(CanonicalSink)
    ident = F.coalesce(F.col("id"), F.raise_error(F.lit("a feature without an id")).cast(lines.schema["id"].dataType))
    lines = lines.select(ident.alias("id"), "json", *(F.col(c).cast("double").alias(c) for c in ("west", "south", "east", "north")))
    first = lines.agg(F.min("id")).first()[0]
    ordered = lines.repartitionByRange("id").sortWithinPartitions("id")
    ordered.write.format("canonical_collection").mode("overwrite").options(path=path, **({} if first is None else {"first": str(first)})).save()
    return spark.read.schema(MANIFEST).json(f"{path}.manifest.json")


def shapes(polygons: Column, digits: int = 6) -> Column:
    """GeoJSON text of an array of polygons, each an array of rings with its holes: a Polygon if there is one, else a MultiPolygon."""
    place = lambda p: F.array(F.bround(p["lon"], digits), F.bround(p["lat"], digits))
    all_ = F.transform(polygons, lambda rings: F.transform(rings, lambda ring: F.transform(ring, place)))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), all_[0].alias("coordinates")))
    return F.when(F.size(polygons) == 1, one).otherwise(F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), all_.alias("coordinates"))))


def canonical_lines(df: DataFrame, ident: str, properties: list[str], polygons: str, digits: int = 6) -> DataFrame:
    """``id, json, west, south, east, north``: a feature a row, all rings kept, properties in order of their names; the box is of the rounded places."""
    text = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*sorted(properties))), F.lit(',"geometry":'), shapes(F.col(polygons), digits), F.lit("}"))
    places = F.flatten(F.flatten(F.col(polygons)))
    side = lambda pick, axis: F.bround(pick(F.transform(places, lambda p: p[axis])), digits)
    box = (side(F.array_min, "lon").alias("west"), side(F.array_min, "lat").alias("south"), side(F.array_max, "lon").alias("east"), side(F.array_max, "lat").alias("north"))
    return df.select(F.col(ident).alias("id"), text.alias("json"), *box)
