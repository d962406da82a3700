"""N-gram Jaccard join by a token-group matrix.

Documents are sets of k-word shingles. Documents of one set form a class, of which the smallest
doc_id goes on. Then

1. each class looks for a leader, an earlier class that agrees in several of ``HASHES`` minimum
   hashes. This partitions similar documents into groups, whether they link or not. Classes that do
   link with their leader are put together, so most copies are connected from here on;
2. each group is cut into blocks of bounded size, and the matrix (token, block) holds the union of
   the tokens in its members' prefixes. A prefix is the 1 - t share of a set that comes first in one
   global order (frequent shingles last); two sets of Jaccard t or more share prefix tokens, and a
   lower bound on how many follows from the sizes;
3. a document opens a block only if it meets enough of the tokens of members not connected with it.
   There the union of the members' whole sets bounds the overlap again, and only then are these
   members compared.

Steps 1 and the order in step 2 affect the work and never the result: every pair that could link
and isn't connected yet is compared exactly. A token is joined with the blocks of a like size only
(``_band``). Joins on a class or token that very many rows share are dealt out by ``spread_join``, those on
a minimum hash, group or block by adaptive execution.

Rows: a null or wordless text is an empty set, which links with nothing; a long text is one set. Rows
of equal doc_id count as one document. A null doc_id gets a null component. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import HOT, HOT_LEAST, components, cut, hot_keys, small, spread_join
from cadastra.llm.textkit import Words, chunks, mix
from cadastra.session import ship

HASHES = 8
#: Minimum hashes that a document and its leader must share.
AGREE = 3
#: Shingles seen this often among about ``WINDOW`` are put last in the order of prefixes, the
#: ``FREQUENT`` most frequent ones by their count.
WINDOW, SEEN, FREQUENT = 1_000_000, 4, 50_000
#: Shingles of a block, queries of a block, documents whose ids may be broadcast, and rows a worker unpacks at once.
BLOCK, QUERIES, BROADCAST, SLICE = 200_000, 500, 2_000_000, 500
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64))[:, None]
_SIGNED = "doc_id long, n long, k1 long, k2 long, mins array<long>"


def _signatures(k: int) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("mins", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def frequent() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            values, counts = values[counts >= SEEN], counts[counts >= SEEN]
            none = pa.nulls(len(values), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.array(counts.astype(np.int64)), pa.array(values.view(np.int64)), none, pa.nulls(len(values), pa.list_(pa.int64()))], schema=schema)

        size = 0
        for batch in batches:
            for at, end, data, offsets in chunks(batch.column(1)):
                ns, k1, k2, mins = [], [], [], []
                for s in Words(data, offsets, lower=True).shingles(k):
                    ns.append(len(s))
                    scrambled = mix(s ^ np.uint64(0x5BD1E995))
                    k1.append(int(scrambled.sum().view(np.int64)))
                    k2.append(int(np.bitwise_xor.reduce(scrambled).view(np.int64)))
                    mins.append(mix(s ^ _SEEDS).min(axis=1).view(np.int64) if len(s) else np.zeros(0, np.int64))
                    held.append(s)
                    size += len(s)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(m) for m in mins])]).astype(np.int32), np.concatenate(mins))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(ns, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), lists], schema=schema)
                if size >= WINDOW:
                    yield frequent()
                    held.clear()
                    size = 0
        yield frequent()

    return run


def _prefixes(k: int, num: int, den: int, late: np.ndarray, rank: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in chunks(batch.column(1)):
                parts = []
                for s in Words(data, offsets, lower=True).shingles(k):
                    p = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                    if len(late) and len(s):
                        i = np.minimum(np.searchsorted(late, s), len(late) - 1)
                        s = s[np.argsort(np.where(late[i] == s, rank[i], 0), kind="stable")]
                    parts.append(s[:p].view(np.int64))
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32), np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), lists], names=["doc_id", "tokens"])

    return run


def _sets(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in chunks(batch.column(1)):
                sets = [s.tobytes() for s in Words(data, offsets, lower=True).shingles(k)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(sets, pa.binary())], names=["doc_id", "tokens"])

    return run


def _opened(num: int, den: int) -> Callable:
    """Over rows sorted by block and kind (members first): a query's links with parts not its own, one each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, union = None, [], [], None
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            a, b = [], []
            for gid, block, salt, kind, doc, part, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (gid, block, salt) != key:
                    key, ids, sets, union = (gid, block, salt), [], [], None
                tokens = np.frombuffer(tokens, np.uint64)
                if kind == 0:
                    ids.append((doc, part))
                    sets.append(tokens)
                    continue
                if not ids or not len(tokens):
                    continue
                if union is None:
                    joined = np.concatenate(sets)
                    union, sizes = np.unique(joined), np.array([len(s) for s in sets])
                    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                    parts = np.array([p for _, p in ids])
                met = np.count_nonzero(union[np.minimum(np.searchsorted(union, tokens), len(union) - 1)] == tokens)
                if den * met < num * len(tokens):
                    continue
                same = tokens[np.minimum(np.searchsorted(tokens, joined), len(tokens) - 1)] == joined
                shared = np.add.reduceat(same.astype(np.int64), starts)
                found = np.flatnonzero((den * shared >= num * (len(tokens) + sizes - shared)) & (parts < part))
                for i in found[np.unique(parts[found], return_index=True)[1]]:
                    a.append(doc)
                    b.append(ids[i][0])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _links(texts: DataFrame, k: int, num: int, den: int, members: DataFrame, queries: DataFrame) -> DataFrame:
    """Open each block ``(gid, block)`` of ``members`` by the documents of ``queries``, both with their ``part``.

    A block with many queries is worked on in several places, each with all its members.
    """
    # a table of its own: broadcast, or else joined so that adaptive execution can deal out the queries of one block
    many = small(cut(queries.groupBy("gid", "block").agg(F.ceil(F.count("*") / QUERIES).alias("salts"))), BROADCAST)
    queries = cut(queries.join(many, ["gid", "block"]).select("gid", "block", F.expr("pmod(xxhash64(doc_id), salts)").alias("salt"), F.lit(1).alias("kind"), "doc_id", "part"))
    members = members.join(many, ["gid", "block"]).select("gid", "block", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"), F.lit(0).alias("kind"), "doc_id", "part")
    rows = cut(queries.unionByName(members))
    sets = texts.join(small(rows.select("doc_id").distinct(), BROADCAST), "doc_id", "left_semi").mapInArrow(_sets(k), "doc_id long, tokens binary")
    rows = rows.join(sets, "doc_id").select("gid", "block", "salt", "kind", "doc_id", "part", "tokens")
    rows = rows.repartition("gid", "block", "salt").sortWithinPartitions("gid", "block", "salt", "kind")
    return rows.mapInArrow(_opened(num, den), "a long, b long")


def demanded(num: int, den: int) -> str:
    """Prefix tokens that ``n`` shingles share at least with a linked set of ``least`` to ``most``, as SQL.

    The count grows with the other size up to ``n`` and falls beyond it but for its two ceilings, which
    sway it by less than two, so the least one is that of ``least`` or of one of the largest few sizes.
    """
    need = lambda s: f"ceil({num} * (n + {s}) / {num + den}) - ceil({num} * greatest(n, {s}) / {den}) + 1"
    few = math.ceil(2 / (num / den - num / (num + den)))
    return f"least({need('least')}, {', '.join(need(f'greatest(most - {j}, least)') for j in range(few + 1))})"


def _band(n: Column, num: int, den: int, away: int = 0) -> Column:
    """Class of a size, or of the size ``away`` steps from it; sets that can link are a step apart at most.

    A class is four steps wide, and a step a millionth wider than the ratio of such sizes, so that no
    rounding parts them.
    """
    step = math.log(den / num) * 1.000001 if num < den else 1e-6
    return F.floor((F.log(F.greatest(n, F.lit(1)).cast("double")) / step + away) / 4).cast("int")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: den * intersection >= num * union links."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(texts.mapInArrow(_signatures(k), _SIGNED))
    late = signed.filter("mins is null").groupBy("k1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k1").limit(FREQUENT).collect()
    tokens, counts = np.array([r[0] for r in late], np.int64).view(np.uint64), np.array([r[1] for r in late], np.int64)
    order = np.argsort(tokens)
    signed = signed.filter("mins is not null")
    classes = cut(signed.filter("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("mins").alias("mins"), F.count("*").alias("rows")))

    # 1. groups
    buckets = classes.select("doc_id", "n", F.posexplode("mins").alias("i", "m"))
    leaders = cut(buckets.groupBy("i", "m").agg(F.min("doc_id").alias("l0"), F.min(F.struct(F.xxhash64("doc_id"), "doc_id")).alias("l1"), F.count("*").alias("c")).filter("c > 1"))
    pairs = buckets.join(leaders, ["i", "m"]).select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("round"), F.col("l0").alias("gid")), F.struct(F.lit(1).alias("round"), F.col("l1.doc_id").alias("gid")))).alias("l")).select("doc_id", "l.*").filter("gid <> doc_id")
    best = pairs.groupBy("doc_id", "round", "gid").count().filter(f"count >= {AGREE}").groupBy("doc_id", "round").agg(F.max_by("gid", F.struct("count", -F.col("gid"))).alias("gid"))
    best = cut(best.select("doc_id", "gid").distinct())
    queries = best.select("gid", F.lit(0).cast("long").alias("block"), "doc_id", F.lit(1).cast("long").alias("part"))
    members = best.select("gid", F.lit(0).cast("long").alias("block")).distinct().select("gid", "block", F.col("gid").alias("doc_id"), F.lit(0).cast("long").alias("part"))
    links = cut(_links(texts, k, num, den, members, queries))
    part = components(links).select(F.col("v").alias("doc_id"), F.col("component").alias("part"))
    group = components(best.select(F.col("doc_id").alias("a"), F.col("gid").alias("b"))).select(F.col("v").alias("doc_id"), F.col("component").alias("gid"))

    # 2. the matrix
    groups = classes.select("doc_id", "n").join(group, "doc_id", "left").join(part, "doc_id", "left")
    groups = cut(groups.select("doc_id", "n", F.coalesce("gid", "doc_id").alias("gid"), F.coalesce("part", "doc_id").alias("part")))
    large = cut(groups.groupBy("gid").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks")).filter("blocks > 1"))
    groups = groups.join(small(large, BROADCAST), "gid", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    groups = cut(groups.select("doc_id", "n", "gid", "part", F.expr("pmod(xxhash64(doc_id), blocks)").alias("block")))
    prefixes = texts.mapInArrow(_prefixes(k, num, den, tokens[order], counts[order]), "doc_id long, tokens array<long>")
    rows = prefixes.join(groups, "doc_id").select("doc_id", "n", "gid", "block", "part", F.explode("tokens").alias("token"))
    tokens_of_all = groups.agg(F.sum(F.expr(f"n - ceil({num} * n / {den}) + 1"))).first()[0] or 0
    met = rows.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("count")).filter("low < high")
    common = met.filter(F.col("count") > max(HOT_LEAST, tokens_of_all / HOT)).select("token")  # HOT tokens at most
    rows = spread_join(rows, met.select("token"), ["token"], common, ["doc_id"], "left_semi").withColumn("band", _band(F.col("n"), num, den))
    rows = cut(rows.select("token", "doc_id", "n", "gid", "block", "part", "band"))
    matrix = rows.groupBy("token", F.col("gid").alias("g"), F.col("block").alias("gb")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("part").alias("low"))
    matrix = matrix.withColumn("band", F.explode(F.sequence(_band(F.col("least"), num, den, -1), _band(F.col("most"), num, den, 1))))

    # 3. blocks that a document may open
    opens = (
        rows.join(matrix, ["token", "band"]).filter(f"low < part and {den} * most >= {num} * n and {num} * least <= {den} * n")
        .groupBy("doc_id", "n", "part", "g", "gb").agg(F.count("*").alias("met"), F.min("least").alias("least"), F.max("most").alias("most"))
        .withColumn("least", F.greatest("least", F.expr(f"ceil({num} * n / {den})"))).withColumn("most", F.least("most", F.expr(f"floor({den} * n / {num})")))
        .filter(f"least <= most and met >= {demanded(num, den)}")
        .select(F.col("g").alias("gid"), F.col("gb").alias("block"), "doc_id", "part")
    )
    opens = cut(opens)
    members = groups.join(opens.select("gid", "block").distinct(), ["gid", "block"], "left_semi").select("gid", "block", "doc_id", "part")
    component = components(links.unionByName(_links(texts, k, num, den, members, opens)))

    named = classes.select("k1", "k2", F.col("doc_id").alias("v")).join(component, "v", "left").select("k1", "k2", F.coalesce("component", "v").alias("component"))
    found = spread_join(signed, named, ["k1", "k2"], hot_keys(classes, ["k1", "k2"], "rows"), ["doc_id"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("doc_id"))).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without near copies: of each component the one of the smallest doc_id stays.

    Empty texts and rows without a doc_id stay; of rows that repeat a doc_id all stay or none. Of equal
    texts that of the smallest doc_id stays; a long text counts whole.
    """
    gone = near_duplicates(docs, k, num, den).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
