"""The prefix trie, hard negatives and byte-level BPE against plain versions, on awkward rows."""

from __future__ import annotations

import hashlib
import json
import math
import random
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadastra.llm import bpe
from cadastra.llm.hard_negatives import hard_negatives
from cadastra.llm.prefix_trie import prefix_trie
from cadastra.llm.queries import ORACLES, QUERIES

TURNS = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<float>, label int"
PATH = public_tokenizers.path("byte_bpe_50k.json")
TABLES = Path("/root/testdata/sf0.001")


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


# --- prefix trie


def plain_trie(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0), hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), (r, x)))
    turns = {c: [y[2] for y in sorted(v, key=lambda y: y[:2])] for c, v in own.items()}
    members, ends, below = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = turns.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
        ends[tuple(whole)].append(c)
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
            if d:
                below[tuple(whole[: d - 1])].add(tuple(whole[:d]))
    saved, leaves = {}, {}
    for k in sorted(members, key=len, reverse=True):
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in below[k])
        leaves[k] = sum(leaves[x] for x in below[k]) or 1
    return [
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(below[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items()
    ]


def mixed_turns() -> list[tuple]:
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["u", "a", None]), rng.choice(["", "x", "yé", "zz", None])) for c in range(250) for t in range(rng.randrange(1, 9))]
    odd = [(None, 1, "u", "x"), (7, None, "u", "null turn"), (7, None, "u", "null turn"), (-5, 1, "q", "b"), (1_000_000, 1, "q", "x"), (-100, 2, "q", "b"), (399, 5, "u", "tie"), (399, 5, "a", "tie")]
    return rows + odd + [(500 + i, t, "u", f"t{t}" * 30) for i in range(3) for t in range(40 - i)] + [(c, 0, "u", "same") for c in range(600, 700)]


@pytest.mark.parametrize("range_rows", [20_000, 6, 30])
def test_trie_equals_a_plain_one_whatever_the_ranges(spark: SparkSession, range_rows: int) -> None:
    rows = mixed_turns()
    df = spark.createDataFrame(rows, TURNS).withColumns({"depth": F.lit("clash"), "path": F.lit("clash"), "key": F.lit("clash")}).repartition(5)
    want = sorted(plain_trie(rows), key=lambda r: tuple((x is not None, x) for x in r))
    assert rows_of(prefix_trie(df, range_rows)) == want


def test_trie_of_turnless_and_of_no_conversations(spark: SparkSession) -> None:
    short = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    root = rows_of(prefix_trie(spark.createDataFrame([(short, 0, "u", "gone")], TURNS)))
    assert root == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]
    assert rows_of(prefix_trie(spark.createDataFrame([], TURNS))) == []


def test_trie_joins_pieces_of_many_ids(spark: SparkSession) -> None:
    rows = [(c * 100, 0, "u", "all the same") for c in range(9_000)]
    got = {r.depth: r for r in prefix_trie(spark.createDataFrame(rows, TURNS), 1000).collect()}
    assert got[1].n_convs == 9_000 and got[1].saved_tokens == 8_999 * 12 and got[0].n_children == 1
    assert got[1].ends_sha256 == hashlib.sha256(",".join(str(c * 100) for c in range(9_000)).encode()).hexdigest()


# --- hard negatives


def plain_negatives(rows: list[tuple]) -> list[tuple]:
    kept = {}
    for v, e, label in rows:
        if v is not None and e is not None and label is not None and all(x is not None and math.isfinite(x) for x in e):
            label = (label + 1) % 10 if v % 7 == 0 else label
            kept[v] = (label, [math.floor(256 * float(np.float32(x))) for x in e])
    out = []
    for a in [v for v in kept if v % 100 == 0]:
        score = {v: sum(x * y for x, y in zip(kept[a][1], q, strict=False)) for v, (_, q) in kept.items() if v != a}
        order = sorted(score, key=lambda v: (-score[v], v))
        for p in [v for v in order if kept[v][0] == kept[a][0]][:5]:
            fit = [v for v in order if kept[v][0] != kept[a][0] and 30 * score[p] <= 100 * score[v] <= 90 * score[p]]
            out += [(a, p, i, v, score[p], score[v]) for i, v in enumerate(fit[:10], 1)]
    return sorted(out)


def vectors(seed: int, n: int, spread: float) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 12))
    return [(i, [float(x) for x in centres[i % 6] * rng.choice([0.2, 1, 3]) + rng.normal(size=12) * spread], int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_negatives_equal_a_plain_search(spark: SparkSession, spread: float) -> None:
    rows = vectors(1, 700, spread)
    rows += [(1000, None, 1), (1001, [0.5] * 12, None), (1002, [float("nan")] + [0.1] * 11, 1), (1003, [None] + [0.1] * 11, 1), (1004, [float("inf")] * 12, 2), (None, [0.1] * 12, 2), (1005, [0.0] * 12, 2), (1100, [0.0] * 12, 1), (1006, [0.4] * 5, 1), (1007, [], 1)]
    rows += [(2000 + i, rows[3][1], 1) for i in range(40)]  # ties
    df = spark.createDataFrame(rows + rows[:20], VECTORS).withColumns({"score": F.lit("clash"), "rank": F.lit("clash"), "row": F.lit("clash"), "q": F.lit(1)})
    assert rows_of(hard_negatives(df)) == plain_negatives(rows)


def test_negatives_of_huge_numbers_and_of_nothing(spark: SparkSession) -> None:
    rows = [(0, [3e7, 1e7], 1), (1, [2e7, 2e7], 1), (2, [1e7, 1e7], 2), (3, [1.5e7, -1e7], 2), (100, [1e-3, -1e-3], 3), (101, [-1e-3, 1e-3], 3)]
    assert rows_of(hard_negatives(spark.createDataFrame(rows, VECTORS))) == plain_negatives(rows)
    assert rows_of(hard_negatives(spark.createDataFrame([], VECTORS))) == []
    assert rows_of(hard_negatives(spark.createDataFrame([(5, [1.0], 1)], VECTORS))) == []
    assert rows_of(hard_negatives(spark.createDataFrame([(100, [1.0], 1)], VECTORS))) == []


def test_different_rows_of_one_id_are_rows_of_their_own(spark: SparkSession) -> None:
    rows = [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (2, [0.6, 0.0], 2), (2, [0.6, 0.0], 2)]
    assert rows_of(hard_negatives(spark.createDataFrame(rows, VECTORS))) == [(100, 1, 1, 2, 65536, 153 * 256), (100, 1, 2, 2, 65536, 128 * 256)]


# --- BPE


def awkward_texts() -> list[str | None]:
    rng = random.Random(5)
    parts = ["'s", "'", "''", "'ll", "'re", "it", "I'd've", " ", "  ", "\n", "\t", " ", "　", " ", "1", "²", "½", "12345", "é", "é", "ß", "漢字", "🙂", "՘", "࢏", "\U0002ebf1", "...", "<|endoftext|>", "<|endof", "text|>", "A", "'S", "\x00", "�", "​", "-", "'m", "'t", "'ve"]
    texts: list[str | None] = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(600)]
    return [*texts, None, "", " ", "   ", "\n\n", "a ", "a  ", "'", "'s", " 's", "x's", "x's's", "x''s", "<|endoftext|>", " <|endoftext|> ", "<|endoftext|><|endoftext|>", "word " * 50_000, "x" * 70_000, "é" * 30_001]


def test_bpe_equals_the_library_on_awkward_texts(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    texts = awkward_texts()
    library = Tokenizer.from_file(PATH)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"ids": F.lit(1), "block": F.lit("x"), "bucket": F.lit("x"), "words": F.lit("x")})
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df.repartition(3), PATH), PATH).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids, repr(text)
        assert got[i].text == library.decode(ids, skip_special_tokens=False)


def test_blocks_and_parts_of_any_size_give_the_same(monkeypatch: pytest.MonkeyPatch) -> None:
    import pyarrow as pa

    texts = awkward_texts()[:200]
    library = Tokenizer.from_file(PATH)
    rows = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], names=["doc_id", "text"])
    for block, part in ((1, 1), (50, 20), (400, 100), (1 << 20, 1 << 20)):
        monkeypatch.setattr(bpe, "BLOCK", block)
        monkeypatch.setattr(bpe, "PART", part)
        blocks = list(bpe._blocks(iter([rows.slice(0, 90), rows.slice(90)])))
        assert block > 1 or len(blocks) > 150
        words = pa.Table.from_batches(list(bpe._words(PATH, 3)(iter(blocks)))).sort_by("bucket")
        ids = pa.Table.from_batches(list(bpe._encoded(PATH)(iter(words.to_batches()))))
        found = {}
        for b in blocks:
            own = ids.filter(pa.compute.equal(ids.column("block"), b.column(0)[0]))
            for given in (own, own.slice(0, 0)):  # without the ids, words are encoded in place
                out = bpe._placed(PATH, 3)((), pa.Table.from_batches([b]), given)
                found |= dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
        assert [found[i] for i in range(200)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_repeated_documents_null_ids_and_no_documents(spark: SparkSession) -> None:
    rows = [(1, "same text"), (1, "same text"), (1, "other"), (None, "no id"), (2, None)]
    got = sorted(((r.doc_id, r.text) for r in bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH), PATH).collect()), key=str)
    assert got == sorted([(d, t or "") for d, t in rows], key=str)
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    twice = spark.createDataFrame([(1, "same"), (1, "same")], "doc_id long, text string").repartition(2)
    assert bpe.encode(twice, PATH).count() == 2


def test_ids_without_text_decode_as_the_library_does(spark: SparkSession) -> None:
    rng = random.Random(1)
    rows = [(i, [rng.randrange(0, 50257) for _ in range(rng.randrange(0, 9))]) for i in range(300)] + [(300, [50256, 50257, 99999999, 0]), (301, None), (302, [])]
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: r.text for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).collect()}
    assert got == {i: None if ids is None else library.decode(ids, skip_special_tokens=False) for i, ids in rows}


def test_other_files_are_encoded_by_whole_texts(spark: SparkSession, tmp_path: Path) -> None:
    file = json.loads(Path(PATH).read_text())
    file["pre_tokenizer"]["add_prefix_space"] = True
    changed = tmp_path / "prefix.json"
    changed.write_text(json.dumps(file))
    texts = ["it's here", "", "a b"]
    library = Tokenizer.from_file(str(changed))
    got = {r.doc_id: r.ids for r in bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(changed)).collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


# --- queries


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_hard_negatives"])
def test_query_equals_its_sql(spark: SparkSession, name: str) -> None:
    con = duckdb.connect()
    for table in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TABLES}/{table}.parquet'")
    df = QUERIES[name](spark, str(TABLES))
    found = con.execute(ORACLES[name])
    assert [d[0] for d in found.description] == df.columns
    assert rows_of(df) == sorted(found.fetchall(), key=lambda r: tuple((x is not None, x) for x in r))


def test_bpe_query_equals_the_library(spark: SparkSession) -> None:
    library, digest = Tokenizer.from_file(PATH), lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    got = QUERIES["op13_bpe"](spark, str(TABLES))
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert set(map(tuple, got.collect())) == want
