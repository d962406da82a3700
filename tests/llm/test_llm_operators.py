"""Every training-data operator against a plain version on small tables with nulls, ties and odd texts."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadastra.llm import common, decontamination, fingerprints, language_id, line_dedup, ngram_jaccard, packing, pii, sharding, substring_dedup, url_filter
from cadastra.session import cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that a careless join or schema would clash with.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, gid long, token string"


def texts() -> dict[int, str | None]:
    rnd = random.Random(3)
    words = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "tú") for b in ("", "ra", "son", "tin", "x9")]
    of = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base, passage = of(120), of(55)
    out: dict[int, str | None] = {0: None, 1: "", 2: " \n\t", 3: "one", 4: "two words", 5: base, 6: base, 7: base.upper(), 8: of(3000), 9: "日本 語\x0bé ß"}
    for i in range(10, 22):
        w = base.split()
        for _ in range(i % 5):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        out[i] = " ".join(w)
    for i in range(22, 30):
        out[i] = f"{of(i)}\n{passage}\n{of(9)}"
    out[30] = passage + " " + passage
    return out


TEXTS = texts()


@pytest.fixture(scope="module")
def docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, 3, "x") for i, t in TEXTS.items()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None, lower: bool = False) -> list[str]:
    text = (text or "").translate({i: i + 32 for i in range(65, 91)}) if lower else text or ""
    return WORD.findall(text)


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80), (2, 50)])
def test_components_by_all_pairs(docs: DataFrame, k: int, num: int) -> None:
    sets = {}
    for i, t in TEXTS.items():
        w = words(t, True)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    top = {i: i for i in sets}

    def root(i: int) -> int:
        while top[i] != i:
            i = top[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= num * len(a | b):
                x, y = sorted((root(i), root(j)))
                top[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.near_duplicates(docs, k, num).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_of_a_hub_a_path_and_loops(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, few: int) -> None:
    """``few``: labels that may be broadcast; with none, those of many members are dealt out."""
    monkeypatch.setattr(common, "LABELS", few)
    hub = [(5_000, i) for i in range(1_000, 1_300)]
    path = [(i, i + 1) for i in range(60, 20, -1)]
    links = [*hub, *path, *path[:5], (7, 7), (900, 1_299), (2_000, 2_001)]
    got = {r["v"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 900 for i in (900, 5_000, *range(1_000, 1_300))} | {i: 21 for i in range(21, 62)} | {2_000: 2_000, 2_001: 2_000}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("num", "sizes"), [(85, (18, 17, 20)), (80, None)])
def test_demanded_tokens_never_exceed_need(spark: SparkSession, num: int, sizes: tuple | None) -> None:
    ranges = [sizes] if sizes else [(n, a, b) for n in range(1, 41) for a in range(-(-num * n // 100), n + 1) for b in range(a, 100 * n // num + 1)]
    need = lambda n, s: -(-num * (n + s) // (num + 100)) + (-num * max(n, s) // 100) + 1
    got = spark.createDataFrame(ranges, "n long, least long, most long").selectExpr("n", "least", "most", f"{ngram_jaccard.demanded(num, 100)} AS demanded").collect()
    assert all(r["demanded"] <= min(need(r["n"], s) for s in range(r["least"], r["most"] + 1)) for r in got)
    assert sizes is None or min(need(18, s) for s in (17, 20)) == 2 and need(18, 19) == 1


def test_one_of_each_keeps_columns_and_empties(docs: DataFrame, empty: DataFrame) -> None:
    left = ngram_jaccard.one_of_each(docs)
    assert left.columns == docs.columns
    ids = {r["doc_id"] for r in left.select("doc_id").collect()}
    assert {0, 1, 2, 3, 4, 5, 8, 9} <= ids
    assert not {6, 10} & ids
    assert ngram_jaccard.one_of_each(empty).count() == 0


def test_null_and_repeated_ids(spark: SparkSession) -> None:
    rows = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "q r s t u v")], "doc_id long, text string")
    found = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in ngram_jaccard.near_duplicates(rows).collect())
    assert found == [(-1, -1), (1, 1), (1, 1), (2, 2)]


def test_repeats_by_all_windows(docs: DataFrame, empty: DataFrame) -> None:
    seen: set[tuple] = set()
    want = {}
    for i in sorted(TEXTS):
        w = words(TEXTS[i])
        gone = set()
        for j in range(len(w) - 19):
            key = tuple(w[j : j + 20])
            if key in seen:
                gone.update(range(j, j + 20))
            seen.add(key)
        want[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == want
    assert sum(n for _, n, _ in want.values()) > 500
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_hot_buckets_give_the_same(docs: DataFrame, monkeypatch: pytest.MonkeyPatch) -> None:
    want = sorted(map(tuple, substring_dedup.remove_repeats(docs).collect()))
    monkeypatch.setattr(substring_dedup, "STRINGS", 2)
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs).collect())) == want


@pytest.mark.parametrize(("ids", "labels"), [(10**6, 10**6), (0, 10**6), (0, 0)])
def test_components_over_few_and_many_ids(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, ids: int, labels: int) -> None:
    monkeypatch.setattr(common, "IDS", ids, raising=False)
    monkeypatch.setattr(common, "LABELS", labels)
    monkeypatch.setattr(common, "HOT_LEAST", 20)
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(500, 600 + i) for i in range(60)] + [(700 + i, 701 + i) for i in range(40)] + [(9, 9), (None, 3), (3, None)]
    want = {x: x for a, b in links if a is not None and b is not None and a != b for x in (a, b)}
    for _ in want:
        for a, b in links:
            if a in want and b in want:
                want[a] = want[b] = min(want[a], want[b])
    got = [tuple(r) for r in common.components(spark.createDataFrame(links, "a long, b long")).select("v", "component").collect()]
    assert sorted(got) == sorted(want.items())


def test_components_of_few_ids_take_few_tasks(spark: SparkSession) -> None:
    # the driver keeps a record of every task: with many partitions a round of small tables filled its memory
    links = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long").coalesce(1)
    sc, conf, group = spark.sparkContext, {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}, "components"
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup(group, group)
        assert {r["component"] for r in common.components(links).collect()} == {0}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    tasks = sum(x.numCompletedTasks for s in stages if (x := sc.statusTracker().getStageInfo(s)))
    assert 0 < tasks < 500


def test_cut_leaves_no_shuffle_on_disk(spark: SparkSession) -> None:
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"shuffle_\d+_\d+", disk.getAllBlocks().mkString(" ")))
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()  # held on to, as callers do
    before, was = shuffles(), spark.conf.get(key, None)
    kept = cut(counts)
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert spark.conf.get(key, None) == was
    assert sorted(kept.collect()) == sorted(counts.collect()) and kept.count() == 7


def test_repeated_windows_travel_as_runs(docs: DataFrame) -> None:
    text = [f"w{i}" for i in range(30)]
    other = [*text[:24], "x", *text[25:], *text[:21]]  # its windows 0 to 4 and 30 to 31 were met before
    rows = [(7, 0, 1, 0, " ".join(text)), (7, 0, 2, 3, " ".join(other)), (7, 1, 3, 0, " ".join(text))]
    columns = [pa.array(c, t) for c, t in zip(zip(*[(*r[:4], r[4].encode()) for r in rows], strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, names=["minimiser", "part", "doc_id", "start", "words"])
    found = [tuple(r.values()) for out in substring_dedup._repeats(iter([batch])) for r in out.to_pylist()]
    assert found == [(2, 3, 5), (2, 33, 2)]
    # the texts are dealt out for the strings and for the result in plans of their own
    plan = substring_dedup.remove_repeats(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "_kept" in plan and "_packed" not in plan


def test_small_cuts_ask_for_few_collections(spark: SparkSession) -> None:
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = next(b for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    cut(spark.range(1))
    before, began = full.getCollectionCount(), time.monotonic()
    for _ in range(5):
        cut(spark.range(10))
    assert full.getCollectionCount() - before <= 1 + (time.monotonic() - began) // 10


def test_packing_round_trip(docs: DataFrame, empty: DataFrame) -> None:
    path = public_tokenizers.path("word_bpe_49k.json")
    odd = docs.sparkSession.createDataFrame([(100, "É'll <|endoftext|>x ٣ Σς İ a\x1cb!!　漢 é"), (101, "x" * 5000 + " y" * 9000)], "doc_id long, text string")
    tokenizer = Tokenizer.from_file(path)
    all_docs = docs.select("doc_id", "text").union(odd)
    want = {r["doc_id"]: np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4") for r in all_docs.collect()}
    pieces = packing.pack(all_docs, path).collect()
    at: dict[int, int] = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        ids = want[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at[p["doc_id"]], len(want[p["doc_id"]]), zlib.crc32(ids.tobytes()))
        at[p["doc_id"]] += p["length"]
    assert dict(at) == {i: len(x) for i, x in want.items()}
    filled: dict[int, int] = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == filled[p["sequence_id"]]
        filled[p["sequence_id"]] += p["length"]
    assert all(n <= 4096 and n & (n - 1) == 0 for n in filled.values())
    assert packing.pack(empty, path).count() == 0


def test_packer_takes_the_level_of_least_squares() -> None:
    packer = packing.Packer(0, 8)
    for n in (5, 5, 3):
        packer.add(n, b"\0\0\0\0" * n)
    assert [r[0] for r in packer.rows] == [5, 3]
    assert packer.counts.tolist() == [0, 0, 0, 0, 0, 1, 0, 0, 0]


def test_fingerprints_estimate_weighted_jaccard(docs: DataFrame, empty: DataFrame) -> None:
    rows = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}
    order = sorted(TEXTS, reverse=True)

    def bag(text: str) -> Counter:
        w = words(text, True)
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    errors = []
    for i, key in enumerate(order):
        text, after = TEXTS[key] or "", TEXTS[order[(i + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (rows[key]["n_chars"], rows[key]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = bag(text), bag(edited)
        errors.append(rows[key]["near_edited"] - (sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0))
    assert abs(np.mean(errors)) < 0.06
    assert np.std(errors) < 0.12
    assert rows[5]["fingerprint"] == rows[6]["fingerprint"]
    like = docs.sparkSession.createDataFrame([(rows[5]["fingerprint"], rows[5]["edited_fingerprint"])], "a string, b string").select(fingerprints.likeness("a", "b")).first()[0]
    assert like == rows[5]["near_edited"]
    assert fingerprints.edited_fingerprints(empty).count() == 0


def likeness_of(a: dict[int, int], b: dict[int, int]) -> float:
    terms, weights = (np.array([x for s in (a, b) for x in f(s)], t) for f, t in ((dict.keys, np.uint64), (dict.values, np.int64)))
    x, y = fingerprints._samples(terms, weights, np.array([len(a), len(b)]))
    return float((x == y).mean())


@pytest.mark.parametrize(("n", "most"), [(40, 1), (40, 5), (20_000, 5)])
def test_samples_agree_as_often_as_weighted_jaccard(n: int, most: int) -> None:
    rng = np.random.default_rng(n + most)
    got, want = [], []
    for _ in range(24):
        terms = rng.integers(0, 2**63, 2 * n).tolist()
        a, b = ({t: int(w) for t, w in zip(part, rng.integers(1, most + 1, len(part)), strict=True)} for part in (terms[: n + n // 2], terms[n // 2 :]))
        got.append(likeness_of(a, b))
        want.append(sum(min(a.get(t, 0), b.get(t, 0)) for t in terms) / sum(max(a.get(t, 0), b.get(t, 0)) for t in terms))
    assert abs(np.mean(got) - np.mean(want)) < 0.045


def test_long_unrelated_texts_are_unlike() -> None:
    rng = np.random.default_rng(8)
    a, b = (dict.fromkeys(rng.integers(0, 2**63, 300_000).tolist(), 1) for _ in range(2))
    assert likeness_of(a, b) == 0
    assert likeness_of(a, a) == 1


@pytest.mark.parametrize("step", [1, 2**60 // 40])
def test_next_document_by_ranges(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, step: int) -> None:
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 5)
    base = 0 if step == 1 else 2**60
    rows = [(base + i * (1 if step == 1 else 3), f"text number {i} " * (i % 7 + 1)) for i in range(40)] + [(base + 7, "second of its id"), (None, None), (None, "no id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashes = {r["text"]: r["h"] for r in frame.select("text", F.xxhash64("text", F.col("doc_id").isNull()).alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = Counter()
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        want[i, len(text), hashlib.sha256((text[: len(text) - len(text) // 2] + after[: len(text) // 2]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprints.edited_fingerprints(frame).collect()) == want


def test_language_with_held_out_texts(spark: SparkSession) -> None:
    rnd = random.Random(1)
    vocabulary = {"aa": ["kor", "tala", "vim", "senka"], "bb": ["ørn", "skov", "blå", "hygge"]}
    rows = [(i, " ".join(rnd.choice(vocabulary[lang]) for _ in range(20)), lang) for i, lang in enumerate(["aa", "bb"] * 20)]
    frame = spark.createDataFrame([*rows, (90, None, "aa"), (91, "12 !", None), (92, "korvim talasen", None), (93, "skovhygge", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("kept"))
    model = language_id.fit(frame.filter("doc_id < 30"))
    got = {r["doc_id"]: (r["l"], r["s"]) for r in language_id.predict(frame, model, ("l", "s")).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows)
    assert (got[90], got[91], got[92][0], got[93][0]) == (("und", 0.0), ("und", 0.0), "aa", "bb")
    kept = language_id.confident(frame)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(40)) | {92, 93}
    assert language_id.confident(frame.withColumn("lang", F.lit(None).cast("string"))).count() == 42
    assert language_id.confident(frame.limit(0)).count() == 0


def test_recurring_templates_go_and_the_first_line_stays(spark: SparkSession) -> None:
    rows = [(i, f"own text number{i} only here {'abcdefghij'[i % 10] * 3}\nLog entry {i} from host{i} done\nshort {i}", "x") for i in range(12)] + [(50, None, "x"), (51, "", "x"), (52, "Log entry of another kind entirely here", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, pos string")
    got = {r["doc_id"]: r for r in line_dedup.drop_recurring_lines(frame).collect()}
    assert got[0]["text"] == rows[0][1]
    assert all("Log entry" not in got[i]["text"] and f"short {i}" in got[i]["text"] for i in range(1, 12))
    assert (got[50]["text"], got[50]["n_lines"], got[51]["text"], got[52]["n_dropped"]) == (None, 0, "", 0)
    assert line_dedup.drop_recurring_lines(frame.limit(0)).count() == 0


def test_copies_alone_do_not_recur(spark: SparkSession) -> None:
    frame = spark.createDataFrame([(i, "the very same line of text") for i in range(30)], "doc_id long, text string")
    assert line_dedup.drop_recurring_lines(frame).agg(F.sum("n_dropped")).first()[0] == 0


def test_few_texts_make_a_line_recur(spark: SparkSession) -> None:
    long, eight, short = (" ".join(f"{w}{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(n)) for w, n in (("word", 50), ("other", 50), ("brief", 6)))
    own = lambda i: f"text {'abcdefghij'[i % 10]}{'abcdefghijklmn'[i // 10]} alone"
    rows = [(i, "\n".join([own(i), *[long] * (i < 2), *[eight] * (i < 8), *[short] * (i < 3), *["two texts hold this"] * (i < 2), "", "Read more", *["See also"] * (i < 99)])) for i in range(120)]
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [sum(line in got[i] for i in got) for line in (long, eight, short, "two texts hold this", "", "Read more", "See also")] == [1, 1, 1, 2, 120, 1, 99]
    assert got[0][1:] == rows[0][1].split("\n")[1:]


def test_reparameterised_items_are_found(spark: SparkSession) -> None:
    items = spark.createDataFrame([(1, "If the train of Ana goes 60 km in 2 hours and Ana waits 60 minutes, how far is it from Ana to Lima?"), (2, None), (3, "short one")], "item_id long, text string")
    rows = [
        (1, "Noise first. If the train of Bob goes 80 km in 3 hours and Bob waits 80 minutes, how far is it from Bob to Rome? And more."),
        (2, "If the train of Bob goes 80 km in 3 hours and Eve waits 10 minutes, how far is it from Dan to Rome?"),
        (3, "nothing of the kind, only words about trains that go far from here to there"), (4, None), (5, ""), (6, "Short one!"), (None, "short one"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("mine"))
    got = {(r["doc_id"], r["item_id"]): r["same_values"] for r in decontamination.contaminated(frame, items).collect()}
    assert got == {(1, 1): False, (6, 3): True}
    left = decontamination.without_benchmark(frame, items)
    assert left.columns == frame.columns
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 2, 3, 4, 5]
    assert decontamination.contaminated(frame.limit(0), items).count() == 0
    assert decontamination.contaminated(frame, items.limit(0)).count() == 0


def test_short_items_and_other_case_are_found(spark: SparkSession) -> None:
    long = "the keeper Ana counts every boat in the harbour at noon, then Ana writes a note and leaves"
    items = spark.createDataFrame([(1, "What is the capital of Peru today?"), (2, long), (3, "42")], "item_id long, text string")
    noise = "words that come before it and are not of any item here"
    rows = [
        (1, f"{noise}. What is the capital of Peru today? {noise}"), (2, f"{noise} {long.lower()} {noise}"), (3, f"{noise} {long.replace(' Ana', chr(10) + 'Ana')} {noise}"),
        (4, f"{noise} {long.replace(' ', chr(0xA0))} {noise}"), (5, f"{noise} 41 {noise}"), (6, f"{noise} what is the capital"),
    ]
    got = {(r["doc_id"], r["item_id"]): (r["share"], r["same_values"]) for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1): (1.0, True), (2, 2): (1.0, True), (3, 2): (1.0, True), (4, 2): (1.0, True)}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def right(kind: str, m: str) -> bool:
    d = re.sub("[^0-9]", "", m)
    n = [int(c) for c in d][::-1]
    luhn = (sum(n[0::2]) + sum(sum(divmod(2 * v, 10)) for v in n[1::2])) % 10 == 0
    return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]


def test_base_spans_against_plain_patterns(spark: SparkSession) -> None:
    rnd = random.Random(7)
    parts = ["a@b.co", "x.y_z@q-r.s.t", "a@b.c_d@e.f", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+55 (61) 99999-1234", "+1", "++12 3456789", " ", "é漢", "𝒳", "\n", "12 34", "-", "."]
    rows = [(i, "".join(rnd.choice(parts) + rnd.choice(["", " ", ", "]) for _ in range(rnd.randrange(12)))) for i in range(150)] + [(900, None), (901, ""), (902, "9" * 30_000 + "a" * 30_000 + "." * 999 + "1." * 20_000)]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        want = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "", re.ASCII) if right(k, m.group())]
        assert [tuple(s) for s in got[i]["base"]] == want
        for a in got[i]["added"]:
            assert not any(a["kind"] == k and a["start"] < e and s < a["end"] for k, s, e in want)


def test_boosting_separates_and_calibrates() -> None:
    counts = {c: (0, 50) if c & 1 and not c & 4 else (50, 1) for c in range(16)}
    trees = pii.boost(counts)
    least = pii.threshold(trees, counts)
    chosen = {c for c in counts if sum(pii._value(t, c) for t in trees) >= least}
    assert chosen == {c for c in counts if c & 1 and not c & 4}
    assert pii.threshold(trees, {}) == float("inf")


def test_rare_spans_among_many_rows_are_learned(spark: SparkSession) -> None:
    rare = F.concat(F.lit("write to user"), F.col("id").cast("string"), F.lit("@example.org today"))
    docs = spark.range(120_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5_000 == 0, rare).otherwise("nothing here").alias("text"))
    assert pii.fit(docs)["email"][1] < float("inf")


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_shards(docs: DataFrame, empty: DataFrame, slack: float) -> None:
    rows = sharding.shard(docs.union(docs), 7, slack).collect()
    n = Counter(r["shard"] for r in rows)
    assert sum(n.values()) == 2 * len(TEXTS)
    assert max(n.values()) <= -(-2 * len(TEXTS) * (1 + slack) // 7)
    if not slack:
        assert max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n[s]))
    for r in rows:
        text = (TEXTS[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 16, zlib.crc32(text))
    assert sharding.shard(empty, 7, slack).count() == 0


def test_full_shards_overflow_clockwise() -> None:
    cells, owner = sharding.ring(3)
    found = sharding.segments({cells[0]: 9}, 3, 0.0)
    assert found[0][3] == owner[0]
    assert [end - first for _, first, end, _, _ in found] == [3, 3, 3]
    assert len({s for *_, s, _ in found}) == 3


def test_url_rules_and_link_graph(spark: SparkSession) -> None:
    link = lambda h: f'<a href="http://{h}/x">'
    rows = [
        (1, "http://Good.net/de/1", link("friend.org")), (2, "http://friend.org/about", link("good.net")), (3, "http://bad.com/en/1", None), (4, "http://farm.org/list?x#y", link("bad.com") * 5), (5, "http://x.example.com/en/71", ""),
        (6, "http://example.com/en/8", ""), (7, None, "x"), (8, "no scheme", ""), (9, "http://example.net/de/8#z", ""), (10, "http://notexample.com/en/7", ""),
    ]
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: (r["rule"], r["verdict"]) for i, r in got.items()} == {
        1: ("net/de/", "allow"), 2: (None, "allow"), 3: ("com/en/", "block"), 4: (None, "block"), 5: ("example.com/en/7", "allow"), 6: ("com/en/", "block"), 7: (None, "allow"), 8: (None, "allow"), 9: ("example.net/de/8", "block"), 10: ("com/en/", "block"),
    }
    assert (got[1]["host"], got[4]["path"], got[7]["host"], got[8]["path"]) == ("good.net", "/list", "", "")
    assert got[2]["trust"] > 0
    assert got[4]["distrust"] > 0
