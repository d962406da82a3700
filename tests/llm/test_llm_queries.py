"""The registered queries and the pipeline on small tables, and plain versions of the methods that SQL can't express."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cadastra.llm import decontamination, language_id, line_dedup, pii, sharding, url_filter
from cadastra.llm.queries import ORACLES, QUERIES

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Clashing names that a table may bring along.
EXTRA = {"n_lines": "x", "n_dropped": "x", "lang_pred": "x", "score": "x", "count": "x", "n": "x", "rank": "x", "part": "x", "tid": "x", "token": "x", "bucket": "x", "_hot": "x", "_place": "x"}
TYPES = {
    "op1_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op3_ngram_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op4_decontamination": {"doc_id": "bigint", "item_id": "bigint"},
    "op5_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op6_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op7_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op8_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op9_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op10_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op11_prefix_trie": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
    "op12_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
    "op13_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
}


def sentences() -> list[tuple]:
    rnd = random.Random(11)
    vocabulary = {"en": "the house stands near water and trees while people walk along quiet streets every morning".split(), "pt": "a casa fica perto da água e das árvores enquanto pessoas caminham pelas ruas toda manhã".split()}
    say = lambda lang, n: " ".join(rnd.choice(vocabulary[lang]) for _ in range(n))
    passage = say("en", 60)
    rows = []
    for i in range(60):
        lang = ("en", "pt")[i % 2]
        rows.append((i, f"{say(lang, 40)}\n{passage if i % 10 == 0 else say(lang, 12)}\nwrite to who{i}@example.com or +1 (555) 555-01{i % 90 + 10}", lang, f"s{i % 3}", 1))
    rows += [(60, rows[1][1], "pt", "s", 1), (60, rows[1][1], "pt", "s", 1), (61, rows[1][1] + " mais", "pt", "s", 1), (62, None, None, None, None), (63, "", "en", "s", 0), (64, "12 ² !", "en", "s", 6)]
    rows += [(None, None, None, None, None), (None, "text without an id in it", "en", "s", 1), (65, "Benchmark words: " + "If Ana walks 60 km in 2 hours and rests for a day, where does Ana sleep at night?", "en", "s", 1), (66, say("en", 400_000), "en", "s", 1)]
    alike = say("en", 40)
    return [*rows, (70, alike, "en", "s", 1), (71, f"along {alike}", "en", "s", 1)]


def save(spark: SparkSession, folder: Path, documents: DataFrame) -> str:
    documents.write.parquet(f"{folder}/documents.parquet")
    pages = [(1, "http://a.net/de/1", '<a href="http://b.org/x">'), (2, None, None), (2, "http://b.org/", ""), (None, "x", "x")]
    empty = documents.limit(1).count() == 0
    spark.createDataFrame([] if empty else pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([] if empty else [(1, "If Bob walks 80 km in 3 hours and rests for a day, where does Bob sleep at night?"), (None, "x"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    talks = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, None, None, None)]
    spark.createDataFrame([] if empty else talks, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    vectors = [(100, [1.0, 1.0], 1), (101, [1.0, 1.0], 1), (102, [0.5, 0.5], 2), (103, None, 2), (104, [None, 1.0], 1), (105, [1.0, 1.0], None)]
    spark.createDataFrame([] if empty else vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folder(spark: SparkSession, tmp_path_factory: pytest.TempPathFactory) -> str:
    documents = spark.createDataFrame(sentences(), DOCUMENTS).repartition(3)
    return save(spark, tmp_path_factory.mktemp("tables"), documents.withColumns({c: F.lit(v) for c, v in EXTRA.items()}))


@pytest.fixture(scope="module")
def nothing(spark: SparkSession, tmp_path_factory: pytest.TempPathFactory) -> str:
    return save(spark, tmp_path_factory.mktemp("empty"), spark.createDataFrame([], DOCUMENTS))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark: SparkSession, folder: str, nothing: str, name: str) -> None:
    found = QUERIES[name](spark, folder)
    assert TYPES[name].items() <= dict(found.dtypes).items()
    assert len({c.lower() for c in found.columns}) == len(found.columns)
    rows = found.collect()
    if name == "op11_prefix_trie":
        assert [(r["conv_id"], r["parent_conv_id"], r["n_convs"]) for r in rows if r["depth"] == 0] == [(1, None, 2)]
    if name == "op12_hard_negatives":
        assert [tuple(r[c] for c in TYPES[name]) for r in rows] == [(100, 101, 1, 102, 131072, 65536)]
    if name in ("op11_prefix_trie", "op12_hard_negatives"):  # no documents
        assert QUERIES[name](spark, nothing).count() == 0
        return
    ids = Counter(r["doc_id"] for r in rows) if name != "op2_url_filter" else Counter(r["page_id"] for r in rows)
    documents = sentences()
    if name == "op2_url_filter":
        assert ids == {1: 1, 2: 2, None: 1}
    elif name == "op4_decontamination":
        assert ids == {65: 1}
    elif name == "op6_packing":
        assert set(ids) == {d[0] for d in documents}
    else:
        assert ids == Counter(d[0] for d in documents)
    by = {r["doc_id"]: r for r in rows} if name != "op2_url_filter" else {}
    if name == "op1_language_id":
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
        assert [by[i]["lang_pred"] for i in (62, 63, 64)] == ["und"] * 3
        assert all(by[i]["lang_pred"] == ("en", "pt")[i % 2] for i in range(60))
    if name == "op3_ngram_jaccard":
        assert (by[60]["component_id"], by[61]["component_id"], by[62]["component_id"], by[62]["n_shingles"], by[71]["component_id"]) == (1, 1, 62, 0, 70)
    if name == "op5_pii":
        assert all(by[i]["n_email"] == 1 and by[i]["n_phone"] == 1 for i in range(60))
        assert all(hashlib.sha256(",".join(s for s in r["spans"].split(",") if not s.startswith("secret")).encode()).hexdigest() == r["base_sha256"] for r in rows)
    if name == "op7_line_dedup":
        assert [by[i]["n_dropped"] for i in (0, 10, 20)] == [0, 2, 2]
        assert (by[62]["n_lines"], by[63]["n_lines"], by[65]["n_dropped"]) == (0, 1, 0)
    if name == "op8_substring_dedup":
        assert by[60]["n_removed"] > 0 and by[0]["n_removed"] == 0 and by[20]["n_removed"] >= 60
    if name == "op9_fingerprints":
        assert by[60]["fingerprint"] == by[1]["fingerprint"]
    if name == "op10_sharding":
        n = Counter(r["shard"] for r in rows)
        assert max(n.values()) - min(n.get(s, 0) for s in range(40)) <= 1 and {r["law"] for r in rows} == {"rows"}
    assert QUERIES[name](spark, nothing).count() == 0


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_against_sql(spark: SparkSession, name: str) -> None:
    data = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    want = db.sql(ORACLES[name])
    got = QUERIES[name](spark, data).select(*want.columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())


def test_pipeline(spark: SparkSession, folder: str, nothing: str) -> None:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, folder)
        assert left.dtypes == docs.dtypes
        left.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    assert not {62, 63, 64} & set(kept["language"]) and set(range(60)) <= set(kept["language"])
    assert kept["lines"] == kept["language"]
    assert set(kept["lines"]) - set(kept["near_copies"]) == {71}
    assert set(kept["near_copies"]) - set(kept["decontamination"]) == {65}
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p["doc_id"] for p in pieces} == set(kept["decontamination"])
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_language_by_a_plain_backoff(spark: SparkSession) -> None:
    learned = [(i, d[1], d[2]) for i, d in enumerate(sentences()[:40])]
    texts = ["the unseen housing by a river", "casarão e ruazinha", "the rua the rua", "zzz qqq", "água", "ALONG the STREETS", "x", ""]
    counts: dict[str, dict[int, Counter]] = {lang: {n: Counter() for n in range(6)} for lang in ("en", "pt")}
    words = lambda t: regex.findall(r"\p{L}[\p{L}\p{M}]*", t.lower())
    for _, text, lang in learned:
        for w in words(text):
            counts[lang][0][w] += 1
            for n in range(1, 6):
                counts[lang][n].update(language_id.grams(w, n))

    def score(n: int, key: str, lang: str) -> float:
        own = counts[lang][n]
        return math.log((own[key] + 0.5) / (sum(own.values()) + 0.5 * (len(counts["en"][n] | counts["pt"][n]) + 1)))

    def plain(text: str) -> str:
        total = Counter({"en": 0.0, "pt": 0.0})
        for w in words(text):
            for n, keys in [(0, [w]), *((n, language_id.grams(w, n)) for n in range(5, 0, -1))]:
                if seen := [k for k in keys if any(counts[x][n][k] for x in counts)]:
                    for lang in counts:
                        total[lang] += sum(score(n, k, lang) for k in seen) / len(seen)
                    break
        return max(("en", "pt"), key=lambda x: total[x]) if words(text) else "und"

    model = language_id.fit(spark.createDataFrame(learned, "doc_id long, text string, lang string"))
    got = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def test_ranks_by_a_plain_walk(spark: SparkSession) -> None:
    edges = [("a.com", "b.org", 1), ("b.org", "a.com", 2), ("b.org", "c.net", 1), ("c.net", "d.org", 1), ("e.org", "a.com", 3), ("e.org", "f.org", 1)]
    hosts = {"a.com": "block", "b.org": None, "c.net": "allow", "d.org": None, "e.org": None, "f.org": None}
    rows = [(h, v, "".join(f'<a href="http://{d}/">' * n for s, d, n in edges if s == h)) for h, v in hosts.items()]
    got = {r["host"]: r for r in url_filter.host_ranks(spark.createDataFrame(rows, "host string, verdict string, html string")).collect()}

    def walk(seed: str, flows: list[tuple[str, str, int]]) -> dict[str, float]:
        rank = left = {h: float(v == seed) for h, v in hosts.items()}
        out = Counter()
        for s, _, n in flows:
            out[s] += n
        for _ in range(200):
            step: Counter = Counter()
            for s, d, n in flows:
                step[d] += 0.85 * left[s] * n / out[s]
            left = {h: step[h] for h in hosts}
            rank = {h: rank[h] + left[h] for h in hosts}
        return {h: r / sum(rank.values()) for h, r in rank.items()}

    for column, want in (("trust", walk("allow", edges)), ("distrust", walk("block", [(d, s, n) for s, d, n in edges]))):
        assert all(abs(got[h][column] - w) < 1e-5 for h, w in want.items())
    assert got["e.org"]["distrust"] > 0 and got["d.org"]["trust"] > 0


def test_templates_by_a_plain_tree(spark: SparkSession) -> None:
    rnd = random.Random(5)
    base = [" ".join(f"w{'abcdefgh'[rnd.randrange(8)]}{'xyz'[rnd.randrange(3)]}" for _ in range(n)) for n in (4, 7, 12, 25, 25, 40)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rnd.randrange(4)):
            words = rnd.choice(base).split()
            for _ in range(rnd.randrange(3)):
                words[rnd.randrange(3, len(words))] = rnd.choice(["odd", "even", f"n{i}", "other"])
            lines.append(" ".join(words))
        rows.append((i, "\n".join(lines)))
    rows += [(200, rows[3][1]), (200, rows[3][1])]
    masked = lambda line: ["<*>" if re.search("[0-9]", w) else w for w in line.split()]
    leaves: dict[tuple, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
    for _, text in rows:
        for line in text.split("\n"):
            if w := masked(line):
                leaves[len(w), *w[:3]][tuple(w)].add(text)
    enough = lambda n, c: 100 if n < 3 else 2 if c >= 20 else 3 if c >= 3 else 10

    def names(w: list[str]) -> list[tuple]:
        leaf = leaves[len(w), *w[:3]]
        out = [("own", tuple(w), sum(x != "<*>" for x in w))]
        if len(leaf) > 1:
            support = Counter()
            for other, texts in leaf.items():
                for j, x in enumerate(other):
                    support[j, x] += len(texts)
            half = sum(map(len, leaf.values())) / 2
            for least in (2 if len(w) >= 20 else 3, half):
                kept = tuple((j, x) for j, x in enumerate(w) if x != "<*>" and support[j, x] >= least)
                if len(kept) >= 0.6 * len(w):
                    out.append((len(w), tuple(w[:3]), kept, len(kept)))
        return out

    places: dict[tuple, dict[str, tuple]] = defaultdict(dict)
    for i, text in rows:
        for pos, line in enumerate(text.split("\n")):
            for name in names(w) if (w := masked(line)) else []:
                key = name, enough(len(w), name[-1])
                places[key][text] = min(places[key].get(text, (i, pos)), (i, pos))
    want = {}
    for i, text in rows:
        gone = set()
        for pos, line in enumerate(text.split("\n")):
            for name in names(w) if (w := masked(line)) else []:
                key = name, enough(len(w), name[-1])
                if len(places[key]) >= key[1] and min(places[key].values()) != (i, pos):
                    gone.add(pos)
        want[i] = "\n".join(x for j, x in enumerate(text.split("\n")) if j not in gone)
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert sum(len(t) for t in want.values()) < 0.8 * sum(len(t) for _, t in rows)


def test_benchmark_by_plain_windows(spark: SparkSession) -> None:
    rnd = random.Random(2)
    vocabulary = "the a train boat walks to Rome Lima Ana Bob with 5 60 km 7 kg at noon and then stops, far from home".split()
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, say(rnd.randrange(3, 30))) for i in range(25)]
    docs = [(i, f"{say(5)} {items[i % 25][1] if i % 3 else say(20)} {say(6)}") for i in range(60)]
    swap = {"60": "61", "5": "8", "Ana": "Eva"}
    docs += [(100 + i, " ".join(swap.get(w, w) for w in text.split())) for i, text in items]
    name, number, unit = decontamination.NAME, decontamination.NUMBER, decontamination.UNIT

    def valued(text: str) -> list[str]:
        text = regex.sub(r"(?<=[\p{Ll},;] )(?=\p{Lu})", name, text)
        text = regex.sub(r"([0-9]+)", number + r"\1", text)
        text = regex.sub(rf"(?i)({number}[0-9]+) ?({decontamination.UNITS})(?!\p{{L}})", rf"\1 {unit}\2", text)
        return regex.sub(rf"[^\p{{L}}\p{{N}}\s{name}{number}{unit}%]+", "", text.lower()).split()

    template = lambda w: [x[0] if x[0] in (name, number, unit) else x for x in w]
    plain = lambda w: [x.lstrip(name + number + unit) for x in w]
    want = set()
    for i, item in items:
        iw = valued(item)
        n = min(len(iw), 8)
        for d, text in docs:
            dw = valued(text)
            places: dict[int, set] = defaultdict(set)
            for form in (template, plain):
                a, b = form(iw), form(dw)
                for x in range(len(a) - n + 1):
                    for y in range(len(b) - n + 1):
                        if a[x : x + n] == b[y : y + n]:
                            places[y - x].add(x)
            hit = set()
            for shift, at in places.items():
                met = {k for x in at for k in range(x, min(x + 8, len(iw)))}
                pairs = {(iw[k], plain([dw[k + shift]])[0] if 0 <= k + shift < len(dw) else None) for k in met if iw[k][0] in (name, number, unit)}
                same = all(plain([p])[0] == v for p, v in pairs)
                if len(pairs) == len({p for p, _ in pairs}) and (same or not all(w[0] in (name, number, unit) for w in iw)):
                    hit |= at
            if len(hit) >= 0.5 * (len(iw) - n + 1):
                want.add((d, i))
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == want
    assert len(want) > 40


@pytest.mark.parametrize("slack", [0.0, 0.3])
def test_shards_by_a_plain_ring(spark: SparkSession, slack: float) -> None:
    docs = spark.createDataFrame([(i % 900, f"text {i % 900}" if i % 7 else None) for i in range(1000)], "doc_id long, text string")
    rows = sharding.shard(docs, 6, slack).collect()
    hashes = {(r["d"], r["s"], r["c"]): r["h"] for r in docs.select(F.col("doc_id").alias("d"), (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long").alias("s"), F.crc32(F.coalesce("text", F.lit(""))).alias("c")).withColumn("h", F.shiftrightunsigned(F.xxhash64("d", "s", "c"), 64 - sharding.CELL_BITS)).collect()}
    cells = Counter(hashes[r["doc_id"], r["size"], r["text_crc32"]] for r in rows)
    nodes, owner = sharding.ring(6)
    room = [math.ceil(1000 * (1 + slack) / 6)] * 6 if slack else [1000 // 6 + (s < 1000 % 6) for s in range(6)]
    want: Counter = Counter()
    over = []
    for cell in sorted(cells):
        at = bisect_left(nodes, cell) % len(nodes)
        taken = min(cells[cell], room[owner[at]])
        room[owner[at]] -= taken
        want[cell, owner[at]] += taken
        over.append((cell, cells[cell] - taken, at))
    for cell, n, at in over:
        while n:
            at = (at + 1) % len(nodes)
            taken = min(n, room[owner[at]])
            room[owner[at]] -= taken
            want[cell, owner[at]] += taken
            n -= taken
    assert Counter((hashes[r["doc_id"], r["size"], r["text_crc32"]], r["shard"]) for r in rows) == +want
    for s in range(6):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_secrets_and_bare_phones_are_learned(spark: SparkSession) -> None:
    rnd = random.Random(4)
    token = lambda n: "0a" + "".join(rnd.choice("0123456789abcdef") for _ in range(n - 2))
    digits = lambda: f"({rnd.randrange(200, 900)}) 555-{rnd.randrange(1000, 9999)}"
    rows = [(i, f"some words then password={token(20)} and more words, call +1 {digits()} or wait") for i in range(200)]
    rows += [(i, f"a version called release_notes_2024_final_draft is out, part 20-10-2000 of it{i}") for i in range(200, 300)]
    rows += [(400, f"nothing named before it: {token(20)} and more"), (401, f"call {digits()} or wait"), (402, "plain words only, nothing more to say here"), (403, None), (404, "")]
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["added"]] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all([k for k, _, _ in found[i]] == ["secret"] for i in range(200))
    assert not any(found[i] for i in range(200, 300))
    assert [k for k, _, _ in found[400]] == ["secret"]
    assert rows[300][1][found[400][0][1] : found[400][0][2]] == rows[300][1].split(": ")[1].split()[0]
    assert [k for k, _, _ in found[401]] == ["phone"]
    assert found[402] == found[403] == found[404] == []


def test_known_languages_are_all_learned(spark: SparkSession) -> None:
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"{letters[i % 26]}{letters[i // 26]}word " * 5, f"l{i}") for i in range(230)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.predict(frame, language_id.fit(frame)).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) == 1
