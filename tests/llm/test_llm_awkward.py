"""Rows that once gave wrong or endless results: odd separators, repeated ids with unlike texts, texts of numbers."""

from __future__ import annotations

import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

from cadastra.llm import pii
from cadastra.llm.decontamination import contaminated
from cadastra.llm.substring_dedup import WINDOW, remove_repeats

DOCS = "doc_id long, text string"
#: The formats of the contract, as plain patterns.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(number))) % 10 == 0


def plain_spans(text: str) -> list[tuple]:
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            number = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(number) <= 19 and luhn(number), "phone": 8 <= len(number) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_with_separators_of_any_kind(spark: SparkSession) -> None:
    rng = random.Random(11)
    pieces = ["+", "1", "23", "456", "7890", " ", "    ", "(", ")", ".", "-", "--", "a", "@", "x.y", "é", "4111 1111 1111 1111", "+1    2    3    4    5    6    7    8", "+1((((5)))) 555....5555", "10.0.0.1", "999.1.1.1", "a@b.co", "\n", "[.]"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 16))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    none = {k: ([], float("inf")) for k in pii.ADDED}
    got = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.base] for r in pii.spans_by(df, none).collect()}
    assert {i: plain_spans(t) for i, t in enumerate(texts)} == got


def test_generators_are_not_hidden_by_their_gates() -> None:
    for kind, text in (("ip", "10[.]0[.]0[.]1"), ("ip", "fe80:0:0:0:1:2:3:4"), ("email", "ann (at) mail (dot) org"), ("phone", "(212) 555 1234"), ("phone", "0049 30 901820"), ("card", "3782 822463 10005")):
        assert re.search(pii.NEEDS[kind].replace("(?i)", ""), text, re.I), (kind, text)


def test_bare_forms_are_found_once_learned_from_masked_ones(spark: SparkSession) -> None:
    rng = random.Random(2)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    some = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(3, 12)))
    number = lambda: f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    rows = []
    for i in range(1200):
        kind = i % 4
        personal = (f"call +1 {number()}", f"mail {rng.choice(words)}{i}@{rng.choice(words)}.org", f"host 10.{rng.randrange(256)}.0.{rng.randrange(256)}", some())[kind]
        rows.append((i, f"{some()} {personal} {some()}."))
    planted = {5000: f"beta call {number()} gamma", 5001: "alpha mail zeta7(at)delta(dot)org beta", 5002: "gamma host 10[.]4[.]0[.]77 delta"}
    clean = {6000 + i: some() + "." for i in range(100)} | {6200: "in 1999 12 of 345 came", 6201: "at 10 of 12.5 and 3.5 (at) best"}
    df = spark.createDataFrame(rows + list(planted.items()) + list(clean.items()), DOCS)
    got = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.added] for r in pii.find_pii(df).collect()}
    for i, kind in ((5000, "phone"), (5001, "email"), (5002, "ip")):
        assert [s[0] for s in got[i]] == [kind], planted[i]
    assert not any(got[i] for i in clean)


def plain_kept(rows: list[tuple]) -> dict[tuple, tuple]:
    """Texts of one doc_id go in any order, so the rows are tried in both."""
    seen, out = {}, {}
    for doc, text in sorted(set(rows), key=str):
        words = (text or "").split()
        for i in range(len(words) - WINDOW + 1):
            seen.setdefault(tuple(words[i : i + WINDOW]), (doc, text, i))
    for doc, text in set(rows):
        words, gone = (text or "").split(), set()
        for i in range(len(words) - WINDOW + 1):
            if seen[tuple(words[i : i + WINDOW])] != (doc, text, i):
                gone |= set(range(i, i + WINDOW))
        out[doc, text] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


def test_unlike_texts_under_one_id_are_documents_of_their_own(spark: SparkSession) -> None:
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared, own, other = (" ".join(word() for _ in range(n)) for n in (40, 62, 30))
    rows = [(1, own), (1, "short text only"), (1, None), (2, shared), (2, f"{other} {shared}"), (2, shared), (3, f"{shared} tail"), (3, "tail"), (4, other), (4, own)]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeats(spark.createDataFrame(rows, DOCS).repartition(3)).collect()]
    assert len(got) == len(rows)
    want = plain_kept(rows)
    # of id 2 either text may be the first: what is removed there is 40 words in all, and everything else is fixed
    fixed = lambda found: sorted(x for x in found if x[0] != 2)
    assert fixed(got) == fixed([(d, *want[d, t]) for d, t in rows])
    twos = sorted((n, gone) for d, n, gone, _ in got if d == 2)
    assert twos in ([(40, 0), (40, 0), (70, 40)], [(40, 40), (40, 40), (70, 0)])


def test_long_texts_of_numbers_end_soon(spark: SparkSession) -> None:
    numbers, ones = " ".join(str(i % 997) for i in range(100_000)), "1 " * 100_000
    items = [(1, "3 5 7 9 11 13 15 17 19 21 23 25"), (2, "1 1 1 1 1 1 1 1 1 1 1 1"), (3, "the sum of 12 and 30 is 42 when both are added by hand"), (4, "5 6 7 8 9 10 11 12 13 14 15 16")]
    rows = [(1, numbers), (2, ones), (3, "so the sum of 77 and 30 is 107 when both are added by hand they say"), (4, "9 8 7 6 5 4 3 2 1 0")]
    began = time.time()
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 4), (2, 2), (3, 3)}
    assert time.time() - began < 90


@pytest.mark.parametrize("hidden", ["regex", "public_tokenizers", "numpy"])
def test_the_entry_holds_without_what_the_optional_part_needs(hidden: str) -> None:
    import subprocess
    import sys

    root = str(Path(__file__).resolve().parents[2])
    code = f"import sys; sys.modules[{hidden!r}] = None; import __spark_entry__ as e; print(len([q for q in e.queries() if not q.startswith('op')]))"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=False)
    if hidden == "numpy":  # the library itself needs it
        assert done.returncode
    else:
        assert done.returncode == 0 and int(done.stdout.split()[-1]) > 150, done.stderr[-500:]
