"""Language ID by word-first backoff.

A word is a letter and the letters and marks that follow it. A word seen in training scores its log
frequency in each language. An unseen word falls back to its character n-grams (with a blank at each
end): to the mean log frequency of those of length 5 that were seen, else of length 4, and so on to 1;
a word of unseen characters says nothing. A text's language is the one of the largest sum over all its
words, and its score that language's share after a softmax of the mean a word times the number of
words, ``WORDS_FOR`` at most (a calibration, as words of a text aren't independent; the language itself
rests on every word).

The model is learned from at most about ``EXAMPLES`` labelled texts of each language, taken by a 64-bit
hash of the text, so that ids change nothing and equal texts are all examples or none; this bound is its
parameter. A word or n-gram is known if it makes up 1 / ``RARE`` of the words, or of the n-grams of its
length, of some language's examples; no rank cuts keys off, and as shares add up to one, a language has at
most ``RARE`` keys a length. Every language with a labelled text is learned.

Rows: a null text, or one without a letter, is ``und`` with score 0; so is any text if nothing was
learned. Ties go to the first language by name. Repeated rows get a row each, rows without a doc_id
too; extra columns stay in ``predict``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadastra.llm.textkit import give_back
from cadastra.session import ship

EXAMPLES = 4_000
RARE, LONGEST = 200_000, 5
WORDS_FOR = 20
#: Numbers in a worker's table of remembered words and in that of all keys; words counted before they are handed on; rows written at once.
REMEMBERED, CELLS, COUNTED, ROWS = 1_000_000, 8_000_000, 60_000, 1_000
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+")


@dataclass(frozen=True)
class Model:
    """Log frequencies. Key ``i`` of ``words`` or ``grams`` scores ``value[a:b]`` in the languages
    ``where[a:b]``, a and b being ``start[i]`` and ``start[i + 1]``, and ``unseen[n]`` in the others, n
    being 0 for a word, else the length of the n-gram."""

    languages: tuple[str, ...]
    words: dict[str, int]
    grams: dict[str, int]
    start: np.ndarray
    where: np.ndarray
    value: np.ndarray
    unseen: np.ndarray

    def scores(self, row: int, n: int) -> np.ndarray:
        """Scores of a key in all languages."""
        out = self.unseen[n].copy()
        a, b = self.start[row], self.start[row + 1]
        out[self.where[a:b]] = self.value[a:b]
        return out

    def table(self) -> np.ndarray | None:
        """The scores of all keys, where these are at most ``CELLS`` numbers."""
        rows = len(self.start) - 1
        if rows * len(self.languages) > CELLS:
            return None
        level = np.zeros(rows, np.int64)
        level[list(self.grams.values())] = list(map(len, self.grams))
        out = self.unseen[level]
        out[np.repeat(np.arange(rows), np.diff(self.start)), self.where] = self.value
        return out


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str, Counter] = {}

    def counts() -> Iterator[pa.RecordBatch]:
        for lang, own in words.items():
            rows: Counter = Counter()
            for word, c in own.items():
                rows[0, word] += c
                for n in range(1, LONGEST + 1):
                    for g in grams(word, n):
                        rows[n, g] += c
            if rows:
                n, key = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows)), pa.array(n, pa.int32()), pa.array(key), pa.array(list(rows.values()), pa.int64())], names=["lang", "n", "key", "count"])
        words.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words.setdefault(lang, Counter()).update(words_of(text.as_py()))
            if sum(map(len, words.values())) > COUNTED:
                yield from counts()
    yield from counts()
    words.clear()
    give_back()


def fit(labelled: DataFrame) -> Model:
    """Learn from ``text, lang`` of rows whose lang isn't null."""
    spark = ship(labelled.sparkSession)
    labelled = labelled.filter("lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return Model((), {}, {}, np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros((LONGEST + 1, 0), np.float32))
    # a row is an example if its hash, a number from -2^63 on, is below its language's bound
    bounds = spark.createDataFrame([(lang, min(2**63 - 1, int(min(1.0, EXAMPLES / n) * 2**64) - 2**63)) for lang, n in sizes.items()], "lang string, bound long")
    some = labelled.join(F.broadcast(bounds), "lang").filter(F.xxhash64("text") <= F.col("bound"))
    counts = some.select("lang", "text").mapInArrow(_counted, "lang string, n int, key string, count long").groupBy("n", "lang", "key").agg(F.sum("count").alias("count")).persist()
    totals = {(r["n"], r["lang"]): r["s"] for r in counts.groupBy("n", "lang").agg(F.sum("count").alias("s")).collect()}  # LONGEST + 1 rows a language
    least = spark.createDataFrame([(n, lang, -(-total // RARE)) for (n, lang), total in totals.items()], "n int, lang string, least long")
    known = counts.join(F.broadcast(least), ["n", "lang"]).filter("count >= least").select("n", "key").distinct()
    languages = tuple(sorted(sizes))
    place = {lang: i for i, lang in enumerate(languages)}
    # at most (LONGEST + 1) * RARE keys a language
    kept = counts.join(known, ["n", "key"]).select("n", "key", "lang", "count").toArrow()
    counts.unpersist()
    n, key, lang = (kept.column(i).to_pylist() for i in range(3))
    order = sorted(range(len(key)), key=lambda i: (n[i], key[i], lang[i]))
    rows: dict[tuple[int, str], int] = {}
    for i in order:
        rows.setdefault((n[i], key[i]), len(rows))
    of = np.array([rows[n[i], key[i]] for i in order], np.int64)
    total = np.array([[totals.get((m, x), 0) for x in languages] for m in range(LONGEST + 1)], float)
    keys = Counter(m for m, _ in rows)
    size = total + 0.5 * np.array([[keys[m] + 1] for m in range(LONGEST + 1)])
    where, level = np.array([place[lang[i]] for i in order], np.int32), np.array([n[i] for i in order], np.int64)
    count = kept.column(3).to_numpy()[order] if order else np.zeros(0)
    value = np.log((count + 0.5) / size[level, where]).astype(np.float32)
    return Model(languages, {k: i for (m, k), i in rows.items() if m == 0}, {k: i for (m, k), i in rows.items() if m}, np.searchsorted(of, np.arange(len(rows) + 1)), where, value, np.log(0.5 / size).astype(np.float32))


class Scores(dict):
    """Row in ``table`` of each word's scores, worked out when first asked for."""

    def __init__(self, model: Model) -> None:
        self.model, self.all = model, model.table()
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.table = np.zeros((4096, len(self.model.languages)), np.float32)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        model = self.model
        if (i := model.words.get(word)) is not None:
            self.table[at] = model.scores(i, 0) if self.all is None else self.all[i]
        else:
            for n in range(LONGEST, 0, -1):
                if rows := [i for g in grams(word, n) if (i := model.grams.get(g)) is not None]:
                    self.table[at] = np.mean([model.scores(i, n) for i in rows], axis=0) if self.all is None else self.all[rows].sum(axis=0) / len(rows)
                    break
        self[word] = at
        return at

    def judge(self, text: str | None) -> tuple[str, float]:
        counts = Counter(words_of(text))
        if not counts or not self.model.languages:
            return "und", 0.0
        if len(self) * len(self.model.languages) > REMEMBERED:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, counts), np.int64, len(counts))
        n = np.fromiter(counts.values(), np.float64, len(counts))
        total = n @ self.table[rows]
        best = int(np.argmax(total))
        mean = (total - total[best]) / n.sum() * min(n.sum(), WORDS_FOR)
        return self.model.languages[best], float(1 / np.exp(mean).sum())


def _judged(model: object, at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores: Scores | None = Scores(model.value)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                found = [scores.judge(t.as_py()) for t in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[str(i) for i in range(batch.num_columns + 2)])
        scores = None
        give_back()

    return run


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and score of each text in two more columns, named ``names``.

    Columns of ``docs`` that have such a name are replaced.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)  # its size follows the number of languages only
    docs = docs.select(*(docs[c] for c in docs.columns if c not in names))
    numbered = docs.toDF(*map(str, range(len(docs.columns))))
    fields = [*numbered.schema.fields, T.StructField(str(len(docs.columns)), T.StringType()), T.StructField(str(len(docs.columns) + 1), T.DoubleType())]
    return numbered.mapInArrow(_judged(shared, docs.columns.index("text")), T.StructType(fields)).toDF(*docs.columns, *names)


def confident(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents with letters whose best language has a score of ``least`` or more.

    Learned from these documents' own labels; where none has one, every text with letters stays. Every
    row is judged by its text alone, so repeated rows all stay or all go, whatever their doc_id.
    """
    model = fit(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    lang, score = "language of the text", "score of the language"
    return predict(docs, model, (lang, score)).filter((F.col(lang) != "und") & (F.col(score) >= least)).select(docs.columns)
