"""Benchmark decontamination by template canonicalisation.

Numbers, names (capitalised words inside a sentence) and units become typed placeholders that carry
their value; case and punctuation go. Windows of ``WINDOW`` words of this template, values left out,
are joined by hash between documents and benchmark items, and so are windows of the plain words, as
names aren't seen in text of another case. An item of fewer words is one window of its own length,
and the documents get windows of each length that the benchmark has. For every place where an item may lie in a
document, the values in the matched windows are then compared: the same value of the item must always
meet the same value there (numbers may all have been changed, but alike). An item is found if
``SHARE`` of its windows or more lie in places that are consistent.

The benchmark's windows are broadcast only if they are ``BROADCAST`` at most, and the ids of documents
with a hit likewise; beyond that both are joined by a shuffle. Documents are read whole.

Rows: a null or wordless text has no window. A window of the benchmark without a plain word is found only
with its own values, as its template is anything; a text of numbers alone, however long, so meets none.
Rows without a doc_id or item_id are not reported; repeated rows are reported once. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import cut

WINDOW, SHARE, BROADCAST = 8, 0.5, 500_000
NAME, NUMBER, UNIT = "\ue001", "\ue002", "\ue003"
UNITS = "km|kg|mg|cm|mm|ml|m|g|l|km2|m2|ha|mph|kmh|ft|in|lb|lbs|oz|s|sec|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|meters?|metres?|miles?|dollars?|euros?|cents?|percent|%|usd|eur|brl"


def valued(text: Column) -> Column:
    """The words of a text with placeholders that hold their values, parted by single blanks."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"\x20[\s\p{Z}]++|[\s\p{Z}&&[^\x20]][\s\p{Z}]*+", " ")
    text = F.regexp_replace(text, r"(?<=[\p{Ll},;]\x20)(?=\p{Lu})", NAME)
    text = F.regexp_replace(text, r"[$€£]?+([0-9]++(?:[.,:/][0-9]++)*+)", NUMBER + "$1")
    text = F.regexp_replace(text, rf"(?i)({NUMBER}[0-9][0-9.,:/]*+)\x20?({UNITS})(?!\p{{L}})", f"$1 {UNIT}$2")
    text = F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}\s{NAME}{NUMBER}{UNIT}%]++", "")
    return F.trim(F.regexp_replace(text, r"\s++", " "))


def template(text: Column) -> Column:
    """The same without the values."""
    return F.regexp_replace(text, rf"([{NAME}{NUMBER}{UNIT}])\S*+", "$1")


def plain(text: Column) -> Column:
    """The same without the placeholders."""
    return F.regexp_replace(text, f"[{NAME}{NUMBER}{UNIT}]", "")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, " "), "")


def windows(df: DataFrame, lengths: list[Column], *keep: str, worded: bool = False) -> DataFrame:
    """``keep``, position and hash of each window of ``text``, of its template and of its plain words.

    ``worded``: of the template only windows with a plain word; windows of its plain words stand for the others.
    """
    df = df.select(*keep, valued(F.col("text")).alias("v"))  # no filter on it: that would work it out twice
    df = df.select(*keep, words(template(F.col("v"))).alias("w"), words(plain(F.col("v"))).alias("p"))

    def each(of: str, n: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
        if worded and of == "w":
            starts = F.filter(starts, lambda i: ~F.forall(F.slice("w", i, n), lambda w: w.isin(NAME, NUMBER, UNIT)))
        return F.transform(starts, lambda i: F.struct((i - 1).alias("pos"), F.xxhash64(F.slice(of, i, n)).alias("window")))

    fits = lambda n: (F.size("w") > 0) & (F.size("w") >= n)
    found = [x for n in lengths for x in (F.when(fits(n), each("w", n)), F.when(fits(n) & (F.col("w") != F.col("p")), each("p", n)))]
    return df.select(*keep, F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("x")).select(*keep, "x.pos", "x.window")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_windows, share, same_values``: a row for each item found in a document."""
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = cut(benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct())
    grams = cut(windows(items, [F.least(F.size("w"), F.lit(WINDOW))], "item_id", worded=True).withColumnRenamed("pos", "ipos").distinct())
    lengths = items.select(F.least(F.size(words(valued(F.col("text")))), F.lit(WINDOW)).alias("n")).filter("n > 0").distinct().collect()  # WINDOW rows at most
    hits = cut(windows(docs, [F.lit(r["n"]) for r in lengths] or [F.lit(WINDOW)], "doc_id").join(_small(grams), "window").select("doc_id", "pos", "item_id", "ipos"))

    # the words with their values of the documents that have a hit
    own = docs.join(_small(hits.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", words(valued(F.col("text"))).alias("dw"))
    theirs = items.select("item_id", words(valued(F.col("text"))).alias("iw"))
    places = hits.groupBy("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("shift")).agg(F.collect_set("ipos").alias("at"))
    # a pair of document and item in one row: the words go along once, whatever number of places they have
    pairs = places.groupBy("doc_id", "item_id").agg(F.collect_list(F.struct("shift", "at")).alias("places")).join(own, "doc_id").join(theirs, "item_id")
    met = lambda at: F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(i, F.least(i + WINDOW, F.size("iw")) - 1))))
    values = lambda p: F.array_distinct(F.filter(F.transform(met(p["at"]), lambda k: F.struct(F.get("iw", k).alias("i"), plain(F.get("dw", k + p["shift"])).alias("d"))), lambda v: v["i"].rlike(f"[{NAME}{NUMBER}{UNIT}]")))
    bare = F.forall("iw", lambda w: w.rlike(f"^[{NAME}{NUMBER}{UNIT}]"))
    valued_places = F.transform("places", lambda p: F.struct(p["at"].alias("at"), values(p).alias("pairs")))
    places = pairs.select("doc_id", "item_id", bare.alias("bare"), F.explode(valued_places).alias("p")).select("doc_id", "item_id", "bare", "p.*")
    places = places.withColumn("consistent", F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"]))))
    places = places.withColumn("same", F.forall("pairs", lambda p: plain(p["i"]) == p["d"])).filter("consistent and (same or not bare)")
    found = places.select("doc_id", "item_id", "same", F.explode("at").alias("ipos")).groupBy("doc_id", "item_id").agg(F.count_distinct("ipos").alias("n_windows"), F.min("same").alias("same_values"))
    total = grams.groupBy("item_id").agg(F.count_distinct("ipos").alias("of"))
    return found.join(total, "item_id").withColumn("share", F.col("n_windows") / F.col("of")).filter(F.col("share") >= SHARE).select("doc_id", "item_id", "n_windows", "share", "same_values")


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item is found."""
    return docs.join(contaminated(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
