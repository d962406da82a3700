"""Line dedup by a log-template tree.

A line's words with digits are variable fields. The tree has a fixed depth: a line goes to a leaf by
its number of words and its ``LEADING`` first words. In a leaf a word's support at its place is the
number of texts whose lines have it there. A line then has up to three templates, from special to
general: itself; the line whose words of a support below what makes a line recur are variable; and the
line whose words of a support below half of the leaf's texts are. A template with fewer constant words
than ``SIMILAR`` of its places isn't one.

A template is recurring if it occurs in enough different texts: ``OF_LONG`` if it has ``LONG``
constant words or more, ``OF_WORDS`` if it has ``SHORTEST`` or more, else ``DOCUMENTS``, and
``OF_SHORT`` for lines of fewer than ``SHORTEST`` words. Its first line (smallest doc_id, then
position) stays and every other one is dropped.

All of it are counts with partial sums over (leaf, place, word) and (template, text): no leaf is
gathered in a task, and none is treated otherwise for its size. Leaves seen in fewer texts than any
template needs are left out after one count, and only leaves of several different lines are counted
word by word. Joins on a line or template that very many texts share are dealt out (``spread_join``).

Rows: a null text has no lines and stays null. Lines without a word always stay. A text may have any
number of lines. Texts that are equal count once, so a text with many copies isn't recurring by itself.
Rows of one doc_id and equal text are treated alike; rows without a doc_id stay as they are. Extra
columns stay; columns named like the two that are added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import cut, hot_keys, small, spread_join

LEADING, SHORTEST, DOCUMENTS, SIMILAR = 3, 3, 10, 0.6
#: Different texts that make a line recur: of ``LONG`` constant words, of ``SHORTEST``, and a line of fewer words.
LONG, OF_LONG, OF_WORDS, OF_SHORT = 20, 2, 3, 100
BROADCAST = 500_000
_ANY = "<*>"


def _blanks(line: Column) -> Column:
    return F.trim(F.when(line.rlike(r"[^\S\x20]|\x20\x20"), F.regexp_replace(line, r"\s++", " ")).otherwise(line))


def _fields(line: Column) -> Column:
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", _ANY)).otherwise(line)


def masked(lines: Column) -> Column:
    """Each line's words, those with a digit made variable, parted by single blanks.

    In two steps, as the second names its line more than once.
    """
    return F.transform(F.transform(lines, _blanks), _fields)


def _enough(n: Column, constant: Column) -> Column:
    """Different texts that a template of ``n`` words must occur in."""
    return F.when(n < SHORTEST, OF_SHORT).when(constant >= LONG, OF_LONG).when(constant >= SHORTEST, OF_WORDS).otherwise(DOCUMENTS)


def _constant(line: Column) -> Column:
    """Number of a template's constant words."""
    return F.size(F.array_remove(F.split(line, " "), _ANY))


def _lines(texts: DataFrame) -> DataFrame:
    """Leaf and hash of every line that has a word."""
    # masked inside the generator, so that the filter below doesn't work it out again
    lines = texts.filter("doc_id is not null").select("doc_id", "th", F.posexplode(masked(F.split("text", "\n"))).alias("pos", "line"))
    lines = lines.filter("line <> ''").withColumn("n", F.size(F.split("line", " ")))
    return lines.select("doc_id", "th", "pos", "n", _constant(F.col("line")).alias("constant"), F.xxhash64("n", F.substring_index("line", " ", LEADING)).alias("leaf"), F.xxhash64("line").alias("mh"))


def _templates(texts: DataFrame, examples: DataFrame) -> DataFrame:
    """``leaf, mh, general``: the templates (tid, constant) of each example ``leaf, mh, n, texts, doc_id, th, pos``."""
    wanted = examples.groupBy("doc_id", "th").agg(F.collect_list(F.struct("leaf", "mh", "n", "texts", "pos")).alias("e"))
    some = texts.join(small(examples.select("doc_id", "th").distinct(), BROADCAST), ["doc_id", "th"], "left_semi")
    some = some.join(wanted, ["doc_id", "th"]).select(F.split("text", "\n").alias("ls"), F.explode("e").alias("e"))
    some = some.select("e.leaf", "e.mh", "e.n", "e.texts", masked(F.array(F.get("ls", F.col("e.pos"))))[0].alias("line"))
    some = cut(some.groupBy("leaf", "mh", "n", "texts").agg(F.min("line").alias("line")))

    words = some.select("leaf", "mh", "n", "texts", F.posexplode(F.split("line", " ")).alias("place", "word")).filter(F.col("word") != _ANY)
    words = words.select("leaf", "mh", "n", "texts", F.xxhash64("place", "word").alias("w"))
    support = words.groupBy("leaf", "w").agg(F.sum("texts").alias("support"), F.count("*").alias("rows"))
    half = some.groupBy("leaf").agg((F.sum("texts") / 2).alias("half"))
    # a leaf's words share its half; both tables are smaller than that of the words
    support = cut(support.join(half, "leaf").filter((F.col("support") >= F.col("half")) | (F.col("support") >= OF_LONG)))
    met = spread_join(words, support.drop("rows"), ["leaf", "w"], hot_keys(support, ["leaf", "w"], "rows"), ["mh"])
    levels = (F.col("support") >= F.when(F.col("n") >= LONG, OF_LONG).otherwise(OF_WORDS), F.col("support") >= F.col("half"))
    of = met.groupBy("leaf", "mh", "n").agg(*(x for i, level in enumerate(levels) for x in (F.count_if(level).alias(f"n{i}"), F.bit_xor(F.when(level, F.col("w"))).alias(f"h{i}"))))
    each = [F.when(F.col(f"n{i}") >= SIMILAR * F.col("n"), F.struct(F.xxhash64("leaf", f"h{i}", f"n{i}").alias("tid"), F.col(f"n{i}").cast("int").alias("constant"))) for i in range(len(levels))]
    return of.select("leaf", "mh", F.array_compact(F.array(*each)).alias("general"))


def drop_recurring_lines(docs: DataFrame, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with the remaining text in ``text``, and the numbers of its lines and of those dropped added as ``names``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    lines = cut(_lines(texts))
    # no template of a leaf has more constant words than the leaf's lines have words
    leaves = lines.select("leaf", "n", "th").distinct().groupBy("leaf", "n").count().filter(F.col("count") >= _enough(F.col("n"), F.col("n"))).select("leaf")
    leaves = cut(leaves)
    lines = lines.join(small(leaves, BROADCAST), "leaf", "left_semi").select("doc_id", "th", "pos", "n", "constant", "leaf", "mh")

    # different lines, and the templates of those in leaves that have several
    examples = lines.groupBy("leaf", "mh", "th").agg(F.min(F.struct("doc_id", "pos", "n")).alias("e"), F.count("*").alias("rows"))
    examples = examples.groupBy("leaf", "mh").agg(F.min(F.struct("e.doc_id", "th", "e.pos", "e.n")).alias("e"), F.count("*").alias("texts"), F.sum("rows").alias("rows"))
    examples = cut(examples.select("leaf", "mh", "e.*", "texts", "rows"))
    several = examples.groupBy("leaf").count().filter("count > 1").select("leaf")
    template = cut(_templates(texts, examples.join(several, "leaf", "left_semi")))

    # recurring templates, and the lines to drop
    lines = spread_join(lines, template, ["leaf", "mh"], hot_keys(examples, ["leaf", "mh"], "rows"), ["doc_id", "th", "pos"], "left")
    own = F.array(F.struct(F.xxhash64("leaf", "mh").alias("tid"), F.col("constant").cast("int").alias("constant")))
    lines = lines.select("doc_id", "th", "pos", "n", F.explode(F.array_distinct(F.concat(own, F.coalesce("general", F.array().cast("array<struct<tid:bigint,constant:int>>"))))).alias("t"))
    lines = cut(lines.select("doc_id", "th", "pos", "t.tid", _enough(F.col("n"), F.col("t.constant")).alias("enough")))
    recurring = lines.groupBy("tid", "enough", "th").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.count("*").alias("rows")).groupBy("tid", "enough").agg(F.count("*").alias("texts"), F.min("f").alias("f"), F.sum("rows").alias("rows"))
    recurring = cut(recurring.filter("texts >= enough").select("tid", "f", "rows"))
    gone = spread_join(lines.select("doc_id", "th", "pos", "tid"), recurring.drop("rows"), ["tid"], hot_keys(recurring, ["tid"], "rows"), ["doc_id", "th", "pos"])
    gone = gone.filter("doc_id <> f.doc_id or pos <> f.pos").groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("gone"))

    keys = [c for c in docs.columns if c.lower() not in names]
    inner = docs.select(F.struct(*(docs[c] for c in keys)).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("th"))
    out = inner.join(gone, ["doc_id", "th"], "left").select("row", F.split("row.text", "\n").alias("ls"), "gone")
    # the runs of lines between those that go
    edges = out.withColumn("edges", F.concat(F.array(F.lit(-1)), F.coalesce("gone", F.array().cast("array<int>")), F.array(F.size("ls"))))
    runs = F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda k: F.slice("ls", F.get("edges", k - 1) + 2, F.get("edges", k) - F.get("edges", k - 1) - 1))
    kept = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    return edges.select(
        *(F.col(f"row.`{c}`").alias(c) if c != "text" else kept.alias("text") for c in keys),
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size("ls")).cast("long").alias(names[0]),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(names[1]),
    )
