"""Personal data by candidate gradient boosting.

Base spans are the leftmost matches of four formats that pass their check (parts of an address, check
digit of a card, digits of a phone); they are always kept. Generators of high recall propose more spans,
which may overlap these: addresses written with ``(at)`` and ``(dot)`` or ``[.]``, card numbers of other
lengths, phone numbers without a country's prefix, and a fifth kind, ``secret``: long tokens of letters
and digits such as passwords and access keys. Every proposal becomes twelve yes/no features of its
format and of its surroundings.

Labels come from masked base spans and are held apart from the features. In the examples every valid base
span of a kind is rewritten as one that the base format misses (``@`` as ``(at)``, dots in brackets, a
phone number without its ``+`` or its country's prefix, a card number under another separation), the
generators propose again, and a proposal is positive if it meets a rewritten span: the trees learn to
recover it among all that merely looks alike. No feature is what makes a base span. A secret is positive if a word such as ``password`` and a colon or an
equals sign stand before it, or if it begins like an access key; its features are those of the rest of
the token and of what follows it. As a proposal that meets no base span may still be one, a word such as
``call`` before it can't lower its score. Small trees are boosted on the counts of the (at most 4096) feature
codes of one half of the examples, and the other half gives the rate of positives above each score: the
threshold of a kind is the lowest score from which that rate is ``PRECISION`` or more over at least
``LEAST`` proposals. Proposals that reach it and overlap no base span are added. A kind that has no such score isn't looked for.

The examples are all documents, which a hash deals to the two halves. What goes to the driver is a count
for each kind, code, label and half. The patterns read a run of characters once, so long texts take time
in proportion to their length.

Rows: a null text is empty and has no spans. Positions are code points, the end exclusive. Repeated
rows get a row each, and rows without a doc_id as well; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


KINDS = ("email", "ip", "card", "phone")
#: The kinds of spans that the method adds.
ADDED = (*KINDS, "secret")
#: Base formats. A quantifier that can't take part in backtracking is possessive, and a run of digits
#: or of an address is only tried from its start: the matches are those of the plain formats.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a base format implies, and what each generator does: texts without it aren't searched.
IMPLIED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
NEEDS = {
    "email": r"(?i)@|[(\[]at[)\]]", "ip": r"(?i)[0-9](?:\.|\[\.\]|\(\.\))[0-9]|[0-9a-f]:[0-9a-f]", "card": r"[0-9]{4}[\x20-]?[0-9]{4}", "phone": r"[0-9]{2}\)?[\x20./-]\(?[0-9]{2}",
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{12}",
}
GENERATORS = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[a-z0-9-]++ ?(?:\.|\(dot\)|\[dot\]) ?[a-z]{2,}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}+){3}(?::[0-9]{1,5}+)?|(?i)(?<![0-9a-f:])[0-9a-f]{1,4}+(?::[0-9a-f]{1,4}+){7}",
    "card": r"(?<![0-9])[0-9]{4}+[\x20-]?[0-9]{4,6}+[\x20-]?[0-9]{4,5}+(?:[\x20-]?[0-9]{1,4}+)?",
    "phone": r"(?<![0-9])(?:\+|00)?(?:\(?[0-9]{2,4}+\)?[\x20./-]){1,3}[0-9]{3,4}+[\x20.-]?[0-9]{2,4}+(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{12,}+=*+",
}
#: What stands before a secret, and how an access key begins.
BEFORE = r"(?i)(?:pass|passwd|password|pwd|token|secret|api[_ -]?key|access[_ -]?key|bearer|auth)[\"']?\s{0,2}[:=]\s{0,2}[\"']?$"
BEGINS = "(?:AKIA|ASIA|AIza|gh[opsu]_|github_pat_|xox[abps]-|sk-|sk_live_|eyJ)"
HINTS = r"(?i)(?:mail|contact|tel|phone|call|fax|ip|host|server|card|visa|credit|pay)[a-z]*\W{0,3}$"
ROUNDS, RATE, PRECISION, LEAST, CONTEXT = 20, 0.3, 0.95, 5, 24
FEATURES = 12
#: The feature, for all kinds but secrets, that a word such as ``call`` or ``mail`` stands before the span.
HINT = 6
_SPAN = "struct<start:int,end:int,text:string>"


def matches(text: Column, pattern: str, gate: str) -> Column:
    """array<struct<start, end, text>> of a pattern's matches; texts without the gate aren't searched."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, 1, F.greatest(F.size(found), F.lit(0))), lambda m, g: F.struct(m.alias("m"), F.char_length(g).alias("g")))
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    walk = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["g"] + F.char_length(p["m"])).alias("at"),
            F.array_append(acc["out"], F.struct((acc["at"] + p["g"]).alias("start"), (acc["at"] + p["g"] + F.char_length(p["m"])).alias("end"), p["m"].alias("text"))).alias("out"),
        ),
    )["out"]
    return F.when(text.rlike(gate), walk).otherwise(none)


def masked(kind: str, span: Column) -> Column:
    """A base span's text in a form that the base format misses; which one is picked by its hash."""
    form = F.pmod(F.xxhash64(span), F.lit(3))
    if kind == "email":
        at = F.when(form == 0, "(at)").when(form == 1, " (at) ").otherwise("[at]")
        return F.regexp_replace(F.replace(span, F.lit("@"), at), r"\.(?=[A-Za-z0-9-]*$)", "(dot)")
    if kind == "ip":
        return F.replace(span, F.lit("."), F.when(form == 0, "(.)").otherwise("[.]"))
    if kind == "phone":
        return F.when(form == 0, F.substring(span, 2, 1 << 20)).otherwise(F.regexp_replace(span, r"^\+[0-9]{1,3}[\x20.-]*", ""))
    return F.regexp_replace(span, "[\\x20-]", "")


def rewritten(kind: str, text: Column) -> Column:
    """struct(text, spans): the text with each valid base span masked, and where these lie in it."""
    found = F.regexp_extract_all(text, F.lit(BASE[kind]), F.lit(0))
    gaps = F.split(text, BASE[kind], -1)
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(g.alias("g"), m.alias("m"), F.coalesce(valid(kind, F.struct(m.alias("text"))), F.lit(False)).alias("ok")))
    pairs = F.transform(pairs, lambda p: F.struct(p["g"].alias("g"), p["ok"].alias("ok"), F.when(p["ok"], masked(kind, p["m"])).otherwise(p["m"]).alias("m")))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    spans = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.char_length(p["g"]) + F.char_length(p["m"])).alias("at"),
            F.when(p["ok"], F.array_append(acc["out"], F.struct((acc["at"] + F.char_length(p["g"])).alias("start"), (acc["at"] + F.char_length(p["g"]) + F.char_length(p["m"])).alias("end")))).otherwise(acc["out"]).alias("out"),
        ),
    )["out"]
    whole = F.concat(F.array_join(F.transform(pairs, lambda p: F.concat(p["g"], p["m"])), ""), F.element_at(gaps, -1))
    return F.struct(F.when(text.rlike(IMPLIED[kind]), whole).otherwise(text).alias("text"), F.when(text.rlike(IMPLIED[kind]), spans).otherwise(none).alias("spans"))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def valid(kind: str, span: Column) -> Column:
    """The check of a base match."""
    if kind == "ip":
        return span["text"].rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    if kind == "card":
        number = digits(span["text"])
        return F.when(F.length(number).between(16, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(span["text"])).between(8, 15)
    return F.lit(True)


def _before(text: Column, span: Column) -> Column:
    return F.substring(text, F.greatest(span["start"] - CONTEXT + 1, F.lit(1)), F.least(span["start"], F.lit(CONTEXT)))


def features(kind: str, text: Column, span: Column) -> list[Column]:
    """Twelve booleans of the format and of the surroundings, none of which is what the label rests on."""
    s = span["text"]
    before, after = _before(text, span), F.substring(text, span["end"] + 1, F.lit(2))
    if kind == "secret":
        rest = F.regexp_replace(s, f"^{BEGINS}", "")
        return [
            rest.rlike("^[0-9a-f]+$"), F.length(rest) >= 16, F.length(rest) >= 24, F.length(rest) >= 36, rest.rlike("[A-Z]"), rest.rlike("[a-z]"), F.length(digits(rest)) * 4 >= F.length(rest),
            rest.rlike("[_/+=-]"), rest.rlike("[A-Za-z]{6}"), rest.rlike("[0-9]{6}"), after.rlike("^[\"']"), (after == "") | after.rlike(r"^[\s.,;!?)]"),
        ]
    bare = F.regexp_replace(s, r"^(?:\+|00)[0-9]{0,3}[\x20./-]?", "") if kind == "phone" else s
    number = digits(bare)
    form = {
        "email": [s.rlike(r"^[^@(\[ ]*[.]"), s.rlike("[A-Z]"), s.rlike(r"[.)\]] ?[A-Za-z]{2,4}$"), s.rlike("[0-9]"), F.length(s) > 40, F.length(s) < 10],
        "ip": [s.rlike(r":[0-9]{1,5}$") & ~s.rlike("^[0-9a-fA-F]+:"), s.rlike("^[0-9a-fA-F]+:"), s.rlike(r"(?:^|[.\])])0[0-9]"), s.rlike(r"^[0-9]\D+[0-9]\D"), s.rlike(r"^(?:10|127|192|172)\D"), F.length(s) > 17],
        "card": [luhn(number), s.contains(" "), s.contains("-"), s.rlike("^[3-6]"), s.rlike(r"^[0-9]{4}\D"), s.rlike(r"(?:^|\D)[0-9]{6}(?:\D|$)")],
        "phone": [bare.rlike(r"^\("), bare.rlike(r"[0-9]{3}[-. ][0-9]{4}$"), F.length(number) == 10, bare.contains("."), bare.contains("-"), bare.contains(" ")],
    }[kind]
    around = [before.rlike(HINTS), before.rlike(r"[A-Za-z0-9]$"), before.rlike(r"[.:/=-]$"), (before == "") | before.rlike(r"\s$"), after.rlike(r"^[A-Za-z0-9]"), (after == "") | after.rlike(r"^[\s.,;!?)#&%*$]")]
    return form + around


def _code(kind: str, text: Column, span: Column) -> Column:
    code = F.lit(0)
    for i, f in enumerate(features(kind, text, span)):
        code = code + F.when(f, 1 << i).otherwise(0)
    return code


def _scored(docs: DataFrame, keep: list[str], kinds: tuple[str, ...]) -> DataFrame:
    """``keep``, the valid base spans of each kind (``b_``), and the proposals of ``kinds`` with their code (``p_``).

    ``apart`` tells that a proposal overlaps no base span.
    """
    text = F.col("text")
    out = docs.select(*keep, "text", *(matches(text, BASE[k], IMPLIED[k]).alias(f"b_{k}") for k in KINDS), *(matches(text, GENERATORS[k], NEEDS[k]).alias(f"p_{k}") for k in kinds))
    out = out.select(*keep, "text", *(F.filter(f"b_{k}", partial(valid, k)).alias(f"b_{k}") for k in KINDS), *(f"p_{k}" for k in kinds))
    meets = lambda k, s: F.exists(f"b_{k}", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    def coded(k: str) -> Column:
        each = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), (~reduce(lambda a, b: a | b, [meets(x, s) for x in KINDS])).alias("apart"), _code(k, text, s).alias("code"))
        return F.transform(f"p_{k}", each).alias(f"p_{k}")

    return out.select(*keep, *(f"b_{k}" for k in KINDS), *map(coded, kinds))


def _examples(docs: DataFrame, kind: str) -> DataFrame:
    """``half, kind, met, code`` of every proposal of a kind in the rewritten texts; ``met`` is the label."""
    if kind == "secret":
        docs = docs.withColumn("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)"))
    else:
        docs = docs.select("half", rewritten(kind, F.col("text")).alias("r")).select("half", "r.text", "r.spans")
    text = F.col("text")
    label = lambda s: _before(text, s).rlike(BEFORE) | s["text"].rlike(f"^{BEGINS}") if kind == "secret" else F.exists("spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    found = docs.select("half", "text", "spans", matches(text, GENERATORS[kind], NEEDS[kind]).alias("p"))
    coded = F.transform("p", lambda s: F.struct(F.lit(kind).alias("kind"), label(s).alias("met"), _code(kind, text, s).alias("code")))
    return found.select("half", F.explode(coded).alias("p")).select("half", "p.*")


Tree = tuple[int, int, tuple[float, float, float, float]]


def boost(counts: dict[int, tuple[int, int]], rising: frozenset[int] = frozenset()) -> list[Tree]:
    """Trees of two features each on counts (negative, positive) a code: Newton steps of logistic loss.

    A leaf is chosen by both features; the pair of features with the largest gain is taken. A feature
    in ``rising`` never lowers a score: leaves that would break this are merged.
    """
    score = dict.fromkeys(counts, 0.0)
    trees: list[Tree] = []
    for _ in range(ROUNDS):
        steps = {}
        for code, (neg, pos) in counts.items():
            p = 1 / (1 + math.exp(-score[code]))
            steps[code] = (pos - (neg + pos) * p, (neg + pos) * p * (1 - p))
        best: tuple[float, Tree] | None = None
        for i in range(FEATURES):
            for j in range(i + 1, FEATURES):
                g, h = [0.0] * 4, [1.0] * 4
                for code, (a, b) in steps.items():
                    leaf = (code >> i & 1) * 2 + (code >> j & 1)
                    g[leaf] += a
                    h[leaf] += b
                for low, high in [(0, 2), (1, 3)] * (i in rising) + [(0, 1), (2, 3)] * (j in rising):
                    if g[high] / h[high] < g[low] / h[low]:
                        g[low] = g[high] = (g[low] + g[high]) / 2
                        h[low] = h[high] = (h[low] + h[high]) / 2
                gain = sum(a * a / b for a, b in zip(g, h, strict=True))
                if best is None or gain > best[0] + 1e-12:
                    best = gain, (i, j, tuple(RATE * a / b for a, b in zip(g, h, strict=True)))
        if best is None:
            break
        trees.append(best[1])
        for code in score:
            score[code] += _value(best[1], code)
    return trees


def _value(tree: Tree, code: int) -> float:
    return tree[2][(code >> tree[0] & 1) * 2 + (code >> tree[1] & 1)]


def threshold(trees: Iterable[Tree], counts: dict[int, tuple[int, int]]) -> float:
    """Lowest score from which on the share of positives is PRECISION or more, over LEAST proposals; infinite if none is."""
    trees = list(trees)
    scored = sorted(((sum(_value(t, c) for t in trees), n) for c, n in counts.items()), key=lambda x: -x[0])
    neg = pos = 0
    found = math.inf
    for i, (score, (a, b)) in enumerate(scored):
        neg, pos = neg + a, pos + b
        if (i + 1 == len(scored) or scored[i + 1][0] < score) and pos + neg >= LEAST and pos >= PRECISION * (pos + neg):
            found = score - 1e-9  # the same sum in another order must not fall short of it
    return found


def fit(docs: DataFrame) -> dict[str, tuple[list[Tree], float]]:
    """Trees and threshold of each kind, from all documents."""
    halves = docs.withColumn("half", F.pmod(F.xxhash64("doc_id", "text"), F.lit(2))).select("half", "text")
    each = reduce(DataFrame.unionByName, [_examples(halves, k) for k in ADDED])
    counted: dict[tuple[str, int], dict[int, tuple[int, int]]] = {}
    for r in each.groupBy("half", "kind", "met", "code").count().collect():  # at most 2 x 5 x 2 x 4096 rows
        own = counted.setdefault((r["kind"], r["half"]), {})
        neg, pos = own.get(r["code"], (0, 0))
        own[r["code"]] = (neg, pos + r["count"]) if r["met"] else (neg + r["count"], pos)
    out = {}
    for k in ADDED:
        trees = boost(counted.get((k, 0), {}), frozenset() if k == "secret" else frozenset([HINT]))
        out[k] = trees, threshold(trees, counted.get((k, 1), {}))
    return out


def _score(trees: list[Tree], code: Column) -> Column:
    total = F.lit(0.0)
    for i, j, leaves in trees:
        total = total + F.element_at(F.array(*map(F.lit, leaves)), F.shiftright(code, i).bitwiseAND(1) * 2 + F.shiftright(code, j).bitwiseAND(1) + 1)
    return total


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, base, added`` of every row: arrays of struct(kind, start, end) in order of kind and start."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return spans_by(docs, fit(docs))


def spans_by(docs: DataFrame, model: dict[str, tuple[list[Tree], float]]) -> DataFrame:
    """``find_pii`` with a model that is there already; ``text`` must not be null."""
    kinds = tuple(k for k in ADDED if not math.isinf(model[k][1]))
    found = _scored(docs, ["doc_id"], kinds)
    part = lambda k, spans: F.transform(spans, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    chosen = lambda k, trees, least: part(k, F.filter(f"p_{k}", lambda s: s["apart"] & (_score(trees, s["code"]) >= least)))
    return found.select("doc_id", F.concat(*(part(k, F.col(f"b_{k}")) for k in KINDS)).alias("base"), F.concat(none, *(chosen(k, *model[k]) for k in kinds)).alias("added"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans in order of kind and start, joined by commas."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(F.array(*map(F.lit, ADDED)), s["kind"]).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
