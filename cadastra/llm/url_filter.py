"""URL filters: rules, then link-graph propagation.

A rule's verdict holds for the urls that it fits, the longest rule winning. Every other url gets the
verdict of its host: personalised PageRank flows along host links from hosts with allowed pages
(trust), and against them from hosts with blocked pages (distrust), as who links to a blocked host is
suspect. A host is blocked if its distrust exceeds both ``RATIO`` times its trust and ``DENSITY``
times its share of the pages.

Rounds go on until all that is still to flow is less than ``CHANGE`` of the whole; a round shrinks it to
``DAMPING`` times the last at most, so there are about 100 at most. Hosts, links and seeds are
counted with partial aggregation; a round is one join on the host and one sum. Links of a host that very
many others link to, or that links to very many, are dealt out, and so are the pages of a large host.

A null url, or one without ``://``, has an empty host and path, and no rule fits it; the empty host has
no rank and is allowed. Null html has no links. Repeated rows get a row each, and each counts as a page;
a null page_id is kept. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import cut, hot_keys, spread_join

#: (verdict, host, path): fits the host and its subdomains where the url's path starts with the path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Rounds between two checkpoints.
UNROLLED = 6
DAMPING, CHANGE = 0.85, 1e-6
RATIO, DENSITY = 1.0, 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a url; both empty if it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_ranks(pages: DataFrame) -> DataFrame:
    """``host, n, share, trust, distrust`` of every host of ``pages(host, verdict, html)``; n is its pages."""
    links = (
        pages.filter("host <> ''").select("host", F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)\b(?:href|src)\s*=\s*["']?([a-z]*:?//[^\s"'>]*)"""), F.lit(1))).alias("url"))
        .select(F.col("host").alias("src"), host_and_path(F.when(F.col("url").startswith("//"), F.concat(F.lit(":"), F.col("url"))).otherwise(F.col("url")))[0].alias("dst"))
        .filter("dst <> '' and src <> dst").groupBy("src", "dst").count()
    )
    links = cut(links)
    own = pages.filter("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"))
    hosts = own.unionByName(links.select(F.col("dst").alias("host"), F.lit(0).alias("n"), F.lit(0).alias("a"), F.lit(0).alias("b"))).groupBy("host").agg(*(F.sum(c).alias(c) for c in "nab"))
    hosts = cut(hosts)
    n, a, b = (max(1, x or 0) for x in hosts.agg(F.sum("n"), F.sum("a"), F.sum("b")).first())
    seeds = F.explode(F.array(F.struct(F.lit("t").alias("kind"), (F.col("a") / a).alias("left")), F.struct(F.lit("d").alias("kind"), (F.col("b") / b).alias("left"))))
    state = hosts.select("host", seeds.alias("s")).select("s.kind", "host", "s.left", F.lit(0.0).alias("rank"))
    if links.limit(1).count():
        state = _spread(cut(state), links)
    state = state.select("kind", "host", (F.col("left") + F.col("rank")).alias("rank"))
    sums = {r["kind"]: r["s"] or 1.0 for r in state.groupBy("kind").agg(F.sum("rank").alias("s")).collect()}  # two rows
    kind = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)) / (sums.get(k) or 1.0)
    return hosts.select("host", "n", (F.col("n") / n).alias("share")).join(state.groupBy("host").agg(kind("t").alias("trust"), kind("d").alias("distrust")), "host")


def _spread(state: DataFrame, links: DataFrame) -> DataFrame:
    """``kind, host, left, rank`` after what is ``left`` of each host has flowed on until hardly any is left.

    In a round a host's ``left`` is added to its ``rank``, and DAMPING of it goes on as the ``left`` of those it
    flows to; what hosts without links keep back would return to the seeds, which only scales the ranks.
    """
    flows = links.select(F.lit("t").alias("kind"), F.col("src").alias("host"), "dst", "count").union(links.select(F.lit("d").alias("kind"), "dst", "src", "count"))
    sums = cut(flows.groupBy("kind", "host").agg(F.sum("count").alias("out"), F.count("*").alias("rows")))
    hubs = hot_keys(sums, ["kind", "host"], "rows")
    flows = spread_join(flows, sums.drop("rows"), ["kind", "host"], hubs, ["dst"]).select("kind", "host", "dst", (DAMPING * F.col("count") / F.col("out")).alias("part"), F.lit(0.0).alias("stays"))
    flows = cut(flows.union(state.select("kind", "host", F.col("host").alias("dst"), F.lit(0.0), F.lit(1.0))))
    while True:
        for _ in range(UNROLLED):
            moved = spread_join(flows, state, ["kind", "host"], hubs, ["dst"])
            state = moved.groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("left") * F.col("part")).alias("left"), F.sum((F.col("rank") + F.col("left")) * F.col("stays")).alias("rank"))
        state = cut(state)
        most = state.groupBy("kind").agg(F.sum("left").alias("s")).agg(F.max("s")).first()[0] or 0.0
        if most * DAMPING / (1 - DAMPING) < CHANGE:
            return state


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every row."""
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", "html", host.alias("host"), path.alias("path")).withColumn("r", longest_rule(F.col("host"), F.col("path"), rules))
    judged = judged.select("page_id", "host", "path", "r.rule", "r.verdict", "html")
    ranks = cut(host_ranks(judged))
    blocked = (F.col("distrust") > RATIO * F.col("trust")) & (F.col("distrust") > DENSITY * F.col("share"))
    out = spread_join(judged.drop("html"), ranks.drop("n"), ["host"], hot_keys(ranks, ["host"], "n"), ["page_id", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
