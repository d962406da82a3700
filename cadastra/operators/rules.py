"""Rule sets of the datasets, as findings: ``ident, code, severity`` and, where it tells, ``detail``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastra.functions.scalar import blank, month_key, number, ratio
from cadastra.operators.quality import Rule, rule_findings

#: Vocabularies of the price index and of the regional rates, and the first months of their parts.
SEGMENTS, DEALS, AREAS = ("RESIDENCIAL", "COMERCIAL"), ("VENDA", "LOCACAO"), ("DF_TOTAL", "LOCALIDADE")
BANDS = ("TOTAL", "1Q", "2Q", "3Q", "4+Q")
FIRST_COMMERCIAL, FIRST_LOCALITY = "2019-01", "2019-03"


def profile_findings(df: DataFrame, ident: str, income: str, shares: Sequence[str]) -> DataFrame:
    """Income not negative, shares 0 to 100, and all shares together about 100 (within 2) or 1 (within 0.02).

    A blank cell breaks no rule; the sum is judged only where every share is right.
    """
    df = df.withColumns({f"_n_{c}": number(F.col(c).cast("string")) for c in (income, *shares)})  # read once, however many rules name them
    n = {c: F.col(f"_n_{c}") for c in (income, *shares)}
    wrong = {c: ~blank(F.col(c)) & F.coalesce((n[c] < 0) | (n[c] > 100), F.lit(True)) for c in shares}
    total = sum((n[c] for c in shares), F.lit(0.0))
    rules = [Rule("invalid_income", "error", ~blank(F.col(income)) & F.coalesce(n[income] < 0, F.lit(True)))]
    rules += [Rule(f"invalid_percentage:{c}", "error", wrong[c]) for c in shares]
    whole = ~sum((wrong[c].cast("int") + blank(F.col(c)).cast("int") for c in shares), F.lit(0)).cast("boolean")
    rules.append(Rule("share_sum", "warning", whole & (F.abs(total - 100) > 2) & (F.abs(total - 1) > 0.02)))
    return rule_findings(df, ident, rules)


def first_lines(df: DataFrame, keyed: Column, *key: str) -> DataFrame:
    """``df`` with ``_first``, the first ``line`` of the rows with the same key; rows without one are keys of their own."""
    marked = df.withColumn("_keyed", F.coalesce(keyed, F.lit(False)))
    apart = F.when(~F.col("_keyed"), F.xxhash64("line", "id"))
    return marked.withColumn("_first", F.when(F.col("_keyed"), F.min("line").over(Window.partitionBy("_keyed", apart, *key)))).drop("_keyed")


def index_findings(df: DataFrame, sources: DataFrame, notes: DataFrame, regions: DataFrame, localities: DataFrame) -> DataFrame:
    """Findings of a monthly price index.

    ``df`` has ``id, line, month, segment, deal, area, locality, price, source, note, region``; the
    dimensions have ``id`` each. Rows by vocabulary, price and references; repeated observations by the
    line of the first; history that can't be; and months without a row of the whole area's main series,
    which have the month as ``ident``.
    """
    month = F.col("_month")
    df = df.withColumn("_month", F.coalesce(month_key("month"), F.lit("")))
    local = F.col("area") == "LOCALIDADE"
    rules = [
        Rule("invalid_month", "error", month == ""), Rule("invalid_segment", "error", ~F.coalesce(F.col("segment").isin(*SEGMENTS), F.lit(False))),
        Rule("invalid_deal", "error", ~F.coalesce(F.col("deal").isin(*DEALS), F.lit(False))), Rule("invalid_area", "error", ~F.coalesce(F.col("area").isin(*AREAS), F.lit(False))),
        Rule("invalid_price", "error", ~F.coalesce(F.col("price") > 0, F.lit(False))),
        Rule("early_commercial", "warning", (F.col("segment") == "COMERCIAL") & (month != "") & (month < FIRST_COMMERCIAL)),
        Rule("early_locality", "warning", local & (month != "") & (month < FIRST_LOCALITY)),
    ]
    # what the references hold comes to each row by a join on its own; one pass then tells all findings
    rows = df.withColumns({"_source": F.coalesce("source", F.lit("")), "_region": F.coalesce("region", F.lit(""))})
    for name, of, on in (("sources", sources, "_source"), ("notes", notes, "note"), ("regions", regions, "_region"), ("localities", localities, "locality")):
        known = of.select(F.col("id").alias(on)).distinct().withColumn(f"_in_{name}", F.lit(True))
        rows = rows.join(known, on, "left")
    absent = lambda name: F.col(f"_in_{name}").isNull()
    rules += [
        Rule("missing_source", "error", absent("sources")), Rule("missing_note", "warning", ~blank(F.col("note")) & absent("notes")),
        Rule("region_not_mapped", "error", F.coalesce(local, F.lit(False)) & absent("regions")), Rule("locality_not_mapped", "warning", F.coalesce(local, F.lit(False)) & ~blank(F.col("locality")) & absent("localities")),
        Rule("repeated_observation", "error", F.coalesce(F.col("line") > F.col("_first"), F.lit(False))),
    ]
    found = rule_findings(first_lines(rows, month != "", "_month", "segment", "deal", "area", "locality"), "id", rules)
    main = df.filter((month != "") & (F.col("area") == "DF_TOTAL") & (F.col("segment") == "RESIDENCIAL") & (F.col("deal") == "VENDA")).select(month.alias("m")).distinct()
    ends = main.agg(F.min("m").alias("a"), F.max("m").alias("b"))
    spine = ends.select(F.explode(F.sequence(F.to_date("a", "yyyy-MM"), F.to_date("b", "yyyy-MM"), F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("m"))
    return found.union(spine.join(main, "m", "left_anti").select("m", F.lit("month_gap"), F.lit("warning")))


def row_count_findings(counts: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Tables whose number of rows isn't the expected one; ``counts(ident, n)`` has a row a table."""
    want = F.element_at(F.create_map(*(F.lit(x) for kv in expected.items() for x in kv)), F.col("ident"))
    known = counts.filter(F.col("ident").isin(list(expected)))
    return known.filter(F.col("n") != want).select("ident", F.lit("row_count").alias("code"), F.lit("warning").alias("severity"))


def rate_findings(df: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Findings of monthly regional rates ``id, line, month, region, band, offered, sold, published, alias``."""
    whole = lambda c: F.coalesce((F.col(c) < 0) | (F.col(c) != F.floor(c)), F.lit(False))
    month = F.col("_month")
    apart = lambda a, b: F.coalesce(F.abs(a - b) > tolerance, F.lit(False))
    again = F.when(F.col("offered") > 0, 100 * ratio(F.col("sold").cast("double"), F.col("offered")))
    rules = [
        Rule("missing_region", "error", blank(F.col("region"))), Rule("invalid_band", "error", ~F.coalesce(F.col("band").isin(*BANDS), F.lit(False))), Rule("invalid_month", "error", month == ""),
        Rule("invalid_offered", "error", whole("offered")), Rule("invalid_sold", "error", whole("sold")),
        Rule("scale", "error", F.coalesce(~F.col("published").between(0, 100), F.lit(False))),
        Rule("alias_mismatch", "warning", apart(F.col("published"), F.col("alias"))), Rule("rate_mismatch", "warning", apart(again, F.col("published"))),
    ]
    keyed = ~blank(F.col("region")) & ~blank(F.col("band")) & (month != "")
    rows = first_lines(df.withColumn("_month", F.coalesce(month_key("month"), F.lit(""))), keyed, "_month", "region", "band")
    return rule_findings(rows, "id", [*rules, Rule("repeated", "error", F.coalesce(F.col("line") > F.col("_first"), F.lit(False)))])


def routine_findings(listings: DataFrame, history: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """Counts of what the checks of listings leave open: ``ident, code, n``.

    By portal, active listings that weren't seen for more than ``days`` days or were blocked at the last
    check; by month, history rows that are active without having been seen in that month.
    """
    portal = F.when(blank(F.col("portal")), "(none)").otherwise(F.trim("portal"))
    on = listings.filter(blank(F.col("status")) | (F.lower("status") == "active")).withColumn("ident", portal)
    stale = F.col("seen").isNull() | (F.datediff(today, F.col("seen")) > days)
    each = F.array_compact(F.array(F.when(stale, "stale"), F.when(F.col("check") == "blocked", "blocked")))
    found = on.select("ident", F.explode(each).alias("code"))
    open_ = history.filter((F.col("status") == "active") & F.col("month").isNotNull() & ~F.coalesce(F.date_format("seen", "yyyy-MM") == F.col("month"), F.lit(False)))
    return found.union(open_.select("month", F.lit("history_unverified"))).groupBy("ident", "code").agg(F.count("*").alias("n"))


def layer_findings(layer: DataFrame, expected: DataFrame, linked: DataFrame, kind: str) -> DataFrame:
    """Findings of a layer ``id, code, type, source`` against the codes it must hold and those with traffic.

    Expected codes that are absent, codes that repeat, another type, no source, no id, and features
    without traffic; ``ident`` is the code.
    """
    rules = [Rule("wrong_type", "error", ~F.coalesce(F.col("type") == kind, F.lit(False))), Rule("no_source", "warning", blank(F.col("source"))), Rule("no_id", "error", blank(F.col("id")))]
    found = rule_findings(layer.withColumnRenamed("code", "ident"), "ident", rules)
    codes = layer.groupBy("code").agg(F.count("*").alias("n"))
    absent = expected.select("code").distinct().join(codes, "code", "left_anti").select("code", F.lit("absent"), F.lit("error"))
    twice = codes.filter("n > 1").select("code", F.lit("duplicate"), F.lit("error"))
    idle = codes.join(linked.select("code").distinct(), "code", "left_anti").select("code", F.lit("no_traffic"), F.lit("info"))
    return found.union(absent).union(twice).union(idle)


def area_findings(cells: DataFrame, ident: str, measured: str, most: float = 0.05) -> DataFrame:
    """Cells whose measured area (km²) is off the nominal one by more than a share; their id begins with the side.

    ``200M..`` is a cell of 200 m, ``1KM..`` one of 1 km; ``ident, nominal, apart``.
    """
    side = F.regexp_extract(F.col(ident), r"^([0-9]+)(?:K?M)", 1).try_cast("double")
    km = F.when(F.col(ident).rlike("^[0-9]+KM"), side).otherwise(side / 1000)
    out = cells.select(ident, (km * km).alias("nominal"), F.col(measured).alias("_m"))
    return out.select(ident, "nominal", F.abs(ratio(F.col("_m"), F.col("nominal")) - 1).alias("apart")).filter((F.col("apart") > most) | F.col("nominal").isNull())


def fill_blank(df: DataFrame, column: str, value: Column) -> DataFrame:
    """``df`` with the column filled where it is blank, and ``filled``; anything else there is evidence and stays."""
    kind = df.schema[column].dataType
    fits = blank(F.col(column)) & value.isNotNull()
    return df.withColumn("filled", fits).withColumn(column, F.when(fits, value.cast(kind)).otherwise(F.col(column)))


def findings_view(findings: DataFrame, most: int = 5000, *, open_only: bool = False, **equal: str | None) -> DataFrame:
    """Findings by table, code, severity and origin, open ones only if wanted; the newest ``most``."""
    for column, value in equal.items():
        if value is not None:
            findings = findings.filter(F.col(column) == value)
    if open_only:
        findings = findings.filter(F.col("resolved").isNull())
    return findings.orderBy(F.desc("created"), "ident", "code").limit(most)


def refresh_findings(tables: dict[str, DataFrame], required: dict[str, Sequence[str]]) -> DataFrame:
    """What keeps a refresh of several tables from being done: absent tables, columns and rows; ``ident, code``.

    The refresh is all or nothing: it may go on only if this has no row.
    """
    spark = next(iter(tables.values())).sparkSession
    found = []
    for name, columns in required.items():
        df = tables.get(name)
        if df is None:
            found.append((name, "absent"))
            continue
        found += [(name, f"column:{c}") for c in columns if c not in df.columns]
        if not df.limit(1).count():
            found.append((name, "empty"))
    return spark.createDataFrame(found, "ident string, code string")

