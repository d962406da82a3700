"""Findings, and the import of a batch: reject, decide, upsert, undo, change log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions.scalar import blank, filled
from cadastra.operators import selection


@dataclass(frozen=True)
class Rule:
    """A finding's code and severity, and when a row violates the rule."""

    code: str
    severity: str
    violated: Column


def rule_findings(df: DataFrame, ident: str, rules: Sequence[Rule]) -> DataFrame:
    """``ident, code, severity`` of every violated rule of every row: one pass, no shuffle."""
    cells = F.array_compact(F.array(*(F.when(r.violated, F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"))) for r in rules)))
    return df.select(ident, F.explode(cells).alias("f")).select(ident, "f.*")


def missing_references(df: DataFrame, ident: str, references: dict[str, tuple[str, DataFrame, str]]) -> DataFrame:
    """Rows whose code -> (column, dimension, key) isn't in the dimension; NULL refers to nothing."""
    out = None
    for code, (column, dimension, key) in references.items():
        bad = df.filter(F.col(column).isNotNull()).join(dimension.select(F.col(key).alias("_k")).distinct(), F.col(column) == F.col("_k"), "left_anti").select(ident, F.lit(code).alias("code"))
        out = bad if out is None else out.unionByName(bad)
    return out


def duplicates(df: DataFrame, key: str, position: str) -> DataFrame:
    """Rows that repeat a key, with the position of the first one; blank keys too."""
    first = df.filter(~blank(F.col(key))).groupBy(key).agg(F.min(position).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = df.join(first, key).filter(F.col(position) > F.col("first")).select(position, F.col(key).cast("string").alias("key"), "first", F.lit("duplicate").alias("code"))
    empty = df.filter(blank(F.col(key))).select(position, F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("first"), F.lit("empty").alias("code"))
    return again.unionByName(empty)


def header_findings(columns: Sequence[str], required: Sequence[str]) -> list[tuple[str, str]]:
    """(code, column) of headers that are blank, repeated or missing."""
    names = [c.strip() for c in columns]
    found = [("blank_header", str(i + 1)) for i, c in enumerate(names) if not c]
    found += [("duplicate_header", c) for c in dict.fromkeys(names) if c and names.count(c) > 1]
    return found + [("missing_header", c) for c in required if c not in names]


def crosswalk_findings(df: DataFrame, number: str, code: str, keys: Sequence[str], expected: int) -> DataFrame:
    """``ident, code``: codes that don't read back as their number, keys that repeat, and a wrong number of rows."""
    from cadastra.functions.scalar import region_number

    wrong = df.filter(~F.coalesce(region_number(F.col(code)) == F.col(number), F.lit(False))).select(F.col(code).cast("string").alias("ident"), F.lit("roman").alias("code"))
    for key in keys:
        again = df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
        wrong = wrong.union(again.select(F.concat(F.lit(f"{key}="), F.coalesce(F.col(key).cast("string"), F.lit("null"))), F.lit("repeated")))
    total = df.agg(F.count("*").alias("n")).filter(F.col("n") != expected)
    return wrong.union(total.select(F.col("n").cast("string"), F.lit("count")))


def validate_batch(batch: DataFrame, line: str, key: str, rules: Sequence[Rule], existing: DataFrame, mode: str) -> DataFrame:
    """The batch with ``errors`` and ``action``: reject, insert, update or ignore.

    A key that an earlier line of the batch has is an error; one that the table has is one in mode
    ``fail`` and else updated or ignored.
    """
    if mode not in ("fail", "update", "ignore"):
        raise ValueError(f"mode {mode}")
    first = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(line).alias("_first"))
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    rows = batch.join(first, key, "left").join(known, key, "left")
    errors = [F.when(r.violated, r.code) for r in rules] + [F.when(F.col(key).isNull(), "required"), F.when(F.col(line) > F.col("_first"), "repeated_in_file")]
    if mode == "fail":
        errors.append(F.when(F.col("_known"), "exists"))
    rows = rows.withColumn("errors", F.array_compact(F.array(*errors)))
    action = F.when(F.size("errors") > 0, "reject").when(F.col("_known").isNull(), "insert").otherwise(mode)
    return rows.withColumn("action", action).drop("_first", "_known")


def upsert(table: DataFrame, rows: DataFrame, key: str, columns: Sequence[str], import_id: str) -> DataFrame:
    """A new snapshot: rows of the table patched with what the batch fills, and new rows; one join.

    ``table`` has ``import_id`` and ``version``; both are stamped on what changes.
    """
    new = rows.filter(F.col("action").isin("insert", "update")).select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_new"))
    out = table.withColumn("_old", F.lit(True)).join(new, key, "full_outer")
    touched = F.coalesce(F.col("_new"), F.lit(False))
    patch = [F.coalesce(filled(F.col(f"_{c}")).try_cast(table.schema[c].dataType), F.col(c)).alias(c) for c in columns]
    rest = [c for c in table.columns if c not in (key, *columns, "import_id", "version")]
    return out.select(key, *patch, *rest, F.when(touched, import_id).otherwise(F.col("import_id")).alias("import_id"), F.when(touched, F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version")).alias("version"))


def undo(table: DataFrame, import_id: str) -> tuple[DataFrame, DataFrame]:
    """The table without what an import inserted, and the rows of it that stay as they were edited since."""
    mine = F.coalesce(F.col("import_id") == import_id, F.lit(False))
    return table.filter(~(mine & (F.col("version") == 1))), table.filter(mine & (F.col("version") > 1)).withColumn("reason", F.lit("edited_later"))


def change_log(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key, field, before, after`` of every changed field; texts of one number are equal."""
    a = old.select(key, *(F.col(c).cast("string").alias(f"_{c}") for c in columns))
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"_{c}").alias("before"), F.col(c).cast("string").alias("after")) for c in columns))
    rows = a.join(new, key).select(key, F.explode(cells).alias("c")).select(key, "c.*")
    x, y = F.col("before").try_cast("double"), F.col("after").try_cast("double")
    same = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(F.col("before").eqNullSafe(F.col("after")))
    return rows.filter(~same)


def research_queue(df: DataFrame, ident: str, fields: Sequence[str]) -> DataFrame:
    """One row for every blank priority field."""
    return df.select(ident, F.explode(F.array_compact(F.array(*(F.when(blank(F.col(f)), f) for f in fields)))).alias("field"))


def key_conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("values")).filter("values > 1")


#: Severities in order.
SEVERITY = ("error", "warning", "info")


def ordered(findings: DataFrame, *then: str) -> DataFrame:
    """By severity, unknown ones last, then the given columns."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("severity")), F.lit(0)), F.lit(99))
    return findings.orderBy(rank, *then)


#: What a published text must not hold.
SECRETS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "google_key": r"AIza[0-9A-Za-z_-]{35}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "cloud_key": r"AKIA[0-9A-Z]{16}",
    "assigned": r"(?i)(?:token|secret|password|api_key)\s*[=:]\s*[\"'][^\"'\s]{12,}[\"']",
}


def credential_scan(df: DataFrame, ident: str, text: str) -> DataFrame:
    """``ident, code`` of every kind of credential in a text."""
    return df.select(ident, F.explode(F.array_compact(F.array(*(F.when(F.col(text).rlike(p), code) for code, p in SECRETS.items())))).alias("code"))


def paginated(df: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """A 1-based page; one beyond the end is the last. Only the ranges of the order that the page lies in are sorted."""
    return selection.page(df, order, page, size)


def mixed_order(column: str, ident: str) -> list[Column]:
    """Numbers as numbers before texts, blanks last, ties by id."""
    c = F.col(column)
    return [F.when(blank(c), 2).when(c.try_cast("double").isNotNull(), 0).otherwise(1), c.try_cast("double"), F.lower(c), F.col(ident)]


def due(df: DataFrame, today: Column, checked: str, status: str, source_active: Column, position: str) -> DataFrame:
    """Rows to check today, oldest check first: not checked today; inactive ones only after seven days."""
    age = F.datediff(today, F.col(checked))
    ready = F.col(checked).isNull() | F.when(F.col(status) == "inactive", age >= 7).otherwise(age >= 1)
    return df.filter(ready & source_active).orderBy(F.col(checked).asc_nulls_first(), position)
