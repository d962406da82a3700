from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

from cadastra.registry import load

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A few of each module here; all of them run against DuckDB at sf0.01 in the driver.
SOME = ["number_parse", "pip_assign", "period_metrics", "running_ytd", "suppressed_stats", "edition_full_join", "known_listings", "household_totals", "coverage_cube", "monthly_flow", "upsert_snapshot", "page_links", "resolution_rollup", "stream_daily_flow"]


def rows(records: list[dict]) -> list:
    return sorted((sorted((k, round(v, 6) if isinstance(v, float) else str(v)) for k, v in r.items()) for r in records), key=repr)


@pytest.mark.parametrize("name", SOME)
def test_query_against_sql(spark: SparkSession, name: str) -> None:
    q = load()[name]
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = db.sql(q.sql)
    got = [r.asDict() for r in q.run(spark, DATA).collect()]
    assert rows(got) == rows([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()])


def test_every_query_has_a_name_once() -> None:
    assert len(load()) > 100


def test_page_verdict_reads_the_whole_page(spark: SparkSession, tmp_path: Path) -> None:
    html = f"<html><head><style>{'a' * 900}</style></head><body>{'<p>text</p>' * 90}<p>Anúncio removido</p></body></html>"
    spark.createDataFrame([(7, "https://a.b/c", html), (15, "https://a.b/d", html.replace("removido", "novo"))], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {r["page_id"]: r["verdict"] for r in load()["page_verdict"].run(spark, str(tmp_path)).collect()} == {7: "error", 15: "ok"}
