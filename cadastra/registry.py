"""Queries by name: each takes (spark, folder of tables), and most have the same query in SQL."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    """A registered query; ``after`` names the queries that a run of all puts before it."""

    name: str
    run: Run
    sql: str | None
    after: tuple[str, ...] = ()


_QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, *, name: str | None = None, after: tuple[str, ...] = ()) -> Callable[[Run], Run]:
    """Register a function under its name; registering a name twice is an error."""

    def put(run: Run) -> Run:
        key = name or run.__name__
        if key in _QUERIES:
            raise ValueError(f"query {key} is registered twice")
        _QUERIES[key] = Query(key, run, sql, after)
        return run

    return put


def load() -> dict[str, Query]:
    """Every query of the modules in ``cadastra.plans``."""
    import cadastra.plans as plans

    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"cadastra.plans.{module.name}")
    return dict(_QUERIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, where its source has fewer row groups than that.

    For costly work a row on small tables; a table of many row groups is read as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to several tasks a core, whatever row groups its files have: one large group is one task's else.

    For work a row that costs far more than to send the row.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(4 * cores, df.rdd.getNumPartitions()))
