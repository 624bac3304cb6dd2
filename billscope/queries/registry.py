"""Where query modules enter their functions and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from billscope.operators.keyed import spread_small_scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name, with the SQL that must give the same rows."""

    def enter(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return enter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents for work that is heavy per row."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", *columns)
    return spread_small_scan(documents, "doc_id")


def lines_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem for work grouped by order; the deal-out, if any, is the shuffle it needs anyway."""
    return spread_small_scan(table(spark, sf_dir, "lineitem"), "l_orderkey")
