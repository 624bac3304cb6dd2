"""Landed API responses: listing pages, bill resources and member histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billscope.operators.keyed import attach

ITEM = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("siglaTipo", T.StringType()),
    T.StructField("numero", T.IntegerType()),
    T.StructField("ano", T.IntegerType()),
    T.StructField("ementa", T.StringType()),
])
PAGE = T.StructType([
    T.StructField("ano", T.IntegerType()),
    T.StructField("tipo", T.StringType()),
    T.StructField("pagina", T.IntegerType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("dados", T.ArrayType(ITEM)),
])
EVENT = T.StructType([
    T.StructField("dataHora", T.StringType()),
    T.StructField("situacao", T.StringType()),
    T.StructField("descricaoStatus", T.StringType()),
    T.StructField("siglaPartido", T.StringType()),
    T.StructField("nome", T.StringType()),
])
HISTORY = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("historico", T.StructType([T.StructField("dados", T.ArrayType(EVENT))])),
])


def read_json(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Landed JSON under an explicit schema."""
    return spark.read.schema(schema).json(path)


def usable_pages(
    pages: DataFrame,
    run: Sequence[str] = ("ano", "tipo"),
    page: str = "pagina",
    status: str = "status",
    items: str = "dados",
    cap: int | None = None,
) -> DataFrame:
    """Pages of each run before its first failed or empty page, up to ``cap`` pages."""
    size = F.coalesce(F.size(items), F.lit(0))
    bad = (F.coalesce(F.col(status), F.lit(0)) != 200) | (size <= 0)
    light = pages.select(*run, F.col(page).alias("_p"), bad.alias("_bad"))
    firsts = light.groupBy(*run).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(F.when(F.col("_bad"), F.col("_p"))).alias("_stop")
    )
    kept = attach(pages, run, firsts)
    kept = kept.where(F.col("_stop").isNull() | (F.col(page) < F.col("_stop"))).drop("_stop")
    return kept if cap is None else kept.where(F.col(page) <= cap)


def page_items(pages: DataFrame, items: str = "dados") -> DataFrame:
    """One row per listed item with the five renamed fields."""
    return project_items(pages.select(F.explode(items).alias("d")))


def project_items(items: DataFrame, item: str = "d") -> DataFrame:
    return items.select(
        F.col(f"{item}.id").alias("id"),
        F.col(f"{item}.siglaTipo").alias("tipo"),
        F.col(f"{item}.numero").alias("numero"),
        F.col(f"{item}.ano").alias("ano"),
        F.col(f"{item}.ementa").alias("ementa"),
    )


def source_filter(
    bills: DataFrame,
    conditions: Column,
    key: str = "id",
    pages: int | None = None,
    page_size: int = 100,
) -> DataFrame:
    """Filter on the partition columns, newest key first, at most ``pages`` pages."""
    found = bills.where(conditions).orderBy(F.col(key).desc())
    return found if pages is None else found.limit(page_size * pages)


def history_events(history: DataFrame) -> DataFrame:
    """One row per history event with its position; an empty history gives one null event."""
    return history.select("id", F.posexplode_outer("historico.dados").alias("pos", "e")).select(
        "id", "pos", "e.*"
    )
