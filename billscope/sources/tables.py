"""Flat tables: scans, sinks and the column report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    kind: str = "parquet",
    **options: str,
) -> DataFrame:
    """Read a table; text formats need a schema so that nothing is inferred."""
    if schema is None and kind != "parquet":
        raise ValueError(f"a {kind} scan needs a schema")
    reader = spark.read.format(kind).options(**options)
    return (reader if schema is None else reader.schema(schema)).load(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def nested_as_text(df: DataFrame) -> DataFrame:
    """Arrays, structs and maps as JSON text, for sinks that hold only flat cells."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in df.schema.fields
    ])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; nested cells become JSON text."""
    nested_as_text(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def column_report(tables: Mapping[str, DataFrame | Exception]) -> DataFrame:
    """Table, position, column, type and non-null count; an unreadable table gives an error row.

    Each table is scanned once; all counts of a table come from one aggregate.
    """
    spark = SparkSession.active()
    parts = []
    for name, table in tables.items():
        if isinstance(table, Exception):
            row = [F.lit(name), F.lit(-1), F.lit(None).cast("string"),
                   F.lit(f"error: {type(table).__name__}"), F.lit(0).cast("long")]
            titles = ["table_name", "position", "column_name", "column_type", "non_null"]
            parts.append(spark.range(1).select(*[c.alias(t) for c, t in zip(row, titles)]))
            continue
        fields = table.schema.fields
        counts = table.agg(*[F.count(F.col(f.name)).alias(f"c{i}") for i, f in enumerate(fields)])
        cells = F.array(*[
            F.struct(
                F.lit(name).alias("table_name"),
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("column_type"),
                F.col(f"c{i}").alias("non_null"),
            )
            for i, f in enumerate(fields)
        ])
        parts.append(counts.select(F.explode(cells).alias("r")).select("r.*"))
    return reduce(DataFrame.unionByName, parts)


def open_tables(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame | Exception]:
    """Open each path; keep the error of the ones that cannot be read."""
    opened: dict[str, DataFrame | Exception] = {}
    for name, path in paths.items():
        try:
            opened[name] = spark.read.parquet(path)
        except Exception as error:  # the report must go on over a bad file
            opened[name] = error
    return opened
