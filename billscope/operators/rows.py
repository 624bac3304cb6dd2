"""Row filters, conditional updates and column choice, with pandas' rules for nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billscope.operators.ordered import at_most, chunk_count, row_numbers

IN_LIST_LIMIT = 1000
#: Rows with texts or lists that one task orders; at 20,000 words a row still some hundred MB.
WIDE_ROWS = 5000


def keep_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def add_row_id(df: DataFrame, order: Sequence[str], name: str = "ID") -> DataFrame:
    """0-based position in the given total order; take it before rows are dropped.

    Only a short table passes one task, and of rows that hold texts or lists a much shorter one.
    """
    narrow = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    wide = not all(isinstance(f.dataType, narrow) for f in df.schema.fields)
    chunks = chunk_count(df) if wide and not at_most(df, WIDE_ROWS) else None
    numbered = row_numbers(df, [], order, "_row", chunks)
    return numbered.withColumn(name, F.col("_row") - 1).drop("_row")


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(subset) if subset else None)


def reject_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Drop rows whose text starts with the prefix; null rows stay."""
    return df.where(~F.coalesce(F.col(column).startswith(prefix), F.lit(False)))


def not_equal(df: DataFrame, column: str, value: object, drop_null: bool = False) -> DataFrame:
    """Drop rows that equal the value; null rows stay unless asked otherwise."""
    kept = df.where(~F.col(column).eqNullSafe(F.lit(value)))
    return kept.where(F.col(column).isNotNull()) if drop_null else kept


def approved_rows(df: DataFrame, approved: Column) -> DataFrame:
    return df.where(F.coalesce(approved, F.lit(False)))


def rejected_rows(df: DataFrame, approved: Column, finished: Column) -> DataFrame:
    """Finished but not approved."""
    return df.where((approved == F.lit(False)) & (finished == F.lit(True)))


def members(
    df: DataFrame, column: str, values: Sequence[object] | DataFrame, inside: bool = True
) -> DataFrame:
    """Rows whose value is (or is not) among the values; a null is never inside.

    A short list becomes an ``IN``; a one-column DataFrame becomes a semi or anti join.
    """
    if not isinstance(values, DataFrame):
        if len(values) <= IN_LIST_LIMIT:
            hit = F.coalesce(F.col(column).isin(*values), F.lit(False))
            return df.where(hit if inside else ~hit)
        values = df.sparkSession.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", df.schema[column].dataType)]))
    side = values.select(F.col(values.columns[0]).alias("_v")).distinct()
    return df.join(side, df[column] == side["_v"], "left_semi" if inside else "left_anti")


def update_where(df: DataFrame, mask: Column, column: str, value: object) -> DataFrame:
    return df.withColumn(column, F.when(mask, F.lit(value)).otherwise(F.col(column)))


def fill_nulls(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.fillna(values)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def long_form(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide columns to (name, value) rows."""
    return df.unpivot(list(ids), list(columns), name, value)


def split_by_membership(
    df: DataFrame, column: str, values: Sequence[object] | DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The rows inside and the rows outside; together they are the whole table."""
    return members(df, column, values), members(df, column, values, inside=False)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
