"""Helpers of this subpackage: columns by position, Arrow row mapping, byte words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from billscope.shared import ship

#: The six separators of a word in every contract here; all other characters belong to words.
SPACES = "\\x20\\x09-\\x0D"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Columns of ``df`` under new names, found by position.

    The first column of exactly the given name counts, else the first that differs in case
    only; further columns, clashing ones too, play no part.
    """
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])

    def at(name: str) -> int:
        for same in (lambda n: n == name, lambda n: n.lower() == name.lower()):
            for i, n in enumerate(names):
                if same(n):
                    return i
        raise ValueError(f"no column {name} among {names}")

    return plain.select(*[F.col(f"_{at(n)}").alias(out) for out, n in columns.items()])


def documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id (long) and text (null: empty) of a documents table."""
    rows = pick(df, doc_id=id_column, text=text_column)
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[tuple]], schema: str, rows: int = 2000):
    """``mapInArrow`` for a generator of result tuples; they leave in batches of ``rows``."""
    ship(df.sparkSession)
    kind = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    serialized = kind.serialize().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.ipc.read_schema(pa.py_buffer(serialized))
        held: list[tuple] = []
        for row in work(batches):
            held.append(row)
            if len(held) >= rows:
                yield as_batch(held, out)
                held = []
        if held:
            yield as_batch(held, out)

    return df.mapInArrow(run, schema)


def map_arrays(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[list]], schema: str):
    """``mapInArrow`` for a generator of column lists (numpy arrays or Python lists)."""
    ship(df.sparkSession)
    kind = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    serialized = kind.serialize().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.ipc.read_schema(pa.py_buffer(serialized))
        for columns in work(batches):
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, out, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return df.mapInArrow(run, schema)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def each_row(batches: Iterator[pa.RecordBatch], size: int = 64) -> Iterator[tuple]:
    """Rows as Python values; only ``size`` rows are unpacked at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield from zip(*[c.to_pylist() for c in batch.slice(start, size).columns], strict=True)


def digest(text: str = "text") -> Column:
    """Tells rows with one id and different texts apart."""
    return F.xxhash64(text)


def rewrite(docs: DataFrame, found: DataFrame, column: str, change: Callable[[str, object], str]) -> DataFrame:
    """``docs`` with ``change(text, value)`` for each text, where ``found`` has a value of ``column``.

    ``found`` has doc_id and digest of the text; its rows for repeated rows are equal. ``n_chars``
    follows the text if there is such a column. Texts must not be null.
    """
    one = found.groupBy("doc_id", "digest").agg(F.first(column).alias(column))
    rows = docs.withColumn("_digest", digest())
    joined = rows.join(one, [rows.doc_id.eqNullSafe(one.doc_id), rows["_digest"] == one.digest], "left").select(
        *[rows[c] for c in docs.columns], one[column].alias("_found")
    )
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = list(batch.columns[:-1])
            at = names.index("text")
            old, values = arrays[at].to_pylist(), batch.columns[-1].to_pylist()
            new = [t if v is None else change(t, v) for t, v in zip(old, values, strict=True)]
            arrays[at] = pa.array(new, arrays[at].type)
            if "n_chars" in names:
                k = names.index("n_chars")
                arrays[k] = pa.array([len(t) for t in new], arrays[k].type)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    ship(docs.sparkSession)
    return joined.mapInArrow(run, docs.schema)
