"""Text vectors learned from the corpus: a randomised truncated singular value decomposition.

A text is its TF-IDF row over hashed terms, scaled to length one. With A the matrix of all rows,
each round multiplies AᵀA with a thin basis in one pass over the rows; tasks add what their rows
give to each bucket, Spark sums it per bucket, and the driver makes the basis orthonormal again.
A last small eigenvalue problem turns the basis to the leading right singular vectors, so close
meanings that share company, not only words, come near each other.

What tasks and the driver hold is ``width`` x (``size`` + ``extra``) numbers, whatever the size of
the corpus; its documents and its vocabulary only make passes longer. Terms that fall into one
bucket count as one term, so ``width`` should stand well above the number of telling terms.

Null and empty texts, and texts of left-out terms alone, get the zero vector. Repeated rows count
as often as they occur. An empty table gives a model whose vectors are all zero.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billscope.operators.tfidf import tokens
from billscope.shared import release, settle, ship

#: Non-zero weights that a task multiplies at a time.
CHUNK = 1 << 14
#: Vectors that a task hands back at a time, but for those of the last row.
VECTORS = 1 << 12


def buckets(text: Column, width: int, words: Sequence[str] = ()) -> Column:
    """Bucket of each term of a text in order; stop words are left out."""
    terms = tokens(text)
    if words:
        terms = F.filter(terms, lambda t: ~t.isin(*words))
    return F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(width)).cast("int"))


def _cells(column: pa.Array) -> Iterator[np.ndarray]:
    """The bucket lists of an Arrow column; a null is an empty list."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    yield from np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else ()


def _stretches(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """First row and number of rows of stretches with about ``VECTORS`` vectors."""
    before = np.cumsum(sizes) - sizes
    starts = np.flatnonzero(np.diff(before // VECTORS, prepend=-1))
    yield from zip(starts.tolist(), np.diff(starts, append=len(sizes)).tolist(), strict=True)


def _weights(cell: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of one text, scaled to length one."""
    seen, counts = np.unique(cell.astype(np.int64), return_counts=True)
    weight = counts * idf[seen]
    seen, weight = seen[weight > 0], weight[weight > 0]
    return seen, weight / np.sqrt(weight @ weight) if len(seen) else weight


def _chunks(cells: Iterator[np.ndarray], idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets, weights and first places of several texts with weights, put after each other."""
    held, size = [], 0
    for cell in cells:
        seen, weight = _weights(cell, idf)
        if len(seen):
            held.append((seen, weight))
            size += len(seen)
        if size >= CHUNK:
            yield _together(held)
            held, size = [], 0
    if held:
        yield _together(held)


def _together(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(seen) for seen, _ in held])
    return np.concatenate([s for s, _ in held]), np.concatenate([w for _, w in held]), np.cumsum(sizes) - sizes


def _frequencies(rows: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(width + 1, np.int64)
        for batch in batches:
            counts[width] += batch.num_rows
            for cell in _cells(batch.column(0)):
                counts[np.unique(cell.astype(np.int64))] += 1
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found])], names=["bucket", "n"])

    sums = rows.select("buckets").mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(width + 1, np.int64)
    counts[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return counts[:width], int(counts[width])


def _multiply(rows: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """AᵀA times the basis, from one pass over the rows."""
    width, size = basis.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, touched = np.zeros((width, size)), np.zeros(width, bool)
        for batch in batches:
            for seen, weight, first in _chunks(_cells(batch.column(0)), idf):
                ends = np.append(first, len(seen)).tolist()
                # a text's buckets differ, so its rows of the total can be added to at once
                for start, end in zip(ends, ends[1:]):
                    bucket, share = seen[start:end], weight[start:end]
                    total[bucket] += np.multiply.outer(share, share @ basis[bucket])
                touched[seen] = True
        found = np.flatnonzero(touched)
        for part in np.array_split(found, max(1, len(found) // 4096)):
            values = pa.FixedSizeListArray.from_arrays(pa.array(total[part].ravel()), size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), values.cast(pa.list_(pa.float64()))], names=["bucket", "total"]
            )

    parts = rows.select("buckets").mapInArrow(work, "bucket int, total array<double>")
    sums = parts.groupBy("bucket").agg(F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(size)]).alias("total")).toArrow()
    out = np.zeros((width, size))
    if sums.num_rows:
        values = sums.column("total").combine_chunks().flatten().to_numpy()
        out[sums.column("bucket").to_numpy()] = values.reshape(-1, size)
    return out


@dataclass(frozen=True)
class Latent:
    """Weights of buckets, and the leading right singular vectors as columns of ``components``."""

    idf: np.ndarray
    components: np.ndarray
    values: np.ndarray
    words: tuple[str, ...]

    @property
    def width(self) -> int:
        return len(self.idf)

    def encode(self, df: DataFrame, text: str, output: str = "vector") -> DataFrame:
        """Add the vector of a text column, or the list of vectors of an array of texts."""
        many = isinstance(df.schema[text].dataType, T.ArrayType)
        idf, components, names = self.idf, self.components, [*df.columns, output]
        size = components.shape[1]
        vector = T.ArrayType(T.DoubleType())
        schema = T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(vector) if many else vector)])
        if many:
            found = F.transform(F.col(text), lambda t: buckets(F.coalesce(t, F.lit("")), self.width, self.words))
        else:
            found = buckets(F.col(text), self.width, self.words)

        def lists(cells: pa.Array) -> pa.Array:
            out = np.zeros((len(cells), size))
            for i, cell in enumerate(_cells(cells)):
                seen, weight = _weights(cell, idf)
                out[i] = weight @ components[seen]
            return pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), size).cast(pa.list_(pa.float64()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                cells = whole.column(whole.num_columns - 1)
                sizes = cells.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) if many else np.ones(len(cells), np.int64)
                for start, length in _stretches(sizes.astype(np.int64)):
                    batch = whole.slice(start, length)
                    cells = batch.column(batch.num_columns - 1)
                    if many:
                        ends = np.cumsum(sizes[start : start + length])
                        vectors = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), lists(cells.flatten()))
                    else:
                        vectors = lists(cells)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], names=names)

        ship(df.sparkSession)
        return df.withColumn("_buckets", found).mapInArrow(run, schema)


def fit(
    df: DataFrame, text: str, size: int = 64, width: int = 1 << 16, words: Sequence[str] = (), min_df: int = 3,
    max_df: float = 0.8, extra: int = 10, rounds: int = 4, seed: int = 0,
) -> Latent:
    """Vectors of ``size`` numbers from all texts; ``rounds`` passes sharpen the basis, one more turns it.

    Buckets in fewer than ``min_df`` texts or in more than ``max_df`` of them weigh nothing. Fewer
    than ``size`` numbers come out only where ``width`` is smaller.
    """
    ship(df.sparkSession)
    rows = settle(df.select(buckets(F.col(text), width, words).alias("buckets")))
    counts, n = _frequencies(rows, width)
    kept = (counts >= max(1, min_df)) & (counts <= max_df * n)
    idf = np.where(kept, np.log((n + 1.0) / (counts + 1.0)) + 1.0, 0.0)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(width, size + extra))))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(_multiply(rows, idf, basis))[0]
    inner = basis.T @ _multiply(rows, idf, basis)
    release(rows)
    squares, turn = np.linalg.eigh((inner + inner.T) / 2)
    lead = np.argsort(-squares, kind="stable")[: min(width, size)]
    components, values = basis @ turn[:, lead], np.sqrt(np.maximum(squares[lead], 0.0))
    # beyond the rank of the rows there is nothing to learn
    components[:, values <= 1e-7 * max(values.max(initial=0.0), 1e-300)] = 0.0
    strongest = np.take_along_axis(components, np.abs(components).argmax(0)[None], 0)
    return Latent(idf, components * np.where(strongest < 0, -1.0, 1.0), values, tuple(words))
