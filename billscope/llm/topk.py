"""Exact top-k by inner product, with vectors grouped by length.

Vectors are multiplied by ``scale`` and rounded down to integers. Sorted by falling length they
are cut into buckets of ``BUCKET`` rows, and queries into blocks of ``BLOCK``; both are rows of
binary matrices, so a task holds one bucket and one block.

The longest bucket of a dimension gives each query a first k-th score, its threshold. A bucket
whose greatest length is l can only hold a better product at a cosine of at least
threshold / (|query| * l), the bucket's local threshold. Above 1, neither the bucket nor a
shorter one can help, so a block meets the prefix of buckets that one of its queries needs. Inside
a bucket each query takes one of two ways to prune: with a high local threshold, candidates must
lie in the feasible interval of the query's largest coordinates; with a low one, only lengths are
compared. Products of what is left are computed in exact integers.

Vectors whose squared integer length passes 62 bits are long: their products are computed with
Python integers, in blocks of their own, and one that doesn't fit in a long counts as the nearest long.

Vectors that are null, empty or hold a null or non-finite component take no part. Only vectors of one
dimension meet. Every row is a candidate, repeated ones too; rows that share an id share one list of
k as queries. No row meets its own id; rows without an id take no part. Ties go to the smaller id.
An empty table gives no rows. Of columns with clashing names only those asked for play a part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billscope.llm.common import each_row, map_arrays, map_batches, pick
from billscope.shared import settle

BUCKET, BLOCK = 2048, 512
#: Local cosine threshold from which coordinates are tried, and how many of them.
STEEP, FOCUS = 0.6, 4
SLACK = 1e-9
MOST, LEAST = (1 << 63) - 1, -(1 << 63)
MATRIX = "dim int, longest double, ids binary, lengths binary, matrix binary"


def integers(df: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """vec_id, dim, length, the vector as 64-bit bytes and whether it is long, of the vectors that take part.

    Long vectors are given as they are, in doubles, the others in integers.
    """
    rows = pick(df, vec_id=id_column, v=vector_column).where("vec_id is not null and v is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")
    ).where(
        # before copies meet, so that no broken vector stands for a good one of its id
        (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )

    def work(batches: Iterator[pa.RecordBatch]):
        for vec, values in each_row(batches, 1000):
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(scale * np.array(values))
                square = float(scaled @ scaled)
            if square < 2.0**62:
                yield vec, len(values), float(np.sqrt(square)), scaled.astype("<i8").tobytes(), False
            else:
                yield vec, len(values), float("inf"), np.array(values, "<f8").tobytes(), True

    return map_batches(rows, work, "vec_id long, dim int, length double, v binary, long boolean")


def whole_numbers(matrix: bytes, rows: int, long: bool, scale: int) -> np.ndarray:
    """The integers of a block as Python integers; a product that passes all doubles is one of whole numbers."""
    if not long:
        return np.frombuffer(matrix, "<i8").reshape(rows, -1).astype(object)
    scaled = [(x, scale * x) for x in np.frombuffer(matrix, "<f8").tolist()]
    found = np.array([math.floor(s) if math.isfinite(s) else int(x) * scale for x, s in scaled], object)
    return found.reshape(rows, -1)


def long_products(asked: DataFrame, rows: DataFrame, queries_long: bool, rows_long: bool, k: int, scale: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each block, where queries, rows or both are long."""
    size = ["ids", "matrix"]
    left = _blocks(asked, BLOCK, asked.count()).select("dim", *size)
    right = _blocks(rows, BLOCK, rows.count()).select("dim", *[F.col(c).alias(f"b_{c}") for c in size])

    def work(batches: Iterator[pa.RecordBatch]):
        for q_ids, q_matrix, b_ids, b_matrix in each_row(batches, 1):
            q_ids, ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(b_ids, "<i8")
            scores = whole_numbers(q_matrix, len(q_ids), queries_long, scale) @ whole_numbers(b_matrix, len(ids), rows_long, scale).T
            for i, query in enumerate(q_ids.tolist()):
                near = sorted((-max(LEAST, min(MOST, s)), v) for s, v in zip(scores[i].tolist(), ids.tolist(), strict=True) if v != query)
                yield from ((query, v, -s) for s, v in near[:k])

    return map_batches(left.join(right, "dim").drop("dim"), work, "query_id long, vec_id long, score long")


def _blocks(rows: DataFrame, size: int, count: int) -> DataFrame:
    """Rows of up to ``size`` vectors of one dimension, neighbours in falling length."""

    def work(batches: Iterator[pa.RecordBatch]):
        held: list[tuple] = []

        def block():
            ids, lengths = np.array([h[1] for h in held], "<i8"), np.array([h[2] for h in held])
            return held[0][0], float(lengths.max()), ids.tobytes(), lengths.tobytes(), b"".join(h[3] for h in held)

        for row in each_row(batches, 1000):
            if held and (row[0] != held[0][0] or len(held) == size):
                yield block()
                held = []
            held.append(row)
        if held:
            yield block()

    ordered = rows.withColumn("short", -F.col("length")).repartitionByRange(max(1, -(-count // (8 * size))), "dim", "short", "vec_id")
    return map_batches(
        ordered.sortWithinPartitions("dim", "short", "vec_id").select("dim", "vec_id", "length", "v"), work, MATRIX, 4
    )


def _unpacked(ids: bytes, lengths: bytes, matrix: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, "<i8")
    return found, np.frombuffer(lengths, "<f8"), np.frombuffer(matrix, "<i8").reshape(len(found), -1)


def _products(queries: np.ndarray, vectors: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products: in floating point while every partial sum is an exact integer."""
    if bound < 2.0**52:
        return (queries.astype(float) @ vectors.T.astype(float)).astype(np.int64)
    return queries @ vectors.T


def best(query: tuple, bucket: tuple, kth: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, vector, score) of the k best of a bucket for each query, as far as they reach its ``kth`` score."""
    q_ids, q_lengths, q = query
    ids, lengths, v = bucket
    most = q_lengths * lengths.max()
    local = np.divide(kth.astype(float), most, out=np.full(len(q_ids), -np.inf), where=most > 0)
    open_ = (local <= 1 + SLACK) & ((kth <= 0) | (most > 0))
    plain = np.flatnonzero(open_ & (local < STEEP))
    scores = _products(q[plain], v, most.max())
    # the bucket is sorted by falling length: what can reach the threshold is a prefix
    least = np.divide(kth[plain].astype(float), q_lengths[plain], out=np.full(len(plain), -np.inf), where=q_lengths[plain] > 0)
    prefix = np.searchsorted(-lengths, -least * (1 - SLACK) + SLACK, "right")
    for row, i in enumerate(plain):
        yield from _ranked(q_ids[i], ids[: prefix[row]], scores[row, : prefix[row]], kth[i], k)
    unit = v / np.where(lengths > 0, lengths, 1)[:, None]
    for i in np.flatnonzero(open_ & (local >= STEEP)):
        mine = q[i] / q_lengths[i]
        focus = np.argsort(-np.abs(mine))[:FOCUS]
        # a vector at an angle of at most ``angle`` has coordinates within that angle of the query's
        angle, at = np.arccos(min(1.0, local[i] - SLACK)) + SLACK, np.arccos(np.clip(mine[focus], -1, 1))
        low, high = np.cos(np.minimum(np.pi, at + angle)) - SLACK, np.cos(np.maximum(0, at - angle)) + SLACK
        near = np.flatnonzero(((unit[:, focus] >= low) & (unit[:, focus] <= high)).all(1))
        if len(near):
            yield from _ranked(q_ids[i], ids[near], _products(q[i : i + 1], v[near], most[i])[0], kth[i], k)


def _ranked(query: int, ids: np.ndarray, scores: np.ndarray, kth: int, k: int) -> Iterator[tuple[int, int, int]]:
    fits = np.flatnonzero((scores >= kth) & (ids != query))
    if len(fits) > 4 * k:  # all that reach the k-th best score, ties too
        fits = fits[scores[fits] >= np.partition(scores[fits], -k)[-k]]
    for j in fits[np.lexsort((ids[fits], -scores[fits]))[:k]]:
        yield int(query), int(ids[j]), int(scores[j])


def top_k(
    df: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """query_id, rank from 1, vec_id and score: the k best rows of ``df`` for each query, its own left out."""
    every = settle(integers(df, id_column, vector_column, scale))
    every_query = settle(integers(queries, id_column, vector_column, scale))
    rows, asked = every.where("not long"), every_query.where("not long")
    buckets = settle(_blocks(rows, BUCKET, rows.count()))
    blocks = settle(_blocks(asked, BLOCK, asked.count()))
    # number of a bucket within its dimension, by falling length; only a narrow row per bucket is ordered
    buckets = buckets.withColumn("key", F.monotonically_increasing_id())
    order = Window.partitionBy("dim").orderBy(F.desc("longest"), "key")
    numbers = buckets.select("key", "dim", "longest").select("key", F.row_number().over(order).alias("bucket"))
    named = settle(buckets.join(numbers, "key"))
    size = ["ids", "lengths", "matrix"]
    seeds = named.where("bucket = 1").select("dim", *[F.col(c).alias(f"b_{c}") for c in size])

    def first(batches: Iterator[pa.RecordBatch]):
        for dim, *both in each_row(batches, 1):
            query = _unpacked(*both[:3])
            kth = np.full(len(query[0]), np.iinfo(np.int64).min)
            found: dict[int, list[int]] = {}
            for q, _, score in best(query, _unpacked(*both[3:]), kth, k):
                found.setdefault(q, []).append(score)
            for i, q in enumerate(query[0].tolist()):
                if len(found.get(q, ())) >= k:  # more than k where an id has several vectors
                    kth[i] = sorted(found[q])[-k]
            need = np.divide(kth.astype(float), query[1], out=np.full(len(kth), -np.inf), where=query[1] > 0)
            yield dim, *both[:3], kth.astype("<i8").tobytes(), float(need.min())

    started = settle(map_batches(
        blocks.join(seeds, "dim").select("dim", *size, *[f"b_{c}" for c in size]), first,
        "dim int, ids binary, lengths binary, matrix binary, kth binary, need double", 4,
    )).withColumn("block", F.monotonically_increasing_id())
    number = named.groupBy("dim").agg(F.max("bucket").alias("buckets"))
    # narrow rows first: a bucket shorter than all thresholds of a block ask for holds nothing for it
    meets = started.select("dim", "block", "need").join(number, "dim").select(
        "dim", "block", "need", F.explode(F.sequence(F.lit(1), "buckets")).alias("bucket")
    ).join(named.select("dim", "bucket", "longest"), ["dim", "bucket"]).where(
        F.col("longest") * (1 + SLACK) + SLACK >= F.col("need")
    ).select("dim", "block", "bucket")
    pairs = meets.join(started.select("block", *size, "kth"), "block").join(
        named.select("dim", "bucket", *[F.col(c).alias(f"b_{c}") for c in size]), ["dim", "bucket"]
    )

    def verify(batches: Iterator[pa.RecordBatch]):
        for ids, lengths, matrix, kth, *bucket in each_row(batches, 1):
            found = list(best(_unpacked(ids, lengths, matrix), _unpacked(*bucket), np.frombuffer(kth, "<i8"), k))
            if found:
                yield [np.array(c, np.int64) for c in zip(*found, strict=True)]

    scored = map_arrays(pairs.select(*size, "kth", *[f"b_{c}" for c in size]), verify, "query_id long, vec_id long, score long")
    long_rows, long_asked = every.where("long"), every_query.where("long")
    if not long_rows.isEmpty():
        scored = scored.unionByName(long_products(asked, long_rows, False, True, k, scale))
        scored = scored.unionByName(long_products(long_asked, long_rows, True, True, k, scale))
    if not long_asked.isEmpty():
        scored = scored.unionByName(long_products(long_asked, rows, True, False, k, scale))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
