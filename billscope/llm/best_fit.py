"""Packed token matrices by best-fit-decreasing, with a segment tree over free room.

Documents are tokenized, and those beyond a row's length are cut into whole rows and a rest, so
no id is lost. A task gathers pieces of about ``BUFFER`` tokens, sorts them by length and puts
each into the open row with the least room that is enough; a segment tree over the room finds
it in logarithmic time. Rows leave the task as soon as its buffer is placed: nothing is shuffled,
no key groups rows, memory is one buffer and its rows.

A row is ``length`` ids (padding after the last segment), the cumulative lengths of its segments
from 0 on, and the positions, which start again at 0 with each segment.

Null texts count as empty and are the end id alone; repeated rows and null ids are packed like
any others. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from billscope.llm import tokens
from billscope.llm.common import documents, each_row, map_batches

BUFFER = 1 << 21
MATRIX = (
    "sequence_id long, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, positions binary,"
    " doc_ids array<long>, starts array<long>"
)


class Rooms:
    """Open rows by free room: a segment tree of how many rows have each room."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``size``, no longer open, and its room."""
        at = self.leaves + size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up, until a right neighbour has rows
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._change(room, -1)
        return self.rows[room].pop(), room

    def _change(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += by
            at >>= 1


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Positions of the pieces in each row; pieces are placed from the longest on."""
    rooms, rows = Rooms(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = rooms.take(sizes[i])
        if found is None:
            rows.append([i])
            rooms.add(length - sizes[i], len(rows) - 1)
        else:
            row, room = found
            rows[row].append(i)
            rooms.add(room - sizes[i], row)
    return rows


def token_matrix(
    docs: DataFrame, path: str, length: int = 2048, end_id: int = 0, pad_id: int = 0, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Rows of packed ids, little-endian unsigned 32-bit; positions take 16 bits where they can."""
    if length < 1:
        raise ValueError("a row needs room for a token")
    small = "<u2" if length <= 1 << 16 else "<u4"

    def work(batches: Iterator[pa.RecordBatch]):
        model = tokens.load(path)
        sequence = TaskContext.get().partitionId() << 33

        def placed(pieces: list[tuple]):
            nonlocal sequence
            for row in best_fit([len(p[2]) for p in pieces], length):
                parts = [pieces[i] for i in row]
                sizes = [len(p[2]) for p in parts]
                edges = [0, *np.cumsum(sizes).tolist()]
                ids = np.full(length, pad_id, "<u4")
                ids[: edges[-1]] = np.concatenate([p[2] for p in parts])
                positions = np.arange(length)
                for a, b in zip(edges, [*edges[1:], length], strict=True):
                    positions[a:b] -= a
                positions = positions.astype(small)
                yield (
                    sequence, edges[-1], len(row), ids.tobytes(), edges, positions.tobytes(),
                    [p[0] for p in parts], [p[1] for p in parts],
                )
                sequence += 1

        held, size = [], 0
        for doc, text in each_row(batches):
            ids = np.append(np.frombuffer(model.encode(text), "<u4"), np.uint32(end_id)).astype("<u4")
            for start in range(0, len(ids), length):
                held.append((doc, start, ids[start : start + length]))
            size += len(ids)
            if size >= BUFFER:
                yield from placed(held)
                held, size = [], 0
        yield from placed(held)

    return map_batches(documents(docs, id_column, text_column), work, MATRIX, 200)


def write_matrix(matrix: DataFrame, path: str) -> None:
    """Keep the rows as binary columns of a Parquet table, in the cluster's own file system."""
    matrix.write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids of each segment of a written matrix, for tests and repairs."""

    def work(batches: Iterator[pa.RecordBatch]):
        for raw, edges, docs, starts in each_row(batches):
            ids = np.frombuffer(raw, "<u4")
            for a, b, doc, start in zip(edges, edges[1:], docs, starts, strict=False):
                yield doc, start, ids[a:b].tobytes()

    return map_batches(
        spark.read.parquet(path).select("ids", "cu_seqlens", "doc_ids", "starts"), work, "doc_id long, start long, ids binary"
    )
