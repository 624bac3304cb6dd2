"""Training sequences filled with lexically close documents.

A document is its token ids and an end id. Whole windows of it are sequences of their own; what
is left over, less than a window, is packed. Left-overs are range-partitioned by their two most
telling tokens, so that close ones meet, and each task works through shards of ``SHARD`` of
them: an inverted index holds the BM25 weight of every token in the shard. A seed's ids are the
query; its unused neighbours, best first, fill the seed's window as long as they fit, and the
best one left is cut to close the window. What a shard can't close goes on to the next shard of
the task. The last window of a task is cut into sequences whose lengths are powers of two, which
need no padding.

Document frequencies and lengths are those of all documents; the vocabulary bounds their number.
A task holds one shard, whatever the size of a partition. Equal left-overs are told apart by
their row, so a group of copies spreads over partitions.

Null texts count as empty and are the end id alone. Repeated rows and null ids are packed like
any others: each id of each row lies in exactly one piece. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billscope.llm import tokens
from billscope.llm.common import documents, each_row, map_arrays, map_batches
from billscope.shared import settle

SHARD = 512
#: Tokens in at least this many members of a shard have a full row of weights instead of postings.
DENSE = 16
#: Tokens of left-overs in a partition, on average.
PARTITION_TOKENS = 1 << 20
K1, B = 1.2, 0.75
PIECE = "sequence_id long, offset long, doc_id long, start long, length long, doc_tokens long, ids binary"


def tokenized(docs: DataFrame, path: str, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ids of the whole text with the end id; 16-bit where the vocabulary allows."""

    def work(batches: Iterator[pa.RecordBatch]):
        model = tokens.load(path)
        wide = model.tokenizer.get_vocab_size() > 1 << 16
        for doc, text in each_row(batches):
            ids = np.frombuffer(model.encode(text), "<u4")
            yield doc, wide, np.append(ids, end_id).astype("<u4" if wide else "<u2").tobytes()

    return map_batches(documents(docs, id_column, text_column), work, "doc_id long, wide boolean, ids binary", 200)


def _ids(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4", copy=False)


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids in rising order and how often each occurs; one plain sort, as ``numpy.unique`` costs several for short arrays."""
    ids = np.sort(ids)
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    return ids[first], np.diff(first, append=len(ids))


@dataclass(frozen=True)
class Corpus:
    """Numbers of all documents that BM25 needs."""

    documents: int
    tokens: int
    idf: np.ndarray

    @property
    def mean_length(self) -> float:
        return self.tokens / max(1, self.documents)


def corpus(rows: DataFrame) -> Corpus:
    """Document frequency of each token over whole documents; one row per token comes back."""

    def work(batches: Iterator[pa.RecordBatch]):
        counts, n, total = np.zeros(1 << 16, np.int64), 0, 0
        for wide, raw in each_row(batches):
            ids = _ids(raw, wide)
            n, total, seen = n + 1, total + len(ids), distinct(ids)[0]
            if len(seen) and seen[-1] >= len(counts):
                counts = np.concatenate([counts, np.zeros(int(seen[-1]) + 1 - len(counts), np.int64)])
            counts[seen] += 1
        found = np.flatnonzero(counts)
        yield [np.concatenate([[-1, -2], found]), np.concatenate([[n, total], counts[found]])]

    parts = map_arrays(rows.select("wide", "ids"), work, "token long, n long")
    found = {r.token: r.n for r in parts.groupBy("token").agg(F.sum("n").alias("n")).collect()}
    n, total = found.pop(-1, 0), found.pop(-2, 0)
    idf = np.zeros(max(found, default=0) + 1)
    for token, df in found.items():
        idf[token] = math.log(1 + (n - df + 0.5) / (df + 0.5))
    return Corpus(n, total, idf)


class Index:
    """BM25 inverted index of one shard.

    Tokens are numbered by their place among the shard's tokens. Frequent ones are rows of a matrix
    of weights, at most ``window * SHARD / DENSE`` of them; the others are postings sorted by token.
    """

    def __init__(self, shard: list[np.ndarray], numbers: Corpus):
        size, lengths = len(shard), np.array([len(ids) for ids in shard])
        # one sort of (member, token) serves all members
        pair = np.repeat(np.arange(size) << 32, lengths) | np.concatenate(shard)
        pair, tf = np.unique(pair, return_counts=True)
        owner, token = pair >> 32, pair & 0xFFFFFFFF
        length = lengths[owner]
        weight = numbers.idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / numbers.mean_length))
        names, term, count = np.unique(token, return_inverse=True, return_counts=True)
        row = np.where(count >= DENSE, np.cumsum(count >= DENSE) - 1, -1)
        dense = row[term] >= 0
        self.size, self.rows = size, np.zeros((int(row.max(initial=-1)) + 1, size), np.float32)
        self.rows[row[term[dense]], owner[dense]] = weight[dense]
        order = np.flatnonzero(~dense)[np.argsort(term[~dense], kind="stable")]
        self.owner, self.weight = owner[order], weight[order]
        sizes = np.where(row >= 0, 0, count)
        self.low, self.sizes = np.cumsum(sizes) - sizes, sizes
        # per member: rows of its frequent tokens, numbers of its other tokens
        bounds = np.searchsorted(owner, np.arange(1, size))
        self.frequent = [r[r >= 0] for r in np.split(row[term], bounds)]
        self.rare = [t[self.sizes[t] > 0] for t in np.split(term, bounds)]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every member for the ids of the seed as query."""
        rare = self.rare[seed]
        sizes = self.sizes[rare]
        at = np.repeat(self.low[rare] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return np.bincount(self.owner[at], self.weight[at], self.size) + self.rows[self.frequent[seed]].sum(0)


def fill(items: list[tuple], window: int, numbers: Corpus) -> tuple[list[list[tuple]], list[tuple]]:
    """Closed windows of (doc, doc_tokens, start, ids) and the items that no window took.

    The last, open window's items come back unused.
    """
    if not items:
        return [], []
    index = Index([item[3] for item in items], numbers)
    rest: list[tuple | None] = list(items)
    # ids left of each item; those that are used up leave the rankings before they are walked
    size = np.array([len(item[3]) for item in items])
    closed, total = [], int(size.sum())
    for seed in range(len(items)):
        if rest[seed] is None:
            continue
        if total < window:
            break
        taken, room = [rest[seed]], window - len(rest[seed][3])
        rest[seed], size[seed] = None, 0
        if room:
            live = np.flatnonzero(size)
            ranked = live[np.argsort(-index.scores(seed)[live], kind="stable")]
            for i in ranked[size[ranked] <= room].tolist():
                if size[i] <= room:
                    taken.append(rest[i])
                    room -= int(size[i])
                    rest[i], size[i] = None, 0
                    if not room:
                        break
            if room:
                i = int(ranked[size[ranked] > 0][0])
                doc, doc_tokens, start, ids = rest[i]
                taken.append((doc, doc_tokens, start, ids[:room]))
                rest[i], size[i] = (doc, doc_tokens, start + room, ids[room:]), size[i] - room
        closed.append(taken)
        total -= window
    return closed, [item for item in rest if item is not None]


def powers_of_two(items: list[tuple]) -> list[list[tuple]]:
    """The items in order, cut into sequences whose lengths are the powers of two of their sum."""
    total = sum(len(item[3]) for item in items)
    sizes = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
    found: list[list[tuple]] = []
    left = list(reversed(items))
    for size in sizes:
        taken = []
        while size:
            doc, doc_tokens, start, ids = left.pop()
            taken.append((doc, doc_tokens, start, ids[:size]))
            if len(ids) > size:
                left.append((doc, doc_tokens, start + size, ids[size:]))
            size -= len(taken[-1][3])
        found.append(taken)
    return found


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: sequence_id, offset in it, doc_id, start in its document, length, doc_tokens and ids.

    ``ids`` are little-endian unsigned 32-bit; the pieces of a sequence are gapless from offset 0.
    """
    rows = settle(tokenized(docs, path, end_id, id_column, text_column))
    numbers = corpus(rows)

    def windows(batches: Iterator[pa.RecordBatch]):
        sequence = TaskContext.get().partitionId() << 33
        for doc, wide, raw in each_row(batches):
            ids = _ids(raw, wide)
            for start in range(0, len(ids) - window + 1, window):
                yield sequence, 0, doc, start, window, len(ids), ids[start : start + window].tobytes()
                sequence += 2  # even numbers; those of packed sequences are odd

    def left_over(batches: Iterator[pa.RecordBatch]):
        for row, doc, wide, raw in each_row(batches):
            ids = _ids(raw, wide)
            start = len(ids) - len(ids) % window
            if start < len(ids):
                seen, counts = distinct(ids[start:])
                told = numbers.idf[seen] * counts
                best = int(told.argmax())
                told[best] = -1.0
                second = int(told.argmax()) if len(told) > 1 else best
                yield int(seen[best]), int(seen[second]), row, doc, len(ids), start, wide, raw[start * (4 if wide else 2) :]

    def packed(batches: Iterator[pa.RecordBatch]):
        sequence = (TaskContext.get().partitionId() << 33) + 1

        def written(found: list[list[tuple]]):
            nonlocal sequence
            for taken in found:
                offset = 0
                for doc, doc_tokens, start, ids in taken:
                    yield sequence, offset, doc, start, len(ids), doc_tokens, ids.tobytes()
                    offset += len(ids)
                sequence += 2

        held: list[tuple] = []
        for doc, doc_tokens, start, wide, raw in each_row(batches):
            held.append((doc, doc_tokens, start, _ids(raw, wide)))
            if len(held) >= SHARD:
                closed, held = fill(held, window, numbers)
                yield from written(closed)
        while sum(len(item[3]) for item in held) >= window:
            closed, held = fill(held, window, numbers)
            yield from written(closed)
        yield from written(powers_of_two(held))

    parts = max(1, numbers.tokens // PARTITION_TOKENS)
    rest = map_batches(
        rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "wide", "ids"), left_over,
        "first long, second long, row long, doc_id long, doc_tokens long, start long, wide boolean, ids binary", 500,
    ).repartitionByRange(parts, "first", "second", "row").sortWithinPartitions("first", "second", "row")
    small = map_batches(rest.select("doc_id", "doc_tokens", "start", "wide", "ids"), packed, PIECE, 500)
    return map_batches(rows, windows, PIECE, 500).unionByName(small)
