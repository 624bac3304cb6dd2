"""Byte-level BPE encoding and decoding by backtracking over longest matches.

The bytes of a piece are read as Latin-1, so that an Aho-Corasick automaton over the vocabulary
finds every token at every offset. Encoding walks along the piece with the longest token first.
A token may follow its neighbour only if the two are compatible: merging the bytes of both gives
these two tokens again. A sequence in which all neighbours are compatible is the one that merging
by rank gives. If no token at an offset fits, the last one is taken back and its next shorter
match tried; an offset from which nothing fitted is not visited again, so the walk is linear in
the piece. Compatibility is remembered for each pair of tokens.

Null texts count as empty: no ids, an empty decoding. Rows keep their ids, null ones and repeated
ones too; an empty table gives no rows. Long texts and long pieces need memory in their own
proportion.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from billscope.llm.common import documents, each_row, map_batches

#: Pieces and token pairs remembered in one Python worker.
REMEMBERED_PIECES, REMEMBERED_PAIRS = 250_000, 500_000

_loaded: dict[str, BytePairs] = {}


class BytePairs:
    """Encoder and decoder of a rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.token = {i: b for b, i in self.ranks.items()}
        self.pieces_of = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        known, ids = self.known, []
        for piece in self.pieces_of(text):
            found = known.get(piece)
            if found is None:
                if len(known) >= REMEMBERED_PIECES:
                    known.clear()
                found = known[piece] = tuple(self.piece(piece.encode()))
            ids += found
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one piece; a piece that is a token itself is that token."""
        if raw in self.ranks:
            return [self.ranks[raw]]
        starts: list[list[tuple[int, int]]] = [[] for _ in raw]
        for end, (rank, length) in self.automaton.iter(raw.decode("latin-1")):
            starts[end - length + 1].append((length, rank))
        for found in starts:
            found.sort()
        path: list[tuple[int, int]] = []  # offset and id of each token taken
        left: list[list[tuple[int, int]]] = []  # shorter matches still to try at each of them
        dead = bytearray(len(raw) + 1)
        at, choices = 0, starts[0]
        while at < len(raw):
            last = path[-1][1] if path else None
            while choices:
                length, rank = choices.pop()
                if not dead[at + length] and (last is None or self.compatible(last, rank)):
                    path.append((at, rank))
                    left.append(choices)
                    at += length
                    choices = starts[at] if at < len(raw) else []
                    break
            else:
                dead[at] = 1
                at, _ = path.pop()
                choices = left.pop()
        return [rank for _, rank in path]

    def compatible(self, first: int, second: int) -> bool:
        found = self.pairs.get((first, second))
        if found is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            found = self.pairs[first, second] = self.merged(self.token[first] + self.token[second]) == [first, second]
        return found

    def merged(self, raw: bytes) -> list[int]:
        """Merging by rank, leftmost first, on the few bytes of two tokens."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, len(self.ranks)) for a, b in zip(parts, parts[1:], strict=False)]
            least = min(ranks)
            if least == len(self.ranks):
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]


def load(path: str, pattern: str) -> BytePairs:
    if path not in _loaded:
        _loaded[path] = BytePairs(path, pattern)
    return _loaded[path]


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and the ids of its whole text, as little-endian unsigned 32-bit bytes."""

    def work(batches: Iterator[pa.RecordBatch]):
        model = load(path, pattern)
        for doc, text in each_row(batches):
            yield doc, np.array(model.encode(text), "<u4").tobytes()

    return map_batches(documents(docs, id_column, text_column), work, "doc_id long, ids binary", 200)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes its ids stand for, from rows of :func:`encode`."""

    def work(batches: Iterator[pa.RecordBatch]):
        model = load(path, pattern)
        for doc, ids in each_row(batches):
            yield doc, model.decode(np.frombuffer(ids or b"", "<u4").tolist())

    return map_batches(encoded.select("doc_id", "ids"), work, "doc_id long, decoded binary", 200)


def round_trip(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Digests of both directions: n_tokens, ids_sha256 and decoded_sha256 for each document.

    Ids are encoded and decoded in one visit to a document, so nothing but digests leaves it.
    """

    def work(batches: Iterator[pa.RecordBatch]):
        model = load(path, pattern)
        for doc, text in each_row(batches):
            ids = model.encode(text)
            written = " ".join(map(str, ids)).encode()
            yield doc, len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(model.decode(ids)).hexdigest()

    return map_batches(
        documents(docs, id_column, text_column), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
