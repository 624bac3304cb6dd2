"""Removal of repeated byte strings by bucket-pointer refinement over anchored suffixes.

A byte goes if some ``length``-byte string that covers it also starts anywhere else. The suffix
at p needs a place only among those that share its first ``length`` bytes, so buckets are refined
to that depth and no further.

* The identifier of the 2k-byte bucket of a suffix combines the identifiers of its k-byte bucket
  and of the one k bytes later, so each doubling reuses the last. Identifiers are 64-bit mixes of
  the content: tasks need no common numbering.
* Suffixes p whose first bytes have their least 16-byte identifier at the same anchor a are one
  range. Equal strings have equal anchors, so ranges stand in the initial bucket of the q bytes
  from a, which lie in all strings of the range. Buckets of one member are done: no repeats.
* A bucket whose ranges are alike to the last byte is done too: all repeat. Only the others are
  refined: a range is cut into groups of ``GROUP`` suffixes, each of which stands in the bucket
  of the bytes that its strings share. Again buckets of one end, buckets of equals repeat, and
  the rest goes down to single suffixes and their ``length``-byte buckets.

A step counts buckets with map-side aggregation and joins the buckets that go on, one row each,
to their members: a bucket with a third of all ranges is a skewed join that Spark splits. Equal
ranges are one variant before they are refined.

Null texts count as empty; texts shorter than ``length`` stay. Repeated rows, also under one id,
are documents of their own. Documents are known by id and text digest, so null and repeated ids
keep their own spans. An empty table gives no rows. Bytes are judged on the input, so overlaps
count and the order of removal plays no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billscope.llm.common import documents, map_arrays, map_batches
from billscope.shared import release, settle

GRAM, GROUP = 16, 8
#: Bytes worked on at once; longer texts pass in tiles that overlap.
TILE = 1 << 18
KEY = ["doc_id", "digest"]
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64((1 << 20) - 1)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Identifier of two buckets in this order."""
    out = first * _ONE
    out ^= out >> np.uint64(29)
    out += second
    out *= _TWO
    out ^= out >> np.uint64(32)
    return out


_BYTES = _pair(np.arange(256, dtype=np.uint64) + np.uint64(1), np.full(256, 77, np.uint64))


class Depths:
    """Bucket sizes that follow from the length of a string."""

    def __init__(self, length: int):
        if length < 32:
            raise ValueError("strings of at least 32 bytes are expected")
        self.length = length
        self.core = 1 << ((2 * length // 3).bit_length() - 1)  # q: bytes from the anchor on
        self.window = length - self.core + 1  # starts of a string with the core inside
        self.kept = {GRAM, self.core, _half(length), _half(length - GROUP + 1)}


    def refine(self, raw: np.ndarray) -> dict[int, np.ndarray]:
        """Identifiers of the buckets of each kept size at every offset."""
        found, ids, k = {}, _BYTES[raw], 1
        while True:
            if k in self.kept:
                found[k] = ids
            if k == max(self.kept):
                return found
            ids, k = _pair(ids[:-k], ids[k:]), 2 * k

    def string(self, ids: dict[int, np.ndarray], at: np.ndarray, short: int = 0) -> np.ndarray:
        """Identifier of the ``length - short`` bytes at each offset."""
        size = self.length - short
        half = ids[_half(size)]
        return _pair(half[at], half[at + (size - _half(size))])


def _half(size: int) -> int:
    """The largest power of two within ``size``; two such buckets cover a string of it."""
    return 1 << (size.bit_length() - 1)


def _least(values: np.ndarray, window: int) -> np.ndarray:
    """Minimum of each run of ``window`` values, by doubling."""
    size, out, k = len(values) - window + 1, values, 1
    while 2 * k <= window:
        out, k = np.minimum(out[:-k], out[k:]), 2 * k
    return np.minimum(out[:size], out[window - k : window - k + size])


def _tiles(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, int]], np.ndarray]]:
    """Blocks of bytes: (row, first start in its text, starts) of each stretch, and their bytes."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        held, parts, size = [], [], 0
        for row in range(batch.num_rows):
            raw = np.frombuffer(texts[row].as_buffer() or b"", np.uint8)
            for first in range(0, len(raw) - length + 1, TILE):
                starts = min(TILE, len(raw) - length + 1 - first)
                if size + starts + length > 2 * TILE:
                    yield batch, held, np.concatenate(parts)
                    held, parts, size = [], [], 0
                held.append((row, first, starts))
                parts.append(raw[first : first + starts + length - 1])
                size += starts + length - 1
        if held:
            yield batch, held, np.concatenate(parts)


def _ranges(batches: Iterator[pa.RecordBatch], depths: Depths) -> Iterator[tuple]:
    """(batch, row, first, n, back, bucket, variant) of all ranges of each block, as arrays."""
    for batch, held, raw in _tiles(batches, depths.length):
        ids = depths.refine(raw)
        rows, firsts, counts = np.array(held, np.int64).T
        begins = np.concatenate([[0], np.cumsum(counts + depths.length - 1)[:-1]])
        item = np.repeat(np.arange(len(held)), counts)
        p = np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[item]
        place = np.arange(len(ids[GRAM]), dtype=np.uint64)
        a = (_least((ids[GRAM] & ~_LOW) | place, depths.window)[p] & _LOW).astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (item[1:] != item[:-1])]))
        tails = np.concatenate([heads[1:], [len(p)]]) - 1
        low, high, a, item = p[heads], p[tails], a[heads], item[heads]
        variant = _pair(depths.string(ids, low), depths.string(ids, high))
        variant = _pair(variant, ((a - low) * 4096 + high - low).astype(np.uint64))
        yield batch, rows[item], low - begins[item] + firsts[item], high - low + 1, a - low, ids[depths.core][a], variant


def _pack(first: np.ndarray, n: np.ndarray, back: np.ndarray) -> np.ndarray:
    return first << 32 | n << 16 | back


def _unpack(at: Column) -> list[Column]:
    return [
        F.shiftrightunsigned(at, 32).alias("first"), F.shiftrightunsigned(at, 16).bitwiseAND(0xFFFF).alias("n"),
        at.bitwiseAND(0xFFFF).alias("back"),
    ]


def spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, digest, spans): merged [start, end) bytes to remove, for rows of :func:`known`."""
    depths = Depths(length)

    def find(batches: Iterator[pa.RecordBatch]):
        for batch, row, first, n, back, bucket, variant in _ranges(batches, depths):
            row = pa.array(row)
            yield [
                batch.column(0).take(row), batch.column(1).take(row), bucket.view(np.int64), variant.view(np.int64),
                _pack(first, n, back),
            ]

    ranges = settle(map_arrays(
        docs.select(*KEY, "text"), find, "doc_id long, digest long, bucket long, variant long, at long"
    ))
    # counts are written before they are joined, so that Spark may split the side of a hot bucket
    shared = settle(
        ranges.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("variant").alias("low"), F.max("variant").alias("high"))
        .where("n > 1").select("bucket", (F.col("low") != F.col("high")).alias("mixed"))
    )
    members = settle(ranges.join(shared, "bucket"))
    release(ranges)
    mixed = members.where("mixed")
    variants = settle(mixed.groupBy("bucket", "variant").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct(*KEY, "at")).alias("one")
    ))
    repeated = mixed.join(variants.where("copies > 1").select("bucket", "variant"), ["bucket", "variant"])
    found = members.where(~F.col("mixed")).select(*KEY, "at").unionByName(repeated.select(*KEY, "at")).select(
        *KEY, *_unpack(F.col("at"))
    ).select(*KEY, F.col("first").alias("start"), (F.col("first") + F.col("n") + F.lit(length - 1)).alias("end"))
    groups = settle(_groups(docs, variants.select("bucket", "variant", "copies", "one.*"), depths))
    found = settle(found.unionByName(_refined(groups, depths)))
    for table in (shared, members, variants, groups):
        release(table)
    return found.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _groups(docs: DataFrame, variants: DataFrame, depths: Depths) -> DataFrame:
    """Groups of suffixes of each variant, with the identifiers of their shared and single strings.

    A group has the suffixes whose distance to the anchor is in [step * GROUP, (step + 1) * GROUP).
    """
    length = depths.length
    wanted = variants.groupBy(*KEY).agg(F.collect_list(F.struct("bucket", "variant", "copies", "at")).alias("wanted"))
    texts = docs.select(*KEY, "text").join(wanted, [docs.doc_id.eqNullSafe(wanted.doc_id), docs.digest == wanted.digest]).select(
        docs.doc_id, docs.digest, "text", "wanted"
    )  # repeated rows come twice here, but theirs are variants with copies, whose number plays no further part

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in range(batch.num_rows):
                raw = np.frombuffer(batch.column(2)[row].as_buffer() or b"", np.uint8)
                wanted = batch.column(3)[row].values
                bucket, variant, copies, at = (wanted.field(i).to_numpy() for i in range(4))
                for start in range(0, len(at), 256):
                    part = slice(start, start + 256)
                    first, n, back = at[part] >> 32, at[part] >> 16 & 0xFFFF, at[part] & 0xFFFF
                    size = n + length - 1
                    begin = np.cumsum(size) - size
                    ids = depths.refine(np.concatenate([raw[f : f + s] for f, s in zip(first, size, strict=True)]))
                    low, high = (back - n + 1) // GROUP, back // GROUP
                    owner = np.repeat(np.arange(len(n)), high - low + 1)
                    step = np.arange(len(owner)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[owner]
                    anchor = begin[owner] + back[owner]
                    p0 = np.maximum(begin[owner], anchor - step * GROUP - GROUP + 1)
                    p1 = np.minimum(begin[owner] + n[owner] - 1, anchor - step * GROUP)
                    core = depths.string(ids, anchor - step * GROUP, GROUP - 1)
                    whole = _pair(depths.string(ids, p0), depths.string(ids, p1))
                    whole = _pair(whole, ((anchor - p0) * 4096 + p1 - p0).astype(np.uint64))
                    every = p0[:, None] + np.arange(GROUP)
                    single = depths.string(ids, np.minimum(every, p1[:, None]))
                    counts = p1 - p0 + 1
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    flat = single[every <= p1[:, None]].view(np.int64)
                    many = pa.array(np.full(len(owner), row))
                    yield [
                        batch.column(0).take(many), batch.column(1).take(many), bucket[part][owner], copies[part][owner],
                        step, core.view(np.int64), whole.view(np.int64), first[owner] + p0 - begin[owner], anchor - p0,
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)).cast(pa.list_(pa.field("element", pa.int64()))),
                    ]

    return map_arrays(
        texts, cut,
        "doc_id long, digest long, bucket long, copies long, step long, core long, whole long, start long, ahead long, single array<long>",
    )


def _refined(groups: DataFrame, depths: Depths) -> DataFrame:
    """Spans of the variants with one copy whose groups or single suffixes repeat."""
    at = ["bucket", "step", "core"]
    shared = settle(
        groups.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high"))
        .where("n > 1").select(*at, (F.col("low") != F.col("high")).alias("mixed"))
    )
    members = groups.join(shared, at)
    equal = members.where(~F.col("mixed") & (F.col("copies") == 1)).select(
        *KEY, "start", (F.col("start") + F.size("single") + F.lit(depths.length - 1)).alias("end")
    )
    # single suffixes: ``ahead`` is their distance to the anchor
    single = members.where("mixed").select(
        *KEY, "bucket", "copies", "start", "ahead", F.posexplode("single").alias("i", "string")
    ).select(
        *KEY, "bucket", "copies", (F.col("start") + F.col("i")).alias("start"), (F.col("ahead") - F.col("i")).alias("ahead"), "string"
    )
    string = ["bucket", "ahead", "string"]
    repeated = settle(single.groupBy(*string).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*string))
    alone = single.where("copies = 1").join(repeated, string).select(
        *KEY, "start", (F.col("start") + F.lit(depths.length)).alias("end")
    )
    return equal.unionByName(alone)


def known(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, digest of the text, text."""
    return documents(docs, id_column, text_column).select("doc_id", F.xxhash64("text").alias("digest"), "text")


def _merge(found: list[dict] | None) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in found or ()):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    return [(a, b) for a, b in merged]


def remove_repeats(
    docs: DataFrame, length: int = 400, id_column: str = "doc_id", text_column: str = "text", keep: str = "bytes"
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and what is left.

    That is ``kept``, the remaining bytes, or with ``keep="text"`` ``text``, the remaining text without characters
    that a border cuts through.
    """
    rows = known(docs, id_column, text_column)
    return cut_spans(rows, spans(rows, length), keep)


def cut_text(text: str, found: list[dict]) -> str:
    """The text without its spans; a character that a border cuts through goes as well."""
    raw = text.encode()
    edges = [0, *[x for span in _merge(found) for x in span], len(raw)]
    return "".join(raw[a:b].decode(errors="ignore") for a, b in zip(edges[::2], edges[1::2], strict=True))


_SPACE = frozenset(b" \t\n\v\f\r")


def passages(raw: bytes, found: list[dict], words: int) -> list[tuple[int, int]]:
    """Merged spans that hold more than ``words`` whole words of the text."""
    kept = []
    for a, b in _merge(found):
        inside = raw[a:b].split()
        cut_first = a > 0 and raw[a - 1] not in _SPACE and raw[a] not in _SPACE
        cut_last = b < len(raw) and raw[b] not in _SPACE and raw[b - 1] not in _SPACE
        if len(inside) - cut_first - (cut_last and not (cut_first and len(inside) == 1)) > words:
            kept.append((a, b))
    return kept


def cut_passages(text: str, found: list[dict], words: int) -> str:
    """The text without its spans of more than ``words`` whole words; shorter ones stay."""
    return cut_text(text, [{"start": a, "end": b} for a, b in passages(text.encode(), found, words)])


def cut_spans(rows: DataFrame, found: DataFrame, keep: str = "bytes") -> DataFrame:
    """Rows without their spans, and what is left as bytes or text."""
    joined = rows.join(found, [rows.doc_id.eqNullSafe(found.doc_id), rows.digest == found.digest], "left").select(
        rows.doc_id, "text", "spans"
    )
    as_text = keep == "text"

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_buffer()
                raw = memoryview(raw) if raw is not None else memoryview(b"")
                gone = _merge(batch.column(2)[i].as_py())
                edges = [0, *[x for span in gone for x in span], len(raw)]
                pieces = [raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
                left = b"".join(pieces)
                rest = "".join(str(p, "utf-8", "ignore") for p in pieces) if as_text else left
                yield (
                    batch.column(0)[i].as_py(), len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), rest
                )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
    return map_batches(joined, work, schema + ("text string" if as_text else "kept binary"), 500)
