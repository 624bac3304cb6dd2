"""Near-duplicate documents by SimHash, with pigeonring candidate filtering.

A fingerprint has a bit set if more than half of the shingle hashes have it. Fingerprints of at
most ``distance`` differing bits are linked, and components of links are groups of copies.

With 64 bits in ``m = distance + 1`` segments on a ring, two linked fingerprints have a segment
from which every chain of l consecutive segments differs in at most ``l * distance / m`` bits.
So the first segment of that chain is equal, and the second differs in at most one bit. Of the
second segment cut into ``parts``, all but one part are then equal as well: fingerprints meet
in buckets of (first segment, second segment without one part). Pairs that meet are held to the
budgets of all chain lengths, and those that pass to the full Hamming distance. ``parts`` grows
with the number of fingerprints, so that buckets stay short; it never changes the result.

Equal fingerprints are one row before any of this. Within a bucket only a spanning forest of the
links leaves the task. The members of a bucket beyond ``BUCKET`` instead meet in balls: two
fingerprints differ in at most d bits only if some value lies within ceil(d/2) of the one and
floor(d/2) of the other, and grouping by that value links them through it - linear in the members.

Null texts count as empty; a text without words has fingerprint zero, which is linked like any
other. Each input row gives one output row, repeated rows and null ids too. A component id is
the smallest id of the component that is not null. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billscope.llm.common import digest, documents, each_row, map_arrays, map_batches
from billscope.llm.components import components
from billscope.shared import settle

BITS = 64
#: Members of a bucket that one task compares with each other.
BUCKET = 2048
SEED = 42


def fingerprint(text: str, words: int) -> int:
    """Unsigned 64-bit fingerprint of word shingles, A-Z in lower case."""
    found = text.encode().lower().split()  # bytes split at the six ASCII separators
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*[found[i:] for i in range(words)], strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), "<u8")
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 4096):
        block = hashes[start : start + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, digest of the text and fp, the fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]):
        for doc, mark, text in each_row(batches):
            value = fingerprint(text, words)
            yield doc, mark, value - (1 << 64) if value >> 63 else value

    rows = documents(docs, id_column, text_column).select("doc_id", digest().alias("digest"), "text")
    return map_batches(rows, work, "doc_id long, digest long, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the distance + 1 segments of the ring."""
    edges = [round(BITS * i / (distance + 1)) for i in range(distance + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def bucket_masks(distance: int, parts: int) -> list[int]:
    """Bits that two fingerprints share in a bucket: one mask per chain start and part left out."""
    ring = segments(distance)
    if distance == 0:
        return [(1 << BITS) - 1]
    masks = []
    for i, (start, size) in enumerate(ring):
        first = ((1 << size) - 1) << start
        start, size = ring[(i + 1) % len(ring)]
        # two segments in a row may differ in floor(2 * distance / (distance + 1)) = 1 bit
        edges = [round(size * k / parts) for k in range(parts + 1)]
        second = ((1 << size) - 1) << start
        for a, b in zip(edges, edges[1:], strict=False):
            masks.append(first | (second & ~(((1 << (b - a)) - 1) << (start + a))))
    return masks


def choose_parts(n: int, distance: int) -> int:
    """Parts of the second segment that keep the mean bucket of n random fingerprints near 16."""
    size = segments(distance)[0][1]
    for parts in range(2, size + 1):
        if n / 2.0 ** (size + size * (parts - 1) / parts) <= 16:
            return parts
    return size


def chains_hold(differing: np.ndarray, distance: int) -> np.ndarray:
    """Whether some chain start keeps every chain length within its share of ``distance``."""
    ring = segments(distance)
    m = len(ring)
    counts = [np.bitwise_count(differing & np.uint64(((1 << size) - 1) << start)) for start, size in ring]
    holds = np.zeros(differing.shape, bool)
    for i in range(m):
        total, fits = np.zeros(differing.shape, np.int16), np.ones(differing.shape, bool)
        for length in range(1, m + 1):
            total += counts[(i + length - 1) % m]
            fits &= total * m <= length * distance
        holds |= fits
    return holds


def forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among unsigned values: (larger, smaller)."""
    root = list(range(len(values)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for start in range(0, len(values), 256):
        block = values[start : start + 256]
        differing = block[:, None] ^ values[None, : start + len(block)]
        near = np.argwhere(chains_hold(differing, distance) & (np.bitwise_count(differing) <= distance))
        for i, j in near.tolist():
            a, b = find(i + start), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((i + start, j))
    return [(int(values[i]), int(values[j])) for i, j in edges]


def links(values: DataFrame, distance: int, limit: int = BUCKET, parts: int | None = None) -> DataFrame:
    """Edges (a, b) whose components are those of all links among distinct ``values`` (fp long)."""
    parts = parts or choose_parts(values.count(), distance)
    masks = [m - (1 << 64) if m >> 63 else m for m in bucket_masks(distance, parts)]
    meeting = values.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("at"),
    ).select("at.*", "fp")
    full = settle(
        meeting.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"))
        .where("n > 1").select("mask", "key", "n")
    )
    members = meeting.join(full, ["mask", "key"])

    def near(batches: Iterator[pa.RecordBatch]):
        # rows of a bucket follow each other
        for group in _groups(batches):
            edges = forest(group, distance)
            if edges:
                a, b = np.array(edges, np.uint64).T
                yield [a.view(np.int64), b.view(np.int64)]

    small = map_arrays(
        members.where(F.col("n") <= limit).repartition("mask", "key").sortWithinPartitions("mask", "key").select("mask", "key", "fp"),
        near, "a long, b long",
    )
    if full.where(F.col("n") > limit).isEmpty():
        return small
    return small.unionByName(_balls(members.where(F.col("n") > limit).select("fp").distinct(), distance))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Fingerprints of one (mask, key) after another, from rows sorted by both."""
    held: list[np.ndarray] = []
    last = None
    for batch in batches:
        mask, key, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        for start, end in itertools.pairwise([0, *cuts.tolist(), len(fp)]):
            if start == end:
                continue
            at = (int(mask[start]), int(key[start]))
            if at != last and held:
                yield np.concatenate(held)
                held = []
            last = at
            held.append(fp[start:end].view(np.uint64))
    if held:
        yield np.concatenate(held)


def _balls(values: DataFrame, distance: int) -> DataFrame:
    """Links through shared ball centres; a centre's members are at most the size of a ball."""
    outer, inner = (distance + 1) // 2, distance // 2
    flips = [sum(1 << b for b in bits) for r in range(outer + 1) for bits in itertools.combinations(range(BITS), r)]
    sizes = np.array(flips, np.uint64)
    near = set(sizes[np.bitwise_count(sizes) <= inner].tolist())

    def work(batches: Iterator[pa.RecordBatch]):
        narrow = np.array([f in near for f in flips])
        for batch in batches:
            for value in batch.column(0).to_numpy().view(np.uint64):
                centres = (value ^ sizes).view(np.int64)
                yield [centres, np.full(len(sizes), value.view(np.int64)), narrow]

    at = settle(map_arrays(values, work, "centre long, fp long, narrow boolean"))
    # a member of the inner ball is linked to every member of the outer one
    hub = at.where("narrow").groupBy("centre").agg(F.min("fp").alias("hub"))
    return at.join(hub, "centre").select(F.col("fp").alias("a"), F.col("hub").alias("b")).where("a <> b").distinct()


def near_duplicates(
    docs: DataFrame, words: int = 4, distance: int = 4, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, digest of the text, fingerprint (16 hex digits) and component_id of every document."""
    known = settle(fingerprints(docs, words, id_column, text_column))
    distinct = settle(known.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(distinct.select("fp"), distance))
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = classes.join(lowest, "root").select("fp", "component_id")
    return known.join(named, "fp").select(
        "doc_id", "digest", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
