"""Hard negatives by a vertical scan of columns (BOND).

Vectors are multiplied by ``scale`` and rounded down to integers. Sorted by label they are cut into
blocks of ``BLOCK`` rows, stored dimension by dimension with each dimension's least and greatest value;
anchors are cut into packs of ``PACK``. A task holds one pack and one block. Each block moves once per
search, packs move to the blocks.

For an anchor, a block's dimensions are read in the order of the anchor's falling magnitudes, a few
at a time. What the unread dimensions can still add to a score lies between the sums of their least
and greatest products, so a candidate's score is known within bounds, and the bitmap of candidates
shrinks as they close in:

* for positives (rows of the anchor's label), what can't reach the k-th best lower bound goes;
* for negatives, what lies outside every window of the anchor's positives goes, as well as what can't
  reach the k-th best lower bound of those that are surely inside a window.

What is left when all dimensions are read has exact scores. The k-th best score of the blocks that a
task has seen is the least that the next block must reach. The best of each block are ranked again
over all blocks, which are at most k rows each.

Rows with a null label, vector or component, a non-finite component or an empty vector take no part.
Only vectors of one dimension meet. Repeated rows are rows of their own: a copy of the anchor's row is
one of its other rows, and a repeated anchor has results of its own. Higher scores come first, ties
go to the smaller id, null ids last; the id 2**63 - 1 counts as null. Rows without an id are no anchors.
Components of any size are exact: long ones are multiplied as Python integers, and a product
that doesn't fit in a long counts as the nearest long. An empty table gives no rows. Of columns with
clashing names only those asked for play a part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billscope.llm.common import each_row, map_batches, pick
from billscope.shared import release, settle

BLOCK, PACK = 2048, 128
#: Dimensions read between two looks at the bitmap.
STRIDE = 8
#: Components up to this size are plain; scans of plain rows are exact in floating point.
PLAIN = 2.0**24
#: Whole numbers below this are exact in single precision.
SINGLE = 2.0**24
#: (pack, block) pairs of a task, about.
TASK_PAIRS = 32
NO_ID = (1 << 63) - 1
MOST, LEAST = (1 << 63) - 1, -(1 << 63)
VECTORS = "dim int, part long, first string, last string, row array<long>, id array<long>, label array<string>, matrix binary"


def vectors(df: DataFrame, anchors: str, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """row (a number of its own), id, label, dim, x and whether the row is an anchor."""
    rows = pick(df, vec_id=id_column, label=label_column, x=vector_column)
    kept = rows.where("label is not null and x is not null").select(
        "vec_id", "label", F.expr(anchors).alias("anchor"), F.col("x").cast("array<double>").alias("x")
    ).where((F.size("x") > 0) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    return kept.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.col("label").cast("string").alias("label"), F.size("x").alias("dim"), "x",
        (F.col("vec_id").isNotNull() & F.coalesce("anchor", F.lit(False))).alias("anchor"),
    )


def blocks(rows: DataFrame, size: int, extra: str = "") -> DataFrame:
    """Up to ``size`` rows (dim, label, row, id, x, extra) as one, neighbours in the order of their labels."""
    parts = max(1, -(-rows.count() // (4 * size)))
    names = [c.split()[0] for c in extra.split(",") if c]
    ordered = rows.repartitionByRange(parts, "dim", "label", "row").sortWithinPartitions("dim", "label", "row")

    def work(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 33, []
        for row in each_row(batches, 1000):
            if held and (row[0] != held[0][0] or len(held) == size):
                yield _block(number, held)
                number, held = number + 1, []
            held.append(row)
        if held:
            yield _block(number, held)

    schema = VECTORS + "".join(f", {c.split()[0]} array<{c.split()[1]}>" for c in extra.split(",") if c)
    return map_batches(ordered.select("dim", "label", "row", "id", "x", *names), work, schema, 4)


def _block(number: int, held: list[tuple]) -> tuple:
    dim, label, row, ids, x, *more = zip(*held, strict=True)
    return dim[0], number, label[0], label[-1], row, ids, label, np.array(x, "<f8").tobytes(), *more


class Vectors:
    """The rows of a pack or block."""

    def __init__(self, row: list, ids: list, label: list, matrix: bytes, scale: int):
        self.row, self.id, self.label = np.array(row, np.int64), np.array(ids, np.int64), label
        self.scale, self.raw = scale, np.frombuffer(matrix, "<f8").reshape(len(row), -1)
        with np.errstate(over="ignore"):
            self.scaled = np.floor(scale * self.raw)
        self.plain = np.abs(self.scaled).max(1) <= PLAIN

    def long_integers(self, i: int) -> list[int]:
        """Components as integers of any size; a product that passes all doubles is one of whole numbers."""
        products = [(v, self.scale * v) for v in self.raw[i].tolist()]
        return [math.floor(s) if math.isfinite(s) else int(v) * self.scale for v, s in products]


class Columns(Vectors):
    """A block, with a row per dimension of its plain rows, and the bitmap of each label."""

    def __init__(self, *args):
        super().__init__(*args)
        self.at, self.long = np.flatnonzero(self.plain), np.flatnonzero(~self.plain)
        columns = np.ascontiguousarray(self.scaled[self.at].T)
        self.most = np.abs(columns).max(initial=0.0)
        self.low, self.high = (columns.min(1), columns.max(1)) if len(self.at) else (np.zeros(len(columns)),) * 2
        # single precision holds sums of whole numbers below 2**24, double precision below 2**53
        self.columns, self.short = columns, columns.astype(np.float32) if self.most < SINGLE else None
        names, codes = np.unique(np.array(self.label, object), return_inverse=True)
        self.labels = {name: codes == i for i, name in enumerate(names.tolist())}
        self.nothing = np.zeros(len(codes), bool)

    def of_label(self, label: str) -> np.ndarray:
        return self.labels.get(label, self.nothing)


Keep = Callable[[np.ndarray, np.ndarray], np.ndarray]


def scan(anchor: Vectors, i: int, block: Columns, wanted: np.ndarray, keep: Keep) -> tuple[np.ndarray, list[int]]:
    """Rows of the block that ``keep`` leaves over, among the ``wanted`` ones, and their exact scores."""
    q = anchor.scaled[i]
    # no sum of some products, bounds included, passes this
    reach = np.abs(q).sum() * max(block.most, 1.0) if anchor.plain[i] else np.inf
    easy = reach < 2.0**52
    alive = np.flatnonzero(wanted[block.at]) if easy else np.empty(0, np.int64)
    hard = [j for j in (block.long if easy else range(len(wanted))) if wanted[j]]
    columns, kind = (block.short, np.float32) if block.short is not None and reach < SINGLE else (block.columns, np.float64)
    partial = np.zeros(len(alive), kind)
    if len(alive):
        order = np.argsort(-np.abs(q), kind="stable")
        ends = q * block.low, q * block.high
        # what the dimensions from a place in the order on can add, at least and at most
        rest = [np.append(np.cumsum(ends_of(*ends)[order][::-1])[::-1], 0.0).astype(kind) for ends_of in (np.minimum, np.maximum)]
        weights, done = q.astype(kind), 0
        while done < len(q) and len(alive):
            # the first half decides little
            dims = order[done : max(len(q) // 2, done + STRIDE)]
            read = columns[dims] if len(alive) == columns.shape[1] else columns[np.ix_(dims, alive)]
            partial += weights[dims] @ read
            done += len(dims)
            stay = keep(partial + rest[0][done], partial + rest[1][done])
            if not stay.all():
                alive, partial = alive[stay], partial[stay]
    found, scores = block.at[alive], partial.astype(np.int64).tolist()
    if hard:
        mine = anchor.long_integers(i)
        for j in hard:
            score = sum(a * b for a, b in zip(mine, block.long_integers(j), strict=True))
            scores.append(max(LEAST, min(MOST, score)))
        found = np.concatenate([found, np.array(hard, np.int64)])
    return found, scores


def keep_best(k: int, bar: int) -> Keep:
    """Candidates that may be among the k best; ``bar`` is the k-th best score of earlier blocks."""

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if len(low) <= k:
            return high >= bar
        return high >= max(bar, np.partition(low, -k)[-k])

    return keep


def keep_windows(windows: list[tuple[int, int]], k: int) -> Keep:
    """Candidates that may be among the k best of a window."""
    floor, ceiling = min(w[0] for w in windows), max(w[1] for w in windows)

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        near = np.flatnonzero((high >= floor) & (low <= ceiling))
        below, above, useful = low[near], high[near], np.zeros(len(near), bool)
        for least, most in windows:
            inside = below[(below >= least) & (above <= most)]
            bar = max(least, np.partition(inside, -k)[-k]) if len(inside) >= k else least
            useful |= (above >= bar) & (below <= most)
        stay = np.zeros(len(low), bool)
        stay[near[useful]] = True
        return stay

    return keep


class Bars:
    """The k-th best score so far of each key, over the blocks of a task."""

    def __init__(self, k: int):
        self.k, self.scores = k, {}

    def bar(self, key: tuple, least: int = LEAST) -> int:
        held = self.scores.get(key, ())
        return max(least, held[-1]) if len(held) == self.k else least

    def add(self, key: tuple, scores: list[int]) -> None:
        self.scores[key] = sorted([*self.scores.get(key, ()), *scores], reverse=True)[: self.k]


def best(found: np.ndarray, scores: list[int], ids: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """(id, score) of the k highest scores, ties by id."""
    order = sorted(zip([-s for s in scores], ids[found].tolist(), strict=True))[:k]
    return ((i, -s) for s, i in order)


def window(score: int, at_least: int, at_most: int) -> tuple[int, int]:
    """Least and greatest score s with at_least * score <= 100 * s <= at_most * score."""
    return -(-at_least * score // 100), at_most * score // 100


def hard_negatives(
    df: DataFrame, anchors: str, positives: int = 5, negatives: int = 3, at_least: int = 50, at_most: int = 95, scale: int = 256,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``anchors`` is an SQL condition on vec_id and label. For each of the ``positives`` best rows of an
    anchor's label, the ``negatives`` best rows of other labels whose score is from ``at_least`` to
    ``at_most`` percent of the positive's.
    """
    rows = settle(vectors(df, anchors, id_column, vector_column, label_column))
    asked = rows.where("anchor")
    columns = settle(_numbered(blocks(rows, BLOCK)))
    first = settle(blocks(asked, PACK))
    # blocks that hold a label of the pack
    near = (F.col("first") <= F.col("b_last")) & (F.col("b_first") <= F.col("last"))
    found = settle(_ranked(_pairs(first, columns, near, _find_positives(positives, scale), "row long, other long, score long"), ["row"], positives))
    given = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "score"))).alias("p"))
    ready = asked.join(given, "row").select(
        "dim", "label", "row", "id", "x", F.col("p.score").alias("scores"), F.col("p.other").alias("others")
    )
    second = settle(blocks(ready, PACK, "scores array<long>,others array<long>"))
    # only blocks of nothing but the pack's one label can't hold a negative
    far = ~((F.col("first") == F.col("last")) & (F.col("b_first") == F.col("b_last")) & (F.col("first") == F.col("b_first")))
    mined = _ranked(
        _pairs(
            second, columns, far, _find_negatives(negatives, at_least, at_most, scale),
            "row long, place int, anchor_id long, positive_id long, positive_score long, other long, score long",
        ),
        ["row", "place"], negatives,
    )
    out = mined.select(
        "anchor_id", F.nullif("positive_id", F.lit(NO_ID)).alias("positive_id"), "rank",
        F.nullif("other", F.lit(NO_ID)).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
    release(first)
    return out


def _numbered(found: DataFrame) -> DataFrame:
    return found.select("dim", F.col("part").alias("block"), *[F.col(c).alias(f"b_{c}") for c in ("first", "last", "row", "id", "label", "matrix")])


def _pairs(packs: DataFrame, columns: DataFrame, meet, work, schema: str) -> DataFrame:
    """``work`` on every (pack, block) of one dimension that meet.

    Narrow rows of packs and blocks are paired first; then packs go where their blocks are.
    """
    narrow = packs.select("dim", "part", "first", "last").join(columns.select("dim", "block", "b_first", "b_last"), "dim").where(meet)
    pairs = settle(narrow.select("dim", "part", "block"))
    count = max(1, -(-pairs.count() // TASK_PAIRS))
    moved = pairs.join(packs, ["dim", "part"]).repartition(count, "dim", "block")
    both = moved.join(columns.repartition(count, "dim", "block"), ["dim", "block"])
    mine = [c for c in packs.columns if c not in ("dim", "part", "first", "last")]
    return map_batches(both.select(*mine, "b_row", "b_id", "b_label", "b_matrix"), work, schema)


def _find_positives(k: int, scale: int):
    def work(batches: Iterator[pa.RecordBatch]):
        bars = Bars(k)
        for row, ids, label, matrix, *block in each_row(batches, 1):
            anchors, held = Vectors(row, ids, label, matrix, scale), Columns(*block, scale)
            for i, mine in enumerate(row):
                same = held.of_label(label[i]) & (held.row != mine)
                if same.any():
                    found, exact = scan(anchors, i, held, same, keep_best(k, bars.bar((mine,))))
                    near = list(best(found, exact, held.id, k))
                    bars.add((mine,), [score for _, score in near])
                    yield from ((mine, other, score) for other, score in near)

    return work


def _find_negatives(k: int, at_least: int, at_most: int, scale: int):
    def work(batches: Iterator[pa.RecordBatch]):
        bars = Bars(k)
        for row, ids, label, matrix, scores, others, *block in each_row(batches, 1):
            anchors, held = Vectors(row, ids, label, matrix, scale), Columns(*block, scale)
            for i, mine in enumerate(row):
                windows = []
                for place, score in enumerate(scores[i]):
                    least, most = window(score, at_least, at_most)
                    windows.append((bars.bar((mine, place), least), most))
                open_ = [w for w in windows if w[0] <= w[1]]
                other_label = ~held.of_label(label[i])
                if not open_ or not other_label.any():
                    continue
                found, exact = scan(anchors, i, held, other_label, keep_windows(open_, k))
                for place, (least, most) in enumerate(windows):
                    inside = [j for j, s in enumerate(exact) if least <= s <= most]
                    near = list(best(found[inside], [exact[j] for j in inside], held.id, k))
                    if near:
                        bars.add((mine, place), [score for _, score in near])
                    yield from ((mine, place, ids[i], others[i][place], scores[i][place], other, score) for other, score in near)

    return work


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
