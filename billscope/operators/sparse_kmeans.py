"""K-means of sparse rows given as a long table (row, term, weight), with all starts at once.

Neither the vocabulary nor the centres pass through the driver. Terms are dealt into blocks and rows into
groups; a cell holds the weights of one group's rows at one block's terms. A round sends the labels of all rows
to each block. Its task adds up the centres of the block's terms, and then multiplies them with the same
cells; each group adds the products of its blocks and labels its rows anew. So a centre never leaves the task of
its block, and the driver sees one row of counts and costs per group.

A task holds the centres of one block, ``BLOCK_TERMS`` terms on average, and one group's products. Cells come
twice, for the sums and for the products, and none is kept. Work and shuffles of a round grow with the weights
and with rows times blocks.

Starts are drawn by k-means++ over all rows. A run rests when no row changes its cluster, or after ``most_rounds``
rounds. A cluster that loses all its rows is gone, and with fewer different rows than ``k`` there are fewer clusters.
Rows without any weight stand at zero and take part. Equal distances go to the smaller number of cluster.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billscope.operators.keyed import attach
from billscope.shared import release, settle, ship

#: Terms of a block and rows of a group, on average.
BLOCK_TERMS = 1 << 17
GROUP_ROWS = 1 << 13
CELL = "block int, group int, rows binary, starts binary, places binary, weights binary"
STATE = "group int, rows binary, labels binary, distances binary, changed binary, cost binary, size binary, pick binary, key binary"
#: Weights whose products are held at once.
STRETCH = 1 << 16


def _cells(weights: DataFrame, row: str, term: str, weight: str, blocks: int, groups: int) -> DataFrame:
    """Cells as compressed rows; a term has a place in its block."""
    block = F.pmod(F.xxhash64(term), F.lit(blocks)).cast("int")
    terms = weights.groupBy(term).agg(F.count(F.lit(1)).alias("_rows")).withColumn("block", block)
    placed = terms.withColumn("place", (F.row_number().over(Window.partitionBy("block").orderBy(term)) - 1).cast("int"))
    long = attach(weights.select(row, term, weight), [term], placed, check=False)
    long = long.select("block", _group(row, groups), F.col(row).cast("long").alias("r"), "place", F.col(weight).cast("double").alias("w"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        r, place, w = (table.column(c).to_numpy() for c in ("r", "place", "w"))
        order = np.lexsort((place, r))
        rows, starts = np.unique(r[order], return_index=True)
        blobs = rows, starts.astype(np.int64), place[order].astype(np.int32), w[order]
        cells = [pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([b.tobytes()]) for b in blobs]
        return pa.Table.from_arrays(cells, names=["block", "group", "rows", "starts", "places", "weights"])

    return long.groupBy("block", "group").applyInArrow(pack, CELL)


def _group(row: str, groups: int):
    return F.pmod(F.xxhash64(F.col(row).cast("long")), F.lit(groups)).cast("int").alias("group")


def _first(rows: DataFrame, row: str, groups: int, runs: int, seed: int) -> DataFrame:
    """All rows of each group, without clusters."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        own = np.sort(table.column("r").to_numpy())
        nothing = np.zeros(runs)
        return pa.Table.from_batches([
            _state(key[0].as_py(), own, np.full((len(own), runs), -1), np.ones((len(own), runs)), nothing, nothing, nothing, seed, 0)
        ])

    numbered = rows.select(_group(row, groups), F.col(row).cast("long").alias("r"))
    return numbered.groupBy("group").applyInArrow(pack, STATE)


def _mixed(rows: np.ndarray, run: int, seed: int) -> np.ndarray:
    """Even numbers between 0 and 1 from row, run and seed."""
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64) + np.uint64((seed * 1_000_003 + run) % (1 << 63)) * np.uint64(0x9E3779B97F4A7C15)
        for _ in range(2):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def _state(
    group: int, rows: np.ndarray, labels: np.ndarray, distances: np.ndarray, changed: np.ndarray, cost: np.ndarray, size: np.ndarray, seed: int, step: int
) -> pa.RecordBatch:
    """A group's rows with their clusters; ``pick`` and ``key`` are its draw of a next centre, by squared distance, for each run."""
    pick, key = np.full(labels.shape[1], -1, np.int64), np.full(labels.shape[1], np.inf)
    for run in range(labels.shape[1]):
        with np.errstate(divide="ignore"):
            late = np.where(distances[:, run] > 1e-12, -np.log(_mixed(rows, run, seed + step)) / distances[:, run], np.inf)
        at = late.argmin()
        if late[at] < np.inf:
            pick[run], key[run] = rows[at], late[at]
    blobs = rows.astype(np.int64), labels.astype(np.int16), distances, changed.astype(np.int64), cost, size.astype(float), pick, key
    return pa.RecordBatch.from_arrays(
        [pa.array([group], pa.int32()), *[pa.array([np.ascontiguousarray(b).tobytes()]) for b in blobs]], names=[c.split()[0] for c in STATE.split(", ")]
    )


def _products(cells: DataFrame, state: DataFrame, sizes: np.ndarray, moving: list[int], picks: np.ndarray | None, blocks: int, groups: int) -> DataFrame:
    """For each cell: products of its rows with all centres of the moving runs, and for each block and group the centres' squares.

    ``sizes`` is the number of rows of each (run, cluster). With ``picks``, a centre is the row picked for it.
    """
    runs, k = sizes.shape
    width = len(moving) * k
    count = np.maximum(sizes[moving].ravel(), 1)

    def labelled(rows: np.ndarray, labels: bytes | None) -> np.ndarray:
        """Cluster of each row in the moving runs, -1 where it is in none."""
        if picks is None:
            return np.frombuffer(labels, np.int16).reshape(len(rows), runs)[:, moving].astype(np.int64)
        out = np.full((len(rows), len(moving)), -1, np.int64)
        for i, run in enumerate(moving):
            for c in range(k):
                out[rows == picks[run, c], i] = c
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, centres = None, None, None

        def written(group: int, rows: np.ndarray, values: np.ndarray, squares: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([group], pa.int32()), *[pa.array([x.tobytes()]) for x in (rows, values, squares)]], names=["group", "rows", "s", "squares"]
            )

        nothing = np.zeros(0)
        for batch in batches:
            for block, turn, group, kind, rows, starts, places, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    now, centres = block, np.zeros((0, width))
                if kind == 0:  # the clusters of the group's rows come before its cell
                    known = np.frombuffer(rows, np.int64), labelled(np.frombuffer(rows, np.int64), starts)
                    continue
                if kind == 2:  # after the block's sums, before its products
                    centres = centres / count
                    squares = (centres**2).sum(0)
                    for g in range(groups):
                        yield written(g, np.zeros(0, np.int64), nothing, squares)
                    continue
                mine, starts = np.frombuffer(rows, np.int64), np.frombuffer(starts, np.int64)
                place, weight = np.frombuffer(places, np.int32), np.frombuffer(weights)
                if turn == 0:
                    high = int(place.max()) + 1
                    if high > len(centres):
                        centres = np.vstack([centres, np.zeros((high - len(centres), width))])
                    in_all = known[1][np.searchsorted(known[0], mine)]
                    each = np.repeat(in_all, np.diff(np.append(starts, len(place))), axis=0)
                    for i in range(len(moving)):
                        some = each[:, i] >= 0
                        if some.any():
                            at = place[some].astype(np.int64) * k + each[some, i]
                            centres[:high, i * k : (i + 1) * k] += np.bincount(at, weight[some], high * k).reshape(high, k)
                else:
                    out = np.zeros((len(mine), width))
                    ends = np.append(starts, len(place))
                    low = 0
                    while low < len(mine):
                        # at least one row, and as many as the stretch takes
                        high = max(low + 1, int(np.searchsorted(ends, ends[low] + STRETCH, side="right")) - 1)
                        part = slice(ends[low], ends[high])
                        out[low:high] = np.add.reduceat(centres[place[part]] * weight[part, None], starts[low:high] - ends[low], axis=0)
                        low = high
                    yield written(group, mine, out, nothing)

    empty = F.lit(None).cast("binary")
    names = ["block", "turn", "group", "kind", "rows", "starts", "places", "weights"]
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    turns = F.explode(F.array(F.lit(0), F.lit(1))).alias("turn")
    told = state.select(every, F.lit(0).alias("turn"), "group", F.lit(0).alias("kind"), "rows", F.col("labels").alias("starts"), empty.alias("places"), empty.alias("weights"))
    held = cells.select("block", turns, "group", F.lit(1).alias("kind"), "rows", "starts", "places", "weights")
    # between the turns of a block
    marks = state.sparkSession.range(1).select(every, F.lit(1).alias("turn"), F.lit(-1).alias("group"), F.lit(2).alias("kind"), *[empty.alias(n) for n in names[4:]])
    both = reduce(DataFrame.unionByName, (told, held, marks)).select(*names).repartitionById(blocks, "block")
    return both.sortWithinPartitions("block", "turn", "group", "kind").mapInArrow(work, "group int, rows binary, s binary, squares binary")


def _moved(state: DataFrame, products: DataFrame, sizes: np.ndarray, moving: list[int], seed: int, step: int) -> DataFrame:
    """Each group's rows at their nearest centres."""
    runs, k = sizes.shape
    gone = sizes[moving] == 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def done() -> pa.RecordBatch:
            labels, distances = was.copy(), far.copy()
            away = (squares + seen[:, None] - 2 * total).reshape(len(rows), len(moving), k)
            away = np.where(gone, np.inf, away)
            best = away.argmin(2)
            labels[:, moving] = best
            distances[:, moving] = np.maximum(np.take_along_axis(away, best[:, :, None], 2)[:, :, 0], 0.0)
            size = np.stack([np.bincount(labels[:, run], minlength=k) for run in range(runs)])
            return _state(now, rows, labels, distances, (labels != was).sum(0), distances.sum(0), size, seed, step)

        for batch in batches:
            for group, kind, ids, s, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if now is not None:
                        yield done()
                    # ``seen`` has the squared length of each row: one, or zero without weights
                    now, rows = group, np.frombuffer(ids, np.int64)
                    was, far = np.frombuffer(s, np.int16).reshape(len(rows), runs), np.frombuffer(other).reshape(len(rows), runs)
                    total, squares = np.zeros((len(rows), len(moving) * k)), np.zeros(len(moving) * k)
                    seen = np.zeros(len(rows))
                elif other:
                    squares = squares + np.frombuffer(other)
                else:
                    mine = np.frombuffer(ids, np.int64)
                    at = np.searchsorted(rows, mine)
                    total[at] += np.frombuffer(s).reshape(len(mine), -1)
                    seen[at] = 1.0
        if now is not None:
            yield done()

    held = state.select("group", F.lit(0).alias("kind"), "rows", F.col("labels").alias("s"), F.col("distances").alias("squares"))
    added = products.select("group", F.lit(1).alias("kind"), "rows", "s", "squares")
    dealt = held.unionByName(added).repartition("group").sortWithinPartitions("group", "kind")
    return dealt.mapInArrow(work, STATE)


def kmeans_sparse(
    weights: DataFrame, rows: DataFrame, k: int, row: str = "row", term: str = "term", weight: str = "weight",
    starts: int = 10, seed: int = 42, most_rounds: int = 20,
) -> DataFrame:
    """``(row, cluster)`` of the run of least cost for every row of ``rows``; ties of cost go to the earlier start.

    ``row`` is a whole number, given once in ``rows``; ``weights`` has each (row, term) once, and the weights of
    a row have length one. Clusters are numbered from 0.
    """
    spark = weights.sparkSession
    ship(spark)
    held = settle(weights.select(row, term, weight))
    n, terms = rows.count(), held.select(F.col(term)).distinct().count()
    groups = max(1, -(-n // GROUP_ROWS))
    blocks = max(1, min(spark.sparkContext.defaultParallelism, -(-terms // 1024)), -(-terms // BLOCK_TERMS))
    cells = settle(_cells(held, row, term, weight, blocks, groups))
    release(held)
    state = settle(_first(rows, row, groups, starts, seed))
    every = list(range(starts))
    picks = np.full((starts, k), -2, np.int64)
    sizes = np.zeros((starts, k))

    def read(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        changed, cost, size = np.zeros(starts, np.int64), np.zeros(starts), np.zeros((starts, k))
        key, pick = np.full(starts, np.inf), np.full(starts, -2, np.int64)
        for r in table.select("changed", "cost", "size", "pick", "key").toLocalIterator():
            changed, cost = changed + np.frombuffer(r.changed, np.int64), cost + np.frombuffer(r.cost)
            if len(r.size) == size.nbytes:
                size = size + np.frombuffer(r.size).reshape(size.shape)
            mine, late = np.frombuffer(r.pick, np.int64), np.frombuffer(r.key)
            key, pick = np.where(late < key, late, key), np.where(late < key, mine, pick)
        return changed, cost, size, pick

    def turn(table: DataFrame, counted: np.ndarray, moving: list[int], drawn: np.ndarray | None, step: int) -> DataFrame:
        products = _products(cells, table, counted, moving, drawn, blocks, groups)
        new = settle(_moved(table, products, counted, moving, seed, step))
        release(table)
        del products
        # what a round has shuffled goes when nothing refers to it any more
        gc.collect()
        spark._jvm.System.gc()
        return new

    if not n:
        return rows.select(row).withColumn("cluster", F.lit(0))
    picks[:, 0] = read(state)[3]
    for c in range(1, k + 1):
        sizes[:, :c] = picks[:, :c] >= 0
        state = turn(state, sizes, every, picks, c)
        changed, cost, found, pick = read(state)
        if c < k:
            picks[:, c] = pick
    moving = every
    for done in range(most_rounds):
        state = turn(state, found, moving, None, k + done + 1)
        changed, cost, found, _ = read(state)
        moving = [i for i in moving if changed[i]]
        if not moving:
            break
    best = int(cost.argmin())

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(ids, np.int64)
                of = np.frombuffer(labels, np.int16).reshape(len(own), starts)[:, best].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(of)], names=[row, "cluster"])

    release(cells)
    return state.select("rows", "labels").mapInArrow(told, f"`{row}` long, cluster int")
