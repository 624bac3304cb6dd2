"""K-means with many runs at once: all starts of all numbers of clusters move together.

A round is one pass over the rows. Each task adds up its rows per (run, cluster) and gives one row
for each; those sums are added by one aggregate. So a sweep over ten numbers of clusters with ten
starts takes as many passes as its slowest run, not the sum of all. Runs that have come to rest leave
the next round.

In one dimension the values are sorted once, in chunks of ``LINE`` on their own; a round then looks up the
borders between the centres in each chunk and sums what lies between them, so that a run costs a pass over
plain arrays and no look-up per value. A run whose clusters keep their numbers of rows is at rest, as the
same stretches of the line give the same means.

Starts are drawn by k-means++ from the ``SEED_SAMPLE`` rows of least hash; only the first centres
depend on that sample, every round and every cost covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billscope.shared import ship

SEED_SAMPLE = 10_000
#: Dimensions whose sums travel in one row.
WIDTH = 64
#: Values of a one-dimensional chunk.
LINE = 1 << 14
#: One-dimensional chunks that a task has, on average, where its rows come in small partitions.
LINES = 4


@dataclass(frozen=True)
class Centres:
    """A fitted run."""

    values: np.ndarray
    cost: float
    rounds: int

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.values)

    def place(self, value: Column) -> Column:
        """Cluster of a plain number: how many borders between the sorted centres lie below it."""
        centres = self.values[:, 0].tolist()
        borders = F.array(*[F.lit((a + b) / 2) for a, b in zip(centres, centres[1:], strict=False)]).cast("array<double>")
        return F.when(value.isNotNull(), F.size(F.filter(borders, lambda b: b < value)))

    def transform(self, df: DataFrame, features: str = "features", cluster: str = "cluster") -> DataFrame:
        """The rows with their cluster; ``features`` is a vector or array column."""
        from billscope.operators.clusters import nearest_centroid

        kind = df.schema[features].dataType.typeName()
        centres = df.sparkSession.createDataFrame(
            [(i, c.tolist()) for i, c in enumerate(self.values)], f"{cluster} int, centroid array<double>"
        )
        rows = df.withColumn("_at", F.col(features).cast("array<double>") if kind == "array" else vector_to_array(features))
        return nearest_centroid(rows, "_at", centres, cluster).drop("_at", "distance")


def kmeans_runs(
    df: DataFrame, column: str, ks: Sequence[int], starts: int = 10, seed: int = 42, weight: str | None = None,
    most_rounds: int = 300, tolerance: float = 1e-4,
) -> dict[int, Centres]:
    """The run of least cost for each number of clusters; ``column`` holds numbers or arrays of numbers.

    A run rests when its centres' summed squared moves are within ``tolerance`` times the mean variance
    of the dimensions. A cluster that loses all rows keeps its centre. Centres are in rising order.
    Rows with a null take no part; without rows there are no runs. Ties of cost go to the earlier start.
    """
    kind = df.schema[column].dataType.typeName()
    value = (F.col(column) if kind == "array" else F.array(F.col(column))).cast("array<double>")
    rows = df.select(value.alias("v"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    rows = rows.where("v is not null and w > 0 and not exists(v, x -> x is null or isnan(x))").persist()
    line = None
    try:
        sample = rows.orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(SEED_SAMPLE).collect()
        if not sample:
            return {}
        points, weights = np.array([r.v for r in sample], float), np.array([r.w for r in sample], float)
        centre = np.average(points, axis=0, weights=weights)
        rest = tolerance * float(np.average((points - centre) ** 2, axis=0, weights=weights).mean())
        runs = [(k, start) for k in ks for start in range(starts)]
        now = [_sorted(_first(points, weights, k, np.random.default_rng((seed, k, start)))) for k, start in runs]
        moving, rounds = list(range(len(runs))), [0] * len(runs)
        counts: dict[int, list[int]] = {}
        if points.shape[1] == 1:
            # few values make few tasks, whatever the partitions that they come in
            parts = -(-rows.count() // (LINE * LINES))
            line = _line(rows.coalesce(parts)).persist()
        for done in range(1, most_rounds + 1):
            trial = {i: now[i] for i in moving}
            found = _round(rows, trial) if line is None else _line_round(line, trial)
            still = []
            for i in moving:
                size, total = found[i][:2]
                after = np.where(size[:, None] > 0, total / np.maximum(size, 1e-300)[:, None], now[i])
                moved = float(((after - now[i]) ** 2).sum())
                now[i], rounds[i] = _sorted(after), done
                same = line is not None and counts.get(i) == found[i][3]
                if line is not None:
                    counts[i] = found[i][3]
                if moved > rest and not same:
                    still.append(i)
            moving = still
            if not moving:
                break
        last = dict(enumerate(now))
        costs = {i: r[2] for i, r in (_round(rows, last) if line is None else _line_round(line, last, True)).items()}
    finally:
        rows.unpersist()
        if line is not None:
            line.unpersist()
    best: dict[int, int] = {}
    for i, (k, _) in enumerate(runs):
        if k not in best or costs[i] < costs[best[k]]:
            best[k] = i
    return {k: Centres(now[i], costs[i], rounds[i]) for k, i in best.items()}


def _sorted(centres: np.ndarray) -> np.ndarray:
    return centres[np.lexsort(centres.T[::-1])]


def _first(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each centre is drawn by weight times squared distance to the nearest one so far."""
    chosen = [points[rng.choice(len(points), p=weights / weights.sum())]]
    near = ((points - chosen[0]) ** 2).sum(1)
    for _ in range(k - 1):
        share = near * weights
        total = share.sum()
        at = rng.choice(len(points), p=share / total) if total > 0 else rng.integers(len(points))
        chosen.append(points[at])
        near = np.minimum(near, ((points - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def assign(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each point and the squared distance; centres are in rising order."""
    if points.shape[1] == 1:
        line, x = centres[:, 0], points[:, 0]
        at = np.searchsorted((line[:-1] + line[1:]) / 2, x)
        return at, (x - line[at]) ** 2
    at = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
    return at, ((points - centres[at]) ** 2).sum(1)


def _round(rows: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """For each run: weight and sum of the points of each cluster, and the cost."""
    width = next(iter(centres.values())).shape[1]
    parts = -(-width // WIDTH)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = {i: np.zeros(len(c)) for i, c in centres.items()}
        total = {i: np.zeros((len(c), parts * WIDTH)) for i, c in centres.items()}
        cost = {i: np.zeros(len(c)) for i, c in centres.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            points = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, width)
            w = batch.column(1).to_numpy()
            weighted = points * w[:, None]
            for i, c in centres.items():
                at, far = assign(points, c)
                size[i] += np.bincount(at, w, len(c))
                cost[i] += np.bincount(at, far * w, len(c))
                if width == 1:
                    total[i][:, 0] += np.bincount(at, weighted[:, 0], len(c))
                else:
                    total[i][:, :width] += (at == np.arange(len(c))[:, None]).astype(float) @ weighted
        for i, c in centres.items():
            for part in range(parts):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(c), i, np.int32)), pa.array(np.arange(len(c), dtype=np.int32)),
                    pa.array(np.full(len(c), part, np.int32)), pa.array(size[i]), pa.array(cost[i]),
                    pa.FixedSizeListArray.from_arrays(pa.array(total[i][:, part * WIDTH : (part + 1) * WIDTH].ravel()), WIDTH).cast(pa.list_(pa.float64())),
                ], names=["run", "cluster", "part", "size", "cost", "total"])

    ship(rows.sparkSession)
    sums = rows.mapInArrow(work, "run int, cluster int, part int, size double, cost double, total array<double>")
    used = min(width, WIDTH)
    added = sums.groupBy("run", "cluster", "part").agg(
        F.sum("size").alias("size"), F.sum("cost").alias("cost"),
        F.array(*[F.sum(F.get("total", F.lit(d))) for d in range(used)]).alias("total"),
    )
    out = {i: (np.zeros(len(c)), np.zeros(c.shape), 0.0) for i, c in centres.items()}
    for r in added.collect():
        size, total, cost = out[r.run]
        size[r.cluster] = r.size
        low = r.part * WIDTH
        total[r.cluster, low : low + WIDTH] = r.total[: width - low]
        out[r.run] = (size, total, cost + (r.cost if r.part == 0 else 0.0))
    return out


def _line(rows: DataFrame) -> DataFrame:
    """Chunks of sorted one-dimensional values with their weights, as plain arrays."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def written(x: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(x, kind="stable")
            return pa.RecordBatch.from_arrays([pa.array([x[order].tobytes()]), pa.array([w[order].tobytes()])], names=["x", "w"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).flatten().to_numpy(), batch.column(1).to_numpy()))
            if sum(len(x) for x, _ in held) >= LINE:
                x, w = (np.concatenate(part) for part in zip(*held, strict=True))
                whole = len(x) // LINE * LINE
                for at in range(0, whole, LINE):
                    yield written(x[at : at + LINE], w[at : at + LINE])
                held = [(x[whole:], w[whole:])]
        x, w = (np.concatenate(part) for part in zip(*held, strict=True)) if held else (np.zeros(0), np.zeros(0))
        if len(x):
            yield written(x, w)

    ship(rows.sparkSession)
    return rows.mapInArrow(work, "x binary, w binary")


def _line_round(
    line: DataFrame, centres: dict[int, np.ndarray], cost: bool = False
) -> dict[int, tuple[np.ndarray, np.ndarray, float, list[int]]]:
    """For each run: weight, sum and number of the values of each cluster, and the cost if asked."""

    def stretches(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sums of the values up to each end since the one before."""
        starts = np.append(0, ends[:-1])
        out, some = np.zeros(len(ends)), ends > starts
        out[some] = np.add.reduceat(values, starts[some])
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {i: np.zeros((4, len(c))) for i, c in centres.items()}
        borders = {i: (c[:-1, 0] + c[1:, 0]) / 2 for i, c in centres.items()}
        for batch in batches:
            for xs, ws in zip(batch.column(0), batch.column(1), strict=True):
                x, w = np.frombuffer(xs.as_buffer()), np.frombuffer(ws.as_buffer())
                weighted = x * w
                for i, c in centres.items():
                    # a value on a border belongs to the lower centre
                    ends = np.append(np.searchsorted(x, borders[i], side="right"), len(x))
                    each = np.diff(ends, prepend=0)
                    sums[i][:3] += stretches(w, ends), stretches(weighted, ends), each
                    if cost:
                        sums[i][3] += stretches((x - np.repeat(c[:, 0], each)) ** 2 * w, ends)
        for i, (size, total, n, far) in sums.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(n), i, np.int32)), pa.array(np.arange(len(n), dtype=np.int32)),
                pa.array(size), pa.array(total), pa.array(n.astype(np.int64)), pa.array(far),
            ], names=["run", "cluster", "size", "total", "n", "cost"])

    added = line.mapInArrow(work, "run int, cluster int, size double, total double, n long, cost double").groupBy("run", "cluster").agg(
        *[F.sum(c).alias(c) for c in ("size", "total", "n", "cost")]
    )
    out = {i: (np.zeros(len(c)), np.zeros(c.shape), 0.0, [0] * len(c)) for i, c in centres.items()}
    for r in added.collect():
        size, total, far, n = out[r.run]
        size[r.cluster], total[r.cluster, 0], n[r.cluster] = r.size, r.total, r.n
        out[r.run] = (size, total, far + r.cost, n)
    return out
