"""Exact nearest neighbours among distinct vectors, without forming all pairs.

A tree of splits taken from a sample cuts the space into boxes of a fixed number of points,
so their number grows with the points. Each box is searched on its own; a point then walks the
tree to the other boxes that reach into the ball of its k-th distance so far, which makes the
answer exact. With many dimensions such a ball touches many boxes.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billscope.shared import settle, ship

CELL_ROWS = 2000
#: Sampled rows for each box; with boxes of CELL_ROWS points, one point in 250 is sampled.
SAMPLE_PER_CELL = 8
PROBE_SALTS = 4
PROBED_ROWS = 256
BLOCK_NUMBERS = 4_000_000

CANDIDATES = "array<struct<d: double, v: array<double>, n: bigint>>"


class Boxes:
    """A binary tree of splits over the space; its leaves are boxes that tile it."""

    def __init__(self, sample: np.ndarray, cells: int):
        width = sample.shape[1]
        self.axis, self.cut, self.child = [0], [0.0], [[-1, -1]]  # an inner node has both children
        self.low, self.high = [np.full(width, -np.inf)], [np.full(width, np.inf)]
        waiting = [(-len(sample), 0, sample)]
        leaves = 1
        while waiting and leaves < cells:
            _, node, rows = heapq.heappop(waiting)
            axis = int(np.argmax(rows.max(axis=0) - rows.min(axis=0))) if len(rows) else 0
            values = np.unique(rows[:, axis]) if len(rows) else np.array([])
            if len(values) < 2:
                continue
            cut = float(values[len(values) // 2])
            self.axis[node], self.cut[node] = axis, cut
            for side, part in enumerate((rows[rows[:, axis] < cut], rows[rows[:, axis] >= cut])):
                low, high = self.low[node].copy(), self.high[node].copy()
                (low if side else high)[axis] = cut
                self.child[node][side] = len(self.axis)
                for column, value in ((self.axis, 0), (self.cut, 0.0), (self.child, [-1, -1]), (self.low, low), (self.high, high)):
                    column.append(value)
                heapq.heappush(waiting, (-len(part), len(self.axis) - 1, part))
            leaves += 1
        self.axis, self.cut, self.child = np.array(self.axis), np.array(self.cut), np.array(self.child)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def place(self, at: np.ndarray) -> np.ndarray:
        """The leaf of each point, by walking down the tree."""
        node = np.zeros(len(at), int)
        while True:
            inner = np.flatnonzero(self.child[node, 0] >= 0)
            if not len(inner):
                return node
            n = node[inner]
            node[inner] = self.child[n, (at[inner, self.axis[n]] >= self.cut[n]).astype(int)]

    def reach(self, at: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all boxes that touch the ball of each point; branches beyond it are not entered."""
        row, node = np.arange(len(at)), np.zeros(len(at), int)
        rows, leaves = [], []
        while len(row):
            gap = np.maximum(np.maximum(self.low[node] - at[row], at[row] - self.high[node]), 0.0)
            near = (gap ** 2).sum(axis=1) <= square[row]
            row, node = row[near], node[near]
            leaf = self.child[node, 0] < 0
            rows.append(row[leaf])
            leaves.append(node[leaf])
            row, node = np.repeat(row[~leaf], 2), self.child[node[~leaf]].ravel()
        return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(leaves or [np.zeros(0, int)])


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column])


def _closest(
    asked: np.ndarray, points: np.ndarray, counts: np.ndarray, k: int, radius: np.ndarray | None = None
) -> list[list[dict]]:
    """The k closest points of each asked vector, itself left out, within its radius."""
    order = np.lexsort(points.T[::-1])  # ties at one distance then go by the vector itself
    points, counts, out = points[order], counts[order], []
    block = max(1, BLOCK_NUMBERS // max(1, points.size))
    for start in range(0, len(asked), block):
        part = asked[start:start + block]
        square = ((part[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
        same = (part[:, None, :] == points[None, :, :]).all(axis=2)
        square[same] = np.inf
        if radius is not None:
            square[square > radius[start:start + block, None]] = np.inf
        near = np.argsort(square, axis=1, kind="stable")[:, :k]
        found = zip(np.take_along_axis(square, near, 1).tolist(), points[near].tolist(), counts[near].tolist())
        out += [[{"d": d, "v": v, "n": n} for d, v, n in zip(*row) if d < np.inf] for row in found]
    return out


def nearest_vectors(points: DataFrame, k: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """For distinct vectors ``(v, n)``: the k closest others, nearest first, as ``near``."""
    points = settle(points.select("v", "n"))
    total = points.count()
    cells = max(1, total // cell_rows)
    sample = points.orderBy(F.xxhash64("v")).limit(cells * SAMPLE_PER_CELL).select("v").toPandas()
    boxes = Boxes(_stack(sample["v"]) if len(sample) else np.zeros((1, 1)), cells)
    ship(points.sparkSession)

    def place(batches):
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=boxes.place(_stack(batch["v"])))

    placed = points.mapInPandas(place, "v array<double>, n bigint, cell int")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        at = _stack(group["v"])
        near = _closest(at, at, group["n"].to_numpy(), k)
        radius = [c[k - 1]["d"] if len(c) == k else float("inf") for c in near]
        return pd.DataFrame({"v": group["v"], "cell": group["cell"], "near": near, "r": radius})

    own = placed.groupBy("cell").applyInPandas(search, f"v array<double>, cell int, near {CANDIDATES}, r double")
    if len(boxes.cut) == 1:
        return own.select("v", "near")
    own = settle(own)

    def visits(batches):
        for batch in batches:
            for start in range(0, len(batch), PROBED_ROWS):
                part = batch.iloc[start:start + PROBED_ROWS]
                row, cell = boxes.reach(_stack(part["v"]), part["r"].to_numpy())
                other = cell != part["cell"].to_numpy()[row]
                row, cell = row[other], cell[other]
                yield pd.DataFrame({
                    "cell": cell.astype("int32"), "v": part["v"].to_numpy()[row], "r": part["r"].to_numpy()[row]
                })

    probes = own.select("v", "cell", "r").mapInPandas(visits, "cell int, v array<double>, r double")
    probes = probes.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(PROBE_SALTS)).cast("int"))
    copies = placed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(PROBE_SALTS - 1))))

    def visit(here: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(here) or not len(asked):
            return pd.DataFrame({"v": [], "near": []}, dtype=object)
        near = _closest(_stack(asked["v"]), _stack(here["v"]), here["n"].to_numpy(), k, asked["r"].to_numpy())
        return pd.DataFrame({"v": asked["v"], "near": near})

    found = copies.groupBy("cell", "salt").cogroup(probes.groupBy("cell", "salt")).applyInPandas(
        visit, f"v array<double>, near {CANDIDATES}"
    )
    merged = own.select("v", "near").unionByName(found).groupBy("v").agg(F.flatten(F.collect_list("near")).alias("near"))
    return merged.select("v", F.slice(F.sort_array("near"), 1, k).alias("near"))
