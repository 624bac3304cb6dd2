"""Second-order boosted trees for two classes, all fits of a search in the same passes.

Features become bins at quantiles of all rows. A level of a tree is one pass: tasks add gradients
and hessians of the logistic loss per (fit, node, feature, bin), Spark sums them and keeps the best
split of each node, and the driver sees one row per fit and node. Leaves are -G / (H + penalty),
scaled by the learning rate. Grid points and folds grow side by side, and a search scores one fit at
its prefixes.

A task holds the sums of one level, at most fits x 2^(depth - 1) x features x bins pairs, whatever
the number of rows. Rows carry each fit's margin, written anew every ``REFRESH`` trees, so that a
pass walks only the latest trees. Rows with a null label or with a null or non-finite feature take
no part; without any usable row a fit raises ValueError. Splits that gain equally go to the first
feature and bin.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billscope.operators.forests import SAMPLE, thresholds
from billscope.operators.prep import stratified_folds
from billscope.shared import release, settle, ship, summed

REFRESH = 20


@dataclass
class Growth:
    """One fit: its settings, the fold it does not see, and its trees as heaps of nodes.

    A ``plain`` fit follows MLlib's rules: a tree is a regression on the first-order residuals of the logistic
    loss of labels -1 and 1, and the first one, on the labels themselves, has weight one whatever the rate.
    """

    depth: int
    rate: float
    held: int
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    plain: bool = False

    def pulls(self, margin: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the next tree's leaves are made of: gradients and hessians, or the residuals' opposites and ones."""
        if not self.plain:
            chance = 1 / (1 + np.exp(-margin))
            return chance - ones, chance * (1 - chance)
        sign = np.where(ones, 1.0, -1.0)
        return -sign if len(self.trees) == 1 else -4 * sign / (1 + np.exp(2 * sign * margin)), np.ones(len(sign))

    @property
    def step(self) -> float:
        return 1.0 if self.plain and len(self.trees) == 1 else self.rate

    def start(self) -> None:
        size = (2 << self.depth) - 1
        self.trees.append((np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)))


def reach(bins: np.ndarray, tree: tuple, levels: int) -> np.ndarray:
    """The node that each row has come to after some levels."""
    feature, cut, _ = tree
    at, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(levels):
        asked = feature[at]
        at = np.where(asked < 0, at, 2 * at + 1 + (bins[row, asked] > cut[at]))
    return at


def added(bins: np.ndarray, fit: Growth, trees: Sequence[tuple]) -> np.ndarray:
    total = np.zeros(len(bins))
    for tree in trees:
        total += tree[2][reach(bins, tree, fit.depth)]
    return total


@dataclass(frozen=True)
class Boosted:
    """A fitted model; ``edges`` hold the upper bound of each bin but the last, feature by feature."""

    edges: list[np.ndarray]
    fit: Growth
    features: str = "features"

    def nodes(self, names: Sequence[str]) -> list[tuple[int, int, str | None, float | None, float]]:
        """Tree, node, feature and threshold (both null in a leaf; smaller and equal values go left) and value.

        The children of node n are 2 n + 1 and 2 n + 2.
        """
        rows = []
        for t, (feature, cut, value) in enumerate(self.fit.trees):
            alive = {0}
            for n in range(len(feature)):
                if n not in alive:
                    continue
                f = int(feature[n])
                if f >= 0:
                    alive |= {2 * n + 1, 2 * n + 2}
                rows.append((t, n, names[f] if f >= 0 else None, float(self.edges[f][cut[n]]) if f >= 0 else None, float(value[n])))
        return rows

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows with ``probability`` (vector) and ``prediction``; both null without usable features."""
        edges, fit = self.edges, self.fit

        def chances(values: pd.Series) -> pd.Series:
            out = [None] * len(values)
            good = [i for i, v in enumerate(values) if v is not None and len(v) == len(edges) and np.isfinite(np.asarray(v, float)).all()]
            if good:
                points = np.array([values.iloc[i] for i in good], float)
                bins = np.stack([np.searchsorted(e, points[:, i]) for i, e in enumerate(edges)], 1)
                one = 1 / (1 + np.exp(-fit.base - added(bins, fit, fit.trees)))
                for i, p in zip(good, one.tolist()):
                    out[i] = [1 - p, p]
            return pd.Series(out, dtype=object)

        ship(df.sparkSession)
        judged = df.withColumn("_chances", F.pandas_udf(chances, "array<double>")(_plain(df, self.features)))
        return judged.withColumns({
            "probability": F.when(F.col("_chances").isNotNull(), array_to_vector(F.coalesce("_chances", F.array().cast("array<double>")))),
            "prediction": (F.get("_chances", F.lit(1)) > 0.5).cast("double"),
        }).drop("_chances")


@dataclass(frozen=True)
class BoostedSearch:
    """Grid points, their mean F1 of class 1 over the folds, and the best one fitted on all rows."""

    points: list[dict]
    scores: list[float]
    bestModel: Boosted

    def transform(self, df: DataFrame) -> DataFrame:
        return self.bestModel.transform(df)


def _plain(df: DataFrame, features: str) -> Column:
    if df.schema[features].dataType.typeName() == "array":
        return F.col(features).cast("array<double>")
    return F.when(F.col(features).isNotNull(), vector_to_array(features))


def _usable(df: DataFrame, features: str, label: str, fold: Column) -> DataFrame:
    rows = df.select(_plain(df, features).alias("v"), F.col(label).cast("int").alias("y"), fold.cast("int").alias("f"))
    return rows.where("v is not null and y is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf'))")


def _edges(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    cuts = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.get("v", F.lit(i)), cuts, 10_000).alias(f"q{i}") for i in range(width)]).first()
    return [np.unique(np.array(q, float)) for q in found]


def _binned(rows: DataFrame, edges: list[np.ndarray], fits: int) -> DataFrame:
    """Bins of each row as bytes, label, fold and the margin of each fit before any tree."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            bins = np.stack([np.searchsorted(e, points[:, i]) for i, e in enumerate(edges)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.tobytes() for b in bins]), batch.column(1), batch.column(2), _lists(np.zeros((len(bins), fits)))],
                names=["bins", "y", "f", "margins"],
            )

    return rows.mapInArrow(work, "bins binary, y int, f int, margins array<double>")


def _lists(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64()))


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    n = batch.num_rows
    bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(n, -1).astype(np.int64)
    margins = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return bins, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), margins


def _refreshed(rows: DataFrame, fits: list[Growth], since: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins, _, _, margins = _unpack(batch)
                new = margins + np.stack([added(bins, fit, fit.trees[since:]) for fit in fits], 1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], _lists(new)], names=["bins", "y", "f", "margins"])

    return settle(rows.mapInArrow(work, rows.schema))


def best_splits(rows: DataFrame, fits: list[Growth], since: int, level: int, width: int, bins: int, penalty: float, least: float) -> DataFrame:
    """For each fit and node of a level: the best split, its gain and the sums on both sides, from one pass."""
    nodes, first = 1 << level, (1 << level) - 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {i: np.zeros((2, nodes * width * bins)) for i, fit in enumerate(fits) if level < fit.depth}
        cell = np.arange(width) * bins
        for batch in batches:
            if not batch.num_rows:
                continue
            every, labels, folds, margins = _unpack(batch)
            for i, both in total.items():
                fit = fits[i]
                mine = folds != fit.held
                at = reach(every[mine], fit.trees[-1], level) - first
                live = at >= 0  # rows in leaves of earlier levels are done
                seen = every[mine][live]
                if not len(seen):
                    continue
                margin = fit.base + margins[mine, i][live] + added(seen, fit, fit.trees[since:-1])
                where = ((at[live] * width * bins)[:, None] + cell + seen).ravel()
                for k, x in enumerate(fit.pulls(margin, labels[mine][live] == 1)):
                    both[k] += np.bincount(where, np.repeat(x, width), nodes * width * bins)
        for i, both in total.items():
            each = both.reshape(2, nodes, width * bins).swapaxes(0, 1)
            used = np.flatnonzero(each[:, 1].any(1))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(used), i, np.int32)), pa.array(used.astype(np.int32)),
                pa.array([each[node].tobytes() for node in used], pa.binary()),
            ], names=["fit", "node", "s"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for s in batch.column(2).to_pylist():
                both = np.frombuffer(s).reshape(2, width, bins)
                gl, hl = left = both.cumsum(2)
                g, h = left[:, :, -1:]
                gr, hr = g - gl, h - hl
                with np.errstate(divide="ignore", invalid="ignore"):  # no rows on a side
                    gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - g**2 / (h + penalty)
                gain[(hl < least) | (hr < least)] = 0.0
                # equal up to rounding counts as equal
                gain = np.round(gain, 9)
                at = np.unravel_index(gain.argmax(), gain.shape)
                found.append((at[0], gain[at], at[1], gl[at], hl[at], gr[at], hr[at]))
            if found:
                cells = [pa.array(c, kind) for c, kind in zip(zip(*found), (pa.int32(), pa.float64(), pa.int32(), *[pa.float64()] * 4), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *cells], names=["fit", "node", "feature", "gain", "cut", "gl", "hl", "gr", "hr"])

    ship(rows.sparkSession)
    each = summed(rows.mapInArrow(sums, "fit int, node int, s binary"), ["fit", "node"])
    return each.mapInArrow(best, "fit int, node int, feature int, gain double, cut int, gl double, hl double, gr double, hr double")


def grow(rows: DataFrame, fits: list[Growth], trees: int, width: int, bins: int, penalty: float = 1.0, least: float = 1.0) -> None:
    """Add ``trees`` trees to every fit; ``rows`` are binned, with margins of zero."""
    since, start = 0, rows
    for number in range(trees):
        for fit in fits:
            fit.start()
        for level in range(max(fit.depth for fit in fits)):
            found = best_splits(rows, fits, since, level, width, bins, penalty, least).collect()
            for r in found:
                fit = fits[r.fit]
                feature, cut, value = fit.trees[-1]
                at = (1 << level) - 1 + r.node
                if level == 0:
                    value[0] = -fit.step * (r.gl + r.gr) / (r.hl + r.hr + penalty)
                if r.gain > 0:
                    feature[at], cut[at] = r.feature, r.cut
                    value[2 * at + 1], value[2 * at + 2] = -fit.step * r.gl / (r.hl + penalty), -fit.step * r.gr / (r.hr + penalty)
            if not any(r.gain > 0 for r in found):
                break
        if number + 1 - since >= REFRESH and number + 1 < trees:
            old, rows, since = rows, _refreshed(rows, fits, since), number + 1
            if old is not start:
                release(old)
    if rows is not start:
        release(rows)


def _held_cells(rows: DataFrame, fits: list[Growth], sizes: Sequence[int]) -> dict[tuple[int, int], float]:
    """F1 of class 1 on each fit's held rows after each number of trees, from one pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((len(fits), len(sizes), 2), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            every, labels, folds, _ = _unpack(batch)
            for i, fit in enumerate(fits):
                seen, truth = every[folds == fit.held], labels[folds == fit.held] == 1
                margin, done = np.full(len(seen), fit.base), 0
                for j, size in enumerate(sizes):
                    margin, done = margin + added(seen, fit, fit.trees[done:size]), size
                    cells[i, j] += (truth & (margin > 0)).sum(), (truth != (margin > 0)).sum()
        fit, size = np.indices(cells.shape[:2])
        yield pa.RecordBatch.from_arrays(
            [pa.array(x.ravel().astype(np.int64)) for x in (fit, size, cells[..., 0], cells[..., 1])], names=["fit", "size", "hit", "wrong"]
        )

    sums = rows.mapInArrow(work, "fit long, size long, hit long, wrong long").groupBy("fit", "size").agg(F.sum("hit").alias("hit"), F.sum("wrong").alias("wrong"))
    return {(r.fit, r.size): 2 * r.hit / (2 * r.hit + r.wrong) if r.hit else 0.0 for r in sums.collect()}


def plain_scores(
    folded: DataFrame, outer: Sequence[dict], sizes: Sequence[int], label: str = "label", folds: int = 3, bins: int = 32, features: str = "features",
) -> list[list[float]]:
    """Mean F1 of class 1 over the folds of ``folded``, for each point's depth and rate after each number of trees, by MLlib's rules.

    Thresholds are midpoints between the quantiles of 10,000 rows, shared by all folds.
    """
    ship(folded.sparkSession)
    usable = _usable(folded, features, label, F.col("fold"))
    n = usable.count()
    if not n:
        raise ValueError("no rows to fit on")
    sample = usable if n <= SAMPLE else usable.sample(SAMPLE / n, 0)
    edges = thresholds(np.array([r.v for r in sample.select("v").collect()], float), bins)
    fits = [Growth(p["depth"], p["rate"], fold, plain=True) for p in outer for fold in range(folds)]
    rows = settle(_binned(usable, edges, len(fits)))
    grow(rows, fits, max(sizes), len(edges), bins, 0.0, 1.0)
    held = _held_cells(rows, fits, sizes)
    release(rows)
    return [[sum(held.get((at * folds + f, j), 0.0) for f in range(folds)) / folds for j in range(len(sizes))] for at in range(len(outer))]


def boosted_search(
    train: DataFrame, key: Sequence[str], label: str = "label", trees: Sequence[int] = (100, 200, 300),
    depths: Sequence[int] = (3, 5, 7), rates: Sequence[float] = (0.01, 0.1, 0.3), folds: int = 3, bins: int = 32,
    penalty: float = 1.0, least: float = 1.0, seed: int = 42, features: str = "features",
) -> BoostedSearch:
    """Stratified k-fold search over numbers and depths of trees and learning rates by F1 of class 1.

    ``bins`` may be 2 to 256; ``least`` is the smallest sum of hessians on a side of a split. Every
    (depth, rate) is fitted on all rows in the same passes as its folds. Ties go to the earlier point.
    """
    ship(train.sparkSession)
    usable = _usable(stratified_folds(train, label, key, folds, seed), features, label, F.col("fold"))
    one = usable.select(F.size("v").alias("n")).first()
    if one is None:
        raise ValueError("no rows to fit on")
    sizes = sorted(trees)
    outer = [{"depth": d, "rate": r} for d in depths for r in rates]
    # fold -1 is no row's: that fit sees them all
    fits = [Growth(p["depth"], p["rate"], fold) for p in outer for fold in (*range(folds), -1)]
    edges = _edges(usable, one.n, bins)
    rows = settle(_binned(usable, edges, len(fits)))
    grow(rows, fits, sizes[-1], one.n, bins, penalty, least)
    tried = [i for i, fit in enumerate(fits) if fit.held >= 0]
    held = _held_cells(rows, [fits[i] for i in tried], sizes)
    release(rows)
    points = [{**p, "trees": size} for p in outer for size in sizes]
    scores = [
        sum(held.get((at * folds + f, j), 0.0) for f in range(folds)) / folds for at in range(len(outer)) for j in range(len(sizes))
    ]
    best = max(range(len(points)), key=lambda i: (scores[i], -i))
    whole = fits[best // len(sizes) * (folds + 1) + folds]
    kept = Growth(whole.depth, whole.rate, -1, whole.base, whole.trees[: points[best]["trees"]])
    return BoostedSearch(points, scores, Boosted(edges, kept, features))
