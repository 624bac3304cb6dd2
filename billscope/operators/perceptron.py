"""Perceptrons with a choice of activation, many fits at once.

All points of a grid and all their folds move together. A round is one pass over the rows: each task
goes forward and back through its rows for every fit that still moves and gives one row of sums for
each; those are added by one aggregate. The driver holds the weights, and for each fit a limited-memory
quasi-Newton search, whose trial steps are halved until the loss falls enough. So a grid of nine
points in three folds takes as many passes as its slowest fit, not the sum of all.

Rows of up to ``HELD`` numbers in all go to a task for each fit instead, which takes the same passes on its own: then no
pass waits for a job of Spark's or for other fits.

The loss is the mean cross entropy of a softmax over the classes plus ``penalty`` / (2 n) times the
squared weights, without the intercepts. Rows with a null, a NaN or an infinite feature, or a null
label, take no part in a fit; they get a null prediction. What travels grows with weights times fits,
not with rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billscope.operators.prep import stratified_folds
from billscope.shared import ship, summed

#: Pairs of moves that a quasi-Newton search remembers.
MEMORY = 10
HALVINGS = 30
#: Numbers of all rows that a task may hold, and rows that it multiplies at a time.
HELD, STRETCH = 1 << 23, 2048
#: Share of the promised fall in loss that a step has to bring.
ENOUGH = 1e-4

#: Each activation, and its slope given what it returned.
ACTIVATIONS: dict[str, tuple[Callable, Callable]] = {
    "relu": (lambda z: np.maximum(z, 0.0), lambda a: (a > 0).astype(float)),
    "tanh": (np.tanh, lambda a: 1.0 - a * a),
    "logistic": (lambda z: 0.5 * (1.0 + np.tanh(0.5 * z)), lambda a: a * (1.0 - a)),
}


@dataclass(frozen=True)
class Shape:
    """Sizes of all layers, inputs and classes included, and the activation between them."""

    sizes: tuple[int, ...]
    activation: str

    @property
    def length(self) -> int:
        return sum((a + 1) * b for a, b in zip(self.sizes, self.sizes[1:]))

    def layers(self, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Views of the flat weights: matrix and intercepts of each layer."""
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + (a + 1) * b]))
            at += (a + 1) * b
        return out

    def first(self, rng: np.random.Generator) -> np.ndarray:
        """Weights drawn evenly within a bound that keeps the spread of a layer's outputs like that of its inputs."""
        weights = np.empty(self.length)
        reach = 2.0 if self.activation == "logistic" else 6.0
        for matrix, intercepts in self.layers(weights):
            bound = np.sqrt(reach / sum(matrix.shape))
            matrix[:] = rng.uniform(-bound, bound, matrix.shape)
            intercepts[:] = rng.uniform(-bound, bound, intercepts.shape)
        return weights

    def squares(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """Half the squared weights without intercepts, and its gradient."""
        gradient = np.zeros_like(weights)
        for (matrix, _), (into, _) in zip(self.layers(weights), self.layers(gradient)):
            into[:] = matrix
        return 0.5 * float(gradient @ gradient), gradient

    def forward(self, weights: np.ndarray, points: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """What each layer gets, and the logarithm of the classes' probabilities."""
        act, layers, given = ACTIVATIONS[self.activation][0], self.layers(weights), [points]
        for matrix, intercepts in layers[:-1]:
            given.append(act(given[-1] @ matrix + intercepts))
        z = given[-1] @ layers[-1][0] + layers[-1][1]
        z = z - z.max(1, keepdims=True)
        return given, z - np.log(np.exp(z).sum(1, keepdims=True))

    def loss(self, weights: np.ndarray, points: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray]:
        """Cross entropy summed over the rows, and its gradient by back-propagation."""
        given, logs = self.forward(weights, points)
        rows = np.arange(len(points))
        back = np.exp(logs)
        back[rows, labels] -= 1.0
        gradient = np.empty_like(weights)
        slope = ACTIVATIONS[self.activation][1]
        pairs = list(zip(self.layers(weights), self.layers(gradient), given))
        for at, ((matrix, _), (into, bias), got) in reversed(list(enumerate(pairs))):
            into[:] = got.T @ back
            bias[:] = back.sum(0)
            if at:
                back = (back @ matrix.T) * slope(got)
        return -float(logs[rows, labels].sum()), gradient


@dataclass
class Descent:
    """One fit: its place, and the trial that the next pass shall judge."""

    shape: Shape
    place: np.ndarray
    loss: float = np.inf
    gradient: np.ndarray | None = None
    step: np.ndarray | None = None
    size: float = 1.0
    halved: int = 0
    moves: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    rests: bool = False

    @property
    def trial(self) -> np.ndarray:
        return self.place if self.step is None else self.place + self.size * self.step

    def judge(self, loss: float, gradient: np.ndarray, tolerance: float) -> None:
        """Take the trial if the loss fell enough, else halve the step; rest when nothing is left to gain."""
        if self.step is not None:
            promised = float(self.gradient @ self.step)
            if not loss <= self.loss + ENOUGH * self.size * promised:
                self.halved += 1
                if self.halved <= HALVINGS:
                    self.size /= 2
                elif self.moves:  # begin again from plain descent
                    self.moves.clear()
                    self._aim()
                else:
                    self.rests = True
                return
            moved, turned = self.size * self.step, gradient - self.gradient
            if moved @ turned > 1e-12 * (turned @ turned):
                self.moves = [*self.moves, (moved, turned)][-MEMORY:]
            self.place = self.trial
        fell = self.loss - loss
        self.loss, self.gradient = loss, gradient
        if np.abs(gradient).max() <= tolerance or fell <= tolerance * 1e-4 * max(abs(loss), 1e-12):
            self.rests = True
        else:
            self._aim()

    def _aim(self) -> None:
        """The two-loop product of the remembered inverse curvature with the gradient."""
        q, shares = self.gradient.copy(), []
        for s, y in reversed(self.moves):
            share = float(s @ q) / float(s @ y)
            shares.append(share)
            q -= share * y
        if self.moves:
            s, y = self.moves[-1]
            q *= float(s @ y) / float(y @ y)
        for (s, y), share in zip(self.moves, reversed(shares)):
            q += (share - float(y @ q) / float(s @ y)) * s
        self.step, self.halved = -q, 0
        self.size = 1.0 if self.moves else min(1.0, 1.0 / max(float(np.linalg.norm(q)), 1e-12))


@dataclass(frozen=True)
class Perceptron:
    """A fitted perceptron."""

    shape: Shape
    weights: np.ndarray
    loss: float
    features: str = "features"

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows with ``probability`` (vector) and ``prediction``; both null without usable features."""
        shape, weights = self.shape, self.weights

        def chances(values: pd.Series) -> pd.Series:
            out = [None] * len(values)
            good = [i for i, v in enumerate(values) if v is not None and len(v) == shape.sizes[0] and np.isfinite(np.asarray(v, float)).all()]
            if good:
                found = np.exp(shape.forward(weights, np.array([values.iloc[i] for i in good], float))[1])
                for i, p in zip(good, found.tolist()):
                    out[i] = p
            return pd.Series(out, dtype=object)

        ship(df.sparkSession)
        judged = df.withColumn("_chances", F.pandas_udf(chances, "array<double>")(_plain(df, self.features)))
        best = F.array_position("_chances", F.array_max("_chances")) - 1
        return judged.withColumns({
            "probability": F.when(F.col("_chances").isNotNull(), array_to_vector(F.coalesce("_chances", F.array().cast("array<double>")))),
            "prediction": best.cast("double"),
        }).drop("_chances")


@dataclass(frozen=True)
class PerceptronSearch:
    """Grid points, their mean F1 of class 1 over the folds, and the best one fitted on all rows."""

    points: list[dict]
    scores: list[float]
    bestModel: Perceptron

    def transform(self, df: DataFrame) -> DataFrame:
        return self.bestModel.transform(df)


def _plain(df: DataFrame, features: str) -> Column:
    if df.schema[features].dataType.typeName() == "array":
        return F.col(features).cast("array<double>")
    return F.when(F.col(features).isNotNull(), vector_to_array(features))


def _usable(df: DataFrame, features: str, label: str, fold: Column) -> DataFrame:
    rows = df.select(_plain(df, features).alias("v"), F.col(label).cast("int").alias("y"), fold.cast("int").alias("f"))
    return rows.where("v is not null and y is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf'))")


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    points = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return points, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)


def _sums(rows: DataFrame, trials: dict[int, tuple[Shape, np.ndarray, int]]) -> dict[int, tuple[float, np.ndarray, int]]:
    """For each fit: loss, gradient and number of the rows outside its fold, from one pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {i: [0.0, np.zeros(shape.length), 0] for i, (shape, _, _) in trials.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            points, labels, folds = _arrays(batch)
            apart = {}
            for i, (shape, weights, held) in trials.items():
                if held not in apart:
                    apart[held] = (points[folds != held], labels[folds != held])
                mine, truth = apart[held]
                if len(mine):
                    loss, gradient = shape.loss(weights, mine, truth)
                    totals[i][0] += loss
                    totals[i][1] += gradient
                    totals[i][2] += len(mine)
        for i, (loss, gradient, n) in totals.items():
            if not n:
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([np.concatenate([gradient, [loss, n]]).tobytes()])], names=["fit", "s"]
            )

    out = {i: (0.0, np.zeros(shape.length), 0) for i, (shape, _, _) in trials.items()}
    for r in summed(rows.mapInArrow(work, "fit int, s binary"), ["fit"]).collect():
        whole = np.frombuffer(r.s)
        out[r.fit] = (float(whole[-2]), whole[:-2], round(whole[-1]))
    return out


def _step(run: Descent, loss: float, gradient: np.ndarray, n: int, penalty: float, tolerance: float) -> None:
    """Let a fit judge its trial by the sums of a pass over ``n`` rows."""
    if not n:
        run.rests = True
        return
    size, pull = run.shape.squares(run.trial)
    run.judge((loss + penalty * size) / n, (gradient + penalty * pull) / n, tolerance)


def descend(
    rows: DataFrame, fits: Sequence[tuple[Shape, int]], steps: int, penalty: float, tolerance: float, seed: int, held: int = HELD
) -> list[Descent]:
    """Fit each (shape, fold left out) on rows of ``v``, ``y``, ``f``; at most ``steps`` passes, all fits in each.

    When all rows together have at most ``held`` numbers, a task takes all passes of one fit.
    """
    runs = [Descent(shape, shape.first(np.random.default_rng((seed, at)))) for at, (shape, _) in enumerate(fits)]
    ship(rows.sparkSession)
    if (rows.agg(F.sum(F.size("v").cast("long")).alias("n")).first().n or 0) <= held:
        return _descend_apart(rows, runs, [fold for _, fold in fits], steps, penalty, tolerance)
    for _ in range(steps):
        moving = {i: (r.shape, r.trial, fits[i][1]) for i, r in enumerate(runs) if not r.rests}
        if not moving:
            break
        for i, (loss, gradient, n) in _sums(rows, moving).items():
            _step(runs[i], loss, gradient, n, penalty, tolerance)
    return runs


def _descend_apart(rows: DataFrame, runs: list[Descent], folds: Sequence[int], steps: int, penalty: float, tolerance: float) -> list[Descent]:
    """The same passes; each fit has a task, which holds all rows."""
    heavy = sorted(range(len(runs)), key=lambda i: -runs[i].shape.length)  # these begin first
    width = runs[0].shape.sizes[0]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = [pa.array([np.ascontiguousarray(a).tobytes()]) for a in _arrays(batch)]
                yield pa.RecordBatch.from_arrays(cells, names=["v", "y", "f"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for place, *cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = place
                points, labels, marks = (np.frombuffer(b, t) for b, t in zip(cells, (float, np.int32, np.int32)))
                mine = marks != folds[heavy[place]]
                held.append((points.reshape(-1, width)[mine], labels[mine]))
        if at is None:
            return
        points, labels = (np.concatenate(c) for c in zip(*held))
        held.clear()
        run = runs[heavy[at]]
        for _ in range(steps):
            if run.rests:
                break
            loss, gradient, trial = 0.0, np.zeros(run.shape.length), run.trial
            for low in range(0, len(points), STRETCH):
                more, slope = run.shape.loss(trial, points[low : low + STRETCH], labels[low : low + STRETCH])
                loss, gradient = loss + more, gradient + slope
            _step(run, loss, gradient, len(points), penalty, tolerance)
        cells = [pa.array([heavy[at]], pa.int32()), pa.array([run.loss]), pa.array([run.place.tobytes()]), pa.array([run.rests])]
        yield pa.RecordBatch.from_arrays(cells, names=["fit", "loss", "place", "rests"])

    spark = rows.sparkSession
    places = spark.range(len(runs)).select(F.col("id").cast("int").alias("at")).repartitionById(len(runs), "at")
    packed = rows.select("v", "y", "f").mapInArrow(pack, "v binary, y binary, f binary").coalesce(1)
    found = places.hint("shuffle_replicate_nl").crossJoin(packed).mapInArrow(work, "fit int, loss double, place binary, rests boolean")
    for r in found.collect():
        runs[r.fit].loss, runs[r.fit].place, runs[r.fit].rests = r.loss, np.frombuffer(r.place).copy(), r.rests
    return runs


def _held_scores(rows: DataFrame, runs: Sequence[Descent], folds: Sequence[int]) -> list[float]:
    """F1 of class 1 of each fit on the fold it left out, from one pass."""
    fitted = [(i, r.shape, r.place, fold) for i, (r, fold) in enumerate(zip(runs, folds))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((len(fitted), 2), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            points, labels, marks = _arrays(batch)
            for i, shape, weights, held in fitted:
                mine, truth = points[marks == held], labels[marks == held] == 1
                if len(mine):
                    said = shape.forward(weights, mine)[1].argmax(1) == 1
                    cells[i] += (truth & said).sum(), (truth != said).sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(fitted), dtype=np.int32)), pa.array(cells[:, 0]), pa.array(cells[:, 1])], names=["fit", "hit", "wrong"]
        )

    counts = rows.mapInArrow(work, "fit int, hit long, wrong long").groupBy("fit").agg(F.sum("hit").alias("hit"), F.sum("wrong").alias("wrong"))
    scores = [0.0] * len(fitted)
    for r in counts.collect():
        scores[r.fit] = 2 * r.hit / (2 * r.hit + r.wrong) if r.hit else 0.0
    return scores


def perceptrons(
    train: DataFrame, key: Sequence[str], label: str = "label", hidden: Sequence[Sequence[int]] = ((50,), (100,), (50, 50)),
    activations: Sequence[str] = ("relu", "tanh", "logistic"), classes: int = 2, steps: int = 200, folds: int = 3,
    penalty: float = 1e-4, tolerance: float = 1e-4, seed: int = 42, features: str = "features",
) -> PerceptronSearch:
    """Stratified k-fold search over layer sizes and activations by F1 of class 1.

    Features should be standardised first; labels are 0 to ``classes`` - 1. ``steps`` bounds the passes
    over the rows. Ties go to the earlier point, activations first. Without usable rows the search
    raises ValueError.
    """
    marked = stratified_folds(train, label, key, folds, seed)
    rows = _usable(marked, features, label, F.col("fold")).persist()
    try:
        one = rows.select(F.size("v").alias("n")).first()
        if one is None:
            raise ValueError("no rows to fit on")
        points = [{"activation": a, "hidden": tuple(h)} for a in activations for h in hidden]
        shapes = [Shape((one.n, *p["hidden"], classes), p["activation"]) for p in points]
        # fold -1 is no row's: that fit sees them all, in the same passes as the others
        fits = [(shape, fold) for shape in shapes for fold in (*range(folds), -1)]
        runs = descend(rows, fits, steps, penalty, tolerance, seed)
        tried = [i for i, (_, fold) in enumerate(fits) if fold >= 0]
        held = dict(zip(tried, _held_scores(rows, [runs[i] for i in tried], [fits[i][1] for i in tried])))
    finally:
        rows.unpersist()
    each = folds + 1
    scores = [sum(held[at * each + f] for f in range(folds)) / folds for at in range(len(points))]
    best = runs[max(range(len(points)), key=lambda at: (scores[at], -at)) * each + folds]
    return PerceptronSearch(points, scores, Perceptron(best.shape, best.place, best.loss, features))
