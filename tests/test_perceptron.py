"""Perceptrons: gradients, searches that move together, awkward rows."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from billscope.operators import models, perceptron, prep
from billscope.operators.perceptron import ACTIVATIONS, Shape


@pytest.mark.parametrize("activation", sorted(ACTIVATIONS))
@pytest.mark.parametrize("hidden", [(), (5,), (4, 3)])
def test_gradient_equals_finite_differences(activation, hidden):
    draw = np.random.default_rng(3)
    shape = Shape((6, *hidden, 3), activation)
    weights = shape.first(draw)
    points, labels = draw.normal(0, 1, (20, 6)), draw.integers(0, 3, 20)
    loss, gradient = shape.loss(weights, points, labels)
    size, pull = shape.squares(weights)
    assert len(weights) == shape.length and loss > 0
    for at in range(shape.length):
        nudge = np.zeros(shape.length)
        nudge[at] = 1e-6
        up, down = weights + nudge, weights - nudge
        assert gradient[at] == pytest.approx((shape.loss(up, points, labels)[0] - shape.loss(down, points, labels)[0]) / 2e-6, abs=1e-4)
        assert pull[at] == pytest.approx((shape.squares(up)[0] - shape.squares(down)[0]) / 2e-6, abs=1e-6)
    assert size == pytest.approx(0.5 * sum((m**2).sum() for m, _ in shape.layers(weights)))


@pytest.fixture(scope="module")
def ring(spark):
    """Class 1 inside a circle, class 0 outside: no straight border tells them apart."""
    draw = np.random.default_rng(5)
    rows = [(i, float(a), float(b), int(a * a + b * b < 1.2)) for i, (a, b) in enumerate(draw.normal(0, 1, (360, 2)))]
    frame = spark.createDataFrame(rows, "id long, a double, b double, label int")
    return models.assemble(frame.coalesce(2), ["a", "b"]).persist()


def test_search_finds_a_curved_border(ring):
    search = perceptron.perceptrons(ring, ["id"], hidden=((8,), (4, 4)), steps=60)
    table = models.search_table(search).collect()
    assert len(table) == len(search.points) == 6 and any(r.best for r in table)
    assert {p["activation"] for p in search.points} == set(ACTIVATIONS)
    assert max(search.scores) > 0.88
    judged = search.transform(ring)
    assert {r["class"]: r.f1 for r in models.report(judged).collect()}["1"] > 0.93
    sums = judged.select(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda x, y: x + y).alias("s")).distinct().collect()
    assert all(r.s == pytest.approx(1.0) for r in sums)


def test_fits_that_move_together_equal_separate_fits(ring):
    shapes = [(Shape((2, 5, 2), "tanh"), -1), (Shape((2, 3, 2), "logistic"), 1), (Shape((2, 70, 2), "relu"), 0)]
    rows = perceptron._usable(prep.stratified_folds(ring, "label", ["id"]), "features", "label", F.col("fold")).coalesce(1).persist()
    data = rows.collect()
    points, labels, folds = np.array([r.v for r in data]), np.array([r.y for r in data]), np.array([r.f for r in data])
    got = perceptron.descend(rows, shapes, 12, 1e-4, 1e-6, 7)
    for at, ((shape, held), run) in enumerate(zip(shapes, got)):
        alone = perceptron.Descent(shape, shape.first(np.random.default_rng((7, at))))
        mine = folds != held
        for _ in range(12):
            if not alone.rests:
                place = alone.trial
                loss, gradient = shape.loss(place, points[mine], labels[mine])
                size, pull = shape.squares(place)
                alone.judge((loss + 1e-4 * size) / mine.sum(), (gradient + 1e-4 * pull) / mine.sum(), 1e-6)
        assert run.loss == pytest.approx(alone.loss, rel=1e-6) and run.place == pytest.approx(alone.place, rel=1e-4, abs=1e-6)
    scores = perceptron._held_scores(rows, got[1:], [1, 0])
    for score, run, fold in zip(scores, got[1:], (1, 0)):
        said = run.shape.forward(run.place, points[folds == fold])[1].argmax(1)
        truth = labels[folds == fold]
        hit, wrong = int(((said == 1) & (truth == 1)).sum()), int((said != truth).sum())
        assert score == pytest.approx(2 * hit / (2 * hit + wrong) if hit else 0.0)


def test_loss_never_rises_and_rests_at_a_flat_place(spark):
    frame = spark.createDataFrame([(i, [float(i % 2), float(i % 3)], i % 2) for i in range(30)], "id long, features array<double>, label int")
    rows = perceptron._usable(frame.withColumn("fold", F.lit(0)), "features", "label", F.col("fold")).persist()
    losses = [perceptron.descend(rows, [(Shape((2, 2), "tanh"), -1)], n, 1.0, 1e-7, 1)[0] for n in (1, 3, 6, 30)]
    assert [r.loss for r in losses] == sorted((r.loss for r in losses), reverse=True) and losses[-1].rests


def test_rows_that_cannot_be_used(spark, ring):
    bad = spark.createDataFrame(
        [(1, None, 1), (2, [float("nan"), 1.0], 0), (3, [1.0, None], 1), (4, [1.0, 2.0], None), (5, [float("inf"), 0.0], 0)],
        "id long, features array<double>, label int",
    )
    good = ring.select("id", vector_to_array("features").alias("features"), "label")
    search = perceptron.perceptrons(good.unionByName(bad), ["id"], hidden=((3,),), activations=("tanh",), steps=15)
    said = {r.id: r for r in search.transform(bad).collect()}
    assert len(said) == 5 and [i for i, r in said.items() if r.prediction is not None] == [4]
    assert all((r.probability is None) == (r.prediction is None) for r in said.values())
    assert search.transform(bad.where("false")).count() == 0
    with pytest.raises(ValueError):
        perceptron.perceptrons(bad.where("id = 1"), ["id"])


def test_sums_of_a_pass_are_added_as_arrays(spark):
    from billscope.shared import summed

    rows = [(i % 3, i % 2, np.arange(5.0) * i) for i in range(40)]
    frame = spark.createDataFrame([(a, b, bytearray(s.tobytes())) for a, b, s in rows], "fit int, part long, s binary").repartition(7)
    got = {(r.fit, r.part): np.frombuffer(r.s) for r in summed(frame, ["fit", "part"]).collect()}
    want = {}
    for a, b, s in rows:
        want[a, b] = want.get((a, b), 0) + s
    assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)
    assert summed(frame.where("fit > 9"), ["fit", "part"]).count() == 0


def test_small_tables_take_no_job_for_each_pass(ring, monkeypatch):
    shapes = [(Shape((2, 5, 2), "tanh"), -1), (Shape((2, 4, 3, 2), "relu"), 1), (Shape((2, 6, 2), "logistic"), 0)]
    rows = perceptron._usable(prep.stratified_folds(ring, "label", ["id"]), "features", "label", F.col("fold")).persist()
    together = perceptron.descend(rows, shapes, 25, 1e-4, 1e-6, 7, held=0)
    monkeypatch.setattr(perceptron, "STRETCH", 50)
    monkeypatch.delattr(perceptron, "_sums")
    apart = perceptron.descend(rows, shapes, 25, 1e-4, 1e-6, 7)
    for one, other in zip(together, apart):
        assert other.loss == pytest.approx(one.loss, rel=1e-6) and other.place == pytest.approx(one.place, rel=1e-4, abs=1e-5)
