import math

import numpy as np
import pytest

from billscope.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"
MOST = (1 << 63) - 1


def integers(v, scale):
    return [math.floor(scale * x) if math.isfinite(scale * x) else int(x) * scale for x in v]


def plain(rows, every, scale, positives=5, wanted=3, low=50, high=95):
    good = [
        (r, i, label, integers(v, scale)) for r, (i, v, label) in enumerate(rows)
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    last = lambda i: (i is None, i or 0)
    out = []
    for r, i, label, q in good:
        if i is None or i % every:
            continue
        scored = [
            (-max(-MOST - 1, min(MOST, sum(a * b for a, b in zip(q, v, strict=True)))), last(j), j, l) for s, j, l, v in good if s != r and len(v) == len(q)
        ]
        mine = sorted(x[:3] for x in scored if x[3] == label)[:positives]
        for p, _, pid in mine:
            near = sorted(x[:3] for x in scored if x[3] != label and low * -p <= 100 * -x[0] <= high * -p)[:wanted]
            out += [(i, pid, rank, nid, -p, -s) for rank, (s, _, nid) in enumerate(near, 1)]
    return sorted(out, key=repr)


def mined(frame, every, scale, **more):
    out = negatives.hard_negatives(frame, f"vec_id % {every} = 0", scale=scale, **more)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("kind", ["spread", "near", "ties", "hot"])
def test_negatives_equal_all_products(spark, monkeypatch, kind):
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "PACK", 3)
    monkeypatch.setattr(negatives, "TASK_PAIRS", 4)
    monkeypatch.setattr(negatives, "STRIDE", 2)
    rng = np.random.default_rng(3)
    if kind == "spread":
        v = rng.normal(size=(160, 7)) * rng.lognormal(0, 1, (160, 1))
    elif kind == "near":
        v = np.repeat(rng.normal(size=(6, 7)), 25, 0) + rng.normal(size=(150, 7)) * 0.1
    elif kind == "ties":
        v = rng.integers(-1, 3, (120, 5)).astype(float)
    else:  # one vector and one label hold a third of the rows
        v = rng.normal(size=(150, 7)) + 1
        v[:50] = v[0]
    labels = [0 if kind == "hot" and i % 3 == 0 else int(x) for i, x in enumerate(rng.integers(0, 4, len(v)))]
    rows = [(i, [float(x) for x in a], b) for i, (a, b) in enumerate(zip(v, labels, strict=True))]
    width = v.shape[1]
    rows += [
        (500, None, 1), (510, [], 1), (520, [1.0, None] + [1.0] * (width - 2), 2), (530, [float("nan")] * width, 2), (540, [float("inf")] * width, 2),
        (550, [1.0] * width, None), (None, [2.0] * width, 1), (None, [2.0] * width, 2), (560, [0.0] * width, 3), (570, [1.0, 2.0], 1), (571, [2.0, 1.0], 1),
        (572, [1.5, 1.0], 2), (573, [1.0, 1.0], 3), rows[10], rows[10], (20, rows[30][1], 3), (9, rows[9][1], 1),
    ]
    assert mined(spark.createDataFrame(rows, SCHEMA), 10, 256) == plain(rows, 10, 256)


def test_long_components_are_exact(spark):
    rows = [
        (0, [3e6, 1.0], 1), (1, [1e6 + 0.125, 7.0], 1), (2, [0.6e6, 3.0], 2), (3, [2.0, 3.0], 2), (4, [1e300, 1.0], 1), (5, [5e299, 0.0], 3),
        (6, [-1e308, 1.0], 2), (7, [2.0**40, 1.0], 1), (8, [2.0**39 + 0.5, 1.0], 2), (9, [1e-9, 5.0], 1), (10, [1.0, 9.0], 3), (11, [1.0, 4.0], 3),
    ]
    assert mined(spark.createDataFrame(rows, SCHEMA), 1, 256) == plain(rows, 1, 256)


def test_windows_and_other_parameters(spark):
    assert negatives.window(7, 50, 95) == (4, 6) and negatives.window(0, 50, 95) == (0, 0)
    low, high = negatives.window(-10, 50, 95)
    assert low > high  # a negative positive score has no window
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=4) + 0.5], i % 3) for i in range(90)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = mined(frame, 7, 100, positives=2, negatives=1, at_least=20, at_most=60)
    assert got == plain(rows, 7, 100, 2, 1, 20, 60) and got
    one = [(i, [1.0, 2.0], 5) for i in range(20)]
    assert mined(spark.createDataFrame(one, SCHEMA), 5, 256) == []  # no other label


def test_clashing_columns_and_no_rows(spark):
    rows = [(i, [float(i % 5), 1.0], i % 2) for i in range(30)]
    clash = spark.createDataFrame(
        [(9, "p", 1, i, v, label, "z", 4) for i, v, label in rows],
        "dim int, part string, row int, vec_id long, embedding array<double>, label int, Label_ string, other int",
    ).withColumnRenamed("Label_", "LABEL")
    assert mined(clash, 10, 256) == plain(rows, 10, 256)
    assert mined(spark.createDataFrame([], SCHEMA), 10, 256) == []
