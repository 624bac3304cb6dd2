"""Second-order boosted trees against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from billscope.operators import boosting, models


def table(n=240, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, 3)).astype(float)
    y = ((x[:, 1] > 6) ^ (rng.random(n) < 0.1)).astype(int)
    return x, y


def frame(spark, x, y, more=()):
    rows = [(i, v, int(c)) for i, (v, c) in enumerate(zip(x.tolist(), y))]
    return spark.createDataFrame([*rows, *more], "id int, features array<double>, label int").repartition(4)


def gain(g, h, left, penalty=1.0):
    def part(m):
        return g[m].sum() ** 2 / (h[m].sum() + penalty)

    return part(left) + part(~left) - part(np.ones_like(left))


def test_a_split_is_the_best_of_all(spark):
    x, y = table()
    bad = [(900, None, 1), (901, [1.0, None, 2.0], 1), (902, [float("nan")] * 3, 0), (903, [1.0, 2.0, 3.0], None)]
    df = frame(spark, x, y, bad).withColumn("fold", F.lit(0))
    rows = boosting._usable(df, "features", "label", F.col("fold"))
    edges = boosting._edges(rows, 3, 32)
    fits = [boosting.Growth(2, 0.5, -1), boosting.Growth(1, 1.0, -1)]
    boosting.grow(boosting._binned(rows, edges, 2), fits, 1, 3, 32)
    g, h = 0.5 - y, np.full(len(y), 0.25)
    ways = {(f, c): gain(g, h, x[:, f] <= c) for f in range(3) for c in range(11)}
    feature, cut, value = fits[0].trees[0]
    most = max(ways, key=lambda w: ways[w])
    assert (feature[0], edges[feature[0]][cut[0]]) == most
    left = x[:, most[0]] <= most[1]
    assert np.allclose(fits[1].trees[0][2][1:3], [-g[m].sum() / (h[m].sum() + 1) for m in (left, ~left)])
    for node, mine in ((1, left), (2, ~left)):
        under = {(f, c): gain(g[mine], h[mine], x[mine, f] <= c) for f in range(3) for c in range(11)
                 if min(h[mine & (x[:, f] <= c)].sum(), h[mine & (x[:, f] > c)].sum()) >= 1}
        if feature[node] >= 0:
            assert under[feature[node], edges[feature[node]][cut[node]]] == pytest.approx(max(under.values()), abs=1e-8)


def test_margins_written_anew_change_nothing(spark, monkeypatch):
    x, y = table()
    found = []
    for refresh in (2, 100):
        monkeypatch.setattr(boosting, "REFRESH", refresh)
        rows = boosting._usable(frame(spark, x, y).withColumn("fold", F.lit(0)), "features", "label", F.col("fold"))
        fit = boosting.Growth(2, 0.3, -1)
        boosting.grow(boosting._binned(rows, boosting._edges(rows, 3, 16), 1), [fit], 5, 3, 16)
        found.append(fit.trees)
    for a, b in zip(*found, strict=True):
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and np.allclose(a[2], b[2])


def test_search_finds_the_rule_and_judges_rows(spark):
    x, y = table()
    df = frame(spark, x, y)
    search = boosting.boosted_search(df, ["id"], trees=(4, 2), depths=(1, 2), rates=(0.3,), folds=2, bins=16)
    assert [(p["depth"], p["trees"]) for p in search.points] == [(1, 2), (1, 4), (2, 2), (2, 4)]
    assert min(search.scores) > 0.8
    listed = models.search_table(search).collect()
    assert len(listed) == 4 and any(r.best for r in listed) and listed[1].params == "depth=1, rate=0.3, trees=4"
    nodes = search.bestModel.nodes(["a", "b", "c"])
    assert nodes[0][:4] == (0, 0, "b", 6.0) and {t for t, *_ in nodes} == set(range(len(search.bestModel.fit.trees)))
    judged = search.transform(frame(spark, x, y, [(900, None, 1), (901, [1.0], 0)])).collect()
    assert all(r.prediction is None and r.probability is None for r in judged if r.id >= 900)
    right = sum(r.prediction == r.label for r in judged if r.id < 900)
    assert right / len(y) > 0.85
    with pytest.raises(ValueError):
        boosting.boosted_search(df.where("id < 0"), ["id"], trees=(1,))


def test_plain_rounds_equal_mllib(spark):
    from pyspark.ml.classification import GBTClassifier

    x, y = table()
    df = models.assemble(spark.createDataFrame(
        [(i, *map(float, v), int(b), i % 3) for i, (v, b) in enumerate(zip(x, y))], "id long, a double, b double, c double, label int, fold int"
    ), ["a", "b", "c"]).persist()
    outer, sizes = [{"depth": 2, "rate": 0.3}, {"depth": 3, "rate": 0.1}], [1, 3]
    got = boosting.plain_scores(df, outer, sizes)
    for point, scores in zip(outer, got):
        want = np.zeros(len(sizes))
        for fold in range(3):
            model = GBTClassifier(maxIter=sizes[-1], maxDepth=point["depth"], stepSize=point["rate"], seed=42).fit(df.where(f"fold <> {fold}"))
            margins = models.staged_margins(model, df.where(f"fold = {fold}"), sizes)
            want += models.staged_scores(margins, [(F.get("_margins", F.lit(i)) > 0).cast("int") for i in range(len(sizes))], "label")
        assert scores == pytest.approx(want / 3, abs=1e-12)
    with pytest.raises(ValueError):
        boosting.plain_scores(df.where("id < 0"), outer, sizes)
