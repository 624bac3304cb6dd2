"""Codes, splits, oversampling, reports and attributions."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from billscope.operators import explain, models, prep
from billscope.operators.neighbours import nearest_vectors


def test_codes_of_unseen_categories(spark):
    train = spark.createDataFrame([("b",), ("a",), ("á",), (None,)], "c string")
    codes = prep.code_table(train, "c")
    assert {r.category: r.code for r in codes.collect()} == {"a": 0, "b": 1, "á": 2}
    test = spark.createDataFrame([("b",), ("zz",), (None,)], "c string")
    got = prep.encode_labels(test, "c", codes, "k")
    assert {r.c: r.k for r in got.collect()} == {"b": 1, "zz": 3, None: 3}
    assert {r.c: r.d for r in prep.decode_labels(got, "k", codes, "d").collect()} == {"b": "b", "zz": None, None: None}


def test_split_and_folds_are_exact_and_repeatable(spark):
    frame = spark.range(503).withColumn("y", (F.col("id") % 7 == 0).cast("int"))
    split = prep.stratified_split(frame, "y", ["id"])
    got = {(r.y, r.is_test): r["count"] for r in split.groupBy("y", "is_test").count().collect()}
    assert got == {(1, True): 14, (1, False): 58, (0, True): 86, (0, False): 345}
    again = prep.stratified_split(frame.repartition(3), "y", ["id"])
    assert {r.id for r in split.where("is_test").collect()} == {r.id for r in again.where("is_test").collect()}
    folds = prep.stratified_folds(frame, "y", ["id"]).groupBy("y", "fold").count().collect()
    assert {r["count"] for r in folds if r.y == 1} == {24}


@pytest.mark.parametrize("cell_rows", [10_000, 40])
def test_neighbours_equal_brute_force(spark, cell_rows):
    draw = np.random.default_rng(9)
    points = np.unique(np.round(draw.normal(0, 1, (400, 3)) * [5, 1, 1], 1), axis=0)
    frame = spark.createDataFrame([([float(x) for x in p], 1) for p in points], "v array<double>, n bigint")
    got = {tuple(r.v): [c.d for c in r.near] for r in nearest_vectors(frame, 5, cell_rows).collect()}
    assert len(got) == len(points)
    for p in points:
        want = np.sort(((points - p) ** 2).sum(axis=1))[1:6]
        assert got[tuple(p)] == pytest.approx(list(want))


def test_smote_reaches_parity_between_parents(spark):
    draw = np.random.default_rng(4)
    rows = [(i, float(draw.normal(0, 1)), float(draw.integers(0, 4)), 0) for i in range(100)]
    rows += [(100 + i, float(draw.normal(5, 1)), float(draw.integers(0, 4)), 1) for i in range(18)]
    rows += [(200 + i, 5.0, 1.0, 1) for i in range(9)]  # copies of one point
    frame = spark.createDataFrame(rows, "id long, a double, b double, y int")
    got = prep.smote(frame, "y", "id", ["a", "b"], whole=["b"]).collect()
    assert sum(r.y == 1 for r in got) == sum(r.y == 0 for r in got) == 100
    few = np.array([r[1:3] for r in rows if r[3] == 1])
    base = {r[0]: np.array(r[1:3]) for r in rows}
    for r in (r for r in got if r.synthetic):
        start = base[r.id]
        near = few[np.argsort(((few - start) ** 2).sum(axis=1), kind="stable")]
        reach = np.sort(((few - start) ** 2).sum(axis=1))[5]
        near = near[((near - start) ** 2).sum(axis=1) <= reach + 1e-9]
        assert near[:, 0].min() - 1e-9 <= r.a <= near[:, 0].max() + 1e-9
        assert r.b == int(r.b)
    again = prep.smote(frame.repartition(5), "y", "id", ["a", "b"], whole=["b"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_standardise_uses_train_statistics(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    test = spark.createDataFrame([(5.0, 7.0)], "a double, b double")
    assert tuple(prep.standardise(train, test, ["a", "b"]).first()) == (3.0, 2.0)


def test_report_and_confusion(spark):
    rows = [(1, 1.0)] * 3 + [(1, 0.0)] * 1 + [(0, 0.0)] * 5 + [(0, 1.0)] * 2
    frame = spark.createDataFrame(rows, "label int, prediction double")
    got = {r["class"]: r for r in models.report(frame).collect()}
    assert (got["1"].precision, got["1"].recall, got["1"].support) == (pytest.approx(0.6), pytest.approx(0.75), 4)
    assert got["accuracy"].f1 == pytest.approx(8 / 11) and got["macro avg"].recall == pytest.approx((0.75 + 5 / 7) / 2)
    cells = {(r.truth, r.predicted): r.n for r in models.confusion(frame, [0, 1, 2]).collect()}
    assert cells[(1, 1)] == 3 and cells[(0, 1)] == 2 and cells[(2, 2)] == 0 and sum(cells.values()) == 11


@pytest.fixture(scope="module")
def labelled(spark):
    draw = np.random.default_rng(1)
    rows = []
    for i in range(240):
        x = draw.normal(0, 1, 3)
        rows.append((i, *map(float, x), int(x[0] + 0.2 * x[1] > 0), i % 2))
    frame = spark.createDataFrame(rows, "id long, a double, b double, c double, label int, period int")
    return models.assemble(frame, ["a", "b", "c"]).persist()


def test_grid_search_and_periods(labelled):
    search = models.logistic(labelled, ["id"], strengths=(0.01, 1.0))
    table = models.search_table(search).collect()
    assert len(table) == 2 and sum(r.best for r in table) == 1
    assert {r["class"]: r.f1 for r in models.report(search.transform(labelled)).collect()}["1"] > 0.9
    fitted, reports = models.period_reports(
        labelled, labelled, "period", [0, 1], lambda rows: models.fixed_forest(rows, trees=5, depth=4)
    )
    assert set(fitted) == {0, 1} and reports.where("class = 'accuracy'").count() == 2


def test_attributions_add_up_to_the_prediction(labelled):
    columns = ["a", "b", "c"]
    model = models.fixed_forest(labelled, trees=10, depth=5)
    reference = explain.background(labelled, columns)
    assert reference.count() == 240
    got = explain.attributions(model, labelled, "id", columns, reference, permutations=6)
    sums = got.groupBy("id").agg((F.sum("phi") + F.first("base")).alias("p"))
    predicted = model.transform(labelled).select("id", F.get(vector_to_array("probability"), F.lit(1)).alias("q"))
    gaps = sums.join(predicted, "id").select(F.abs(F.col("p") - F.col("q")).alias("g")).agg(F.max("g"), F.count("g")).first()
    assert gaps[0] < 1e-9 and gaps[1] == 240
    assert explain.top_features(got, 2).collect()[0].feature == "a"
    steps = explain.row_breakdown(got, "id", 7).orderBy("place").collect()
    assert len(steps) == 3 and abs(steps[0].phi) >= abs(steps[1].phi)
    assert steps[-1].running == pytest.approx(predicted.where("id = 7").first().q)


def test_a_forest_in_stages_scores_like_separate_fits(labelled):
    columns = ["id"]
    search = models.forest(labelled, columns, trees=(4, 2, 7), depths=(None, 2))
    table = {r.params: r for r in models.search_table(search).collect()}
    assert set(table) == {f"depth={d}, trees={n}" for d in (None, 2) for n in (2, 4, 7)} and any(r.best for r in table.values())
    folds = prep.stratified_folds(labelled, "label", columns, 3, 42).persist()
    for depth in (None, 2):
        for sizes in ((2,), (2, 4)):
            scores = []
            for fold in range(3):
                rows, held = folds.where(F.col("fold") != fold), folds.where(F.col("fold") == fold)
                # separate forests of the smaller numbers of trees
                parts = [models.fixed_forest(rows, trees=n - m, depth=depth, seed=42 + i) for i, (n, m) in enumerate(zip(sizes, (0, *sizes)))]
                judged = models.Votes(parts).transform(held)
                scores.append({r["class"]: r.f1 for r in models.report(judged).collect()}["1"])
            assert table[f"depth={depth}, trees={sizes[-1]}"].f1 == pytest.approx(sum(scores) / 3)
    alone = models.fixed_forest(labelled, trees=5, depth=3)
    both = models.Votes([alone]).transform(labelled).select("id", "prediction", vector_to_array("probability").alias("p")).orderBy("id").collect()
    want = alone.transform(labelled).select("id", "prediction", vector_to_array("probability").alias("p")).orderBy("id").collect()
    assert [(r.id, r.prediction) for r in both] == [(r.id, r.prediction) for r in want]
    assert all(a.p == pytest.approx(b.p) for a, b in zip(both, want))
    assert models.report(search.transform(labelled)).where("class = 'accuracy'").count() == 1


def test_boosted_prefixes_equal_separate_fits(labelled):
    from pyspark.ml.classification import GBTClassifier

    long = GBTClassifier(labelCol="label", seed=42, maxIter=6, maxDepth=3, stepSize=0.3).fit(labelled)
    staged = {r.id: r._margins for r in models.staged_margins(long, labelled, (2, 6)).select("id", "_margins").collect()}
    for at, size in enumerate((2, 6)):
        short = GBTClassifier(labelCol="label", seed=42, maxIter=size, maxDepth=3, stepSize=0.3).fit(labelled)
        for r in short.transform(labelled).select("id", vector_to_array("rawPrediction").alias("raw")).collect():
            assert staged[r.id][at] == pytest.approx(r.raw[1], abs=1e-12)
    search = models.boosted(labelled, ["id"], trees=(2, 4), depths=(2,), rates=(0.1, 0.3))
    table = models.search_table(search).collect()
    assert len(table) == 4 and models.report(search.transform(labelled)).where("class = '1'").first().f1 > 0.8
