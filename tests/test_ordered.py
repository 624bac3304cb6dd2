"""Chunked windows against plain loops, on small tables forced into chunks."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from billscope.operators import ordered
from billscope.operators.keyed import attach, attach_aggregates


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(7)
    # key "hot" holds most rows, and one leading value is shared by a third of them
    return [
        ("hot" if draw.random() < 0.7 else f"k{draw.randrange(5)}", 50 if draw.random() < 0.33 else draw.randrange(100),
         i, draw.choice(["a", "b", None]))
        for i in range(600)
    ]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, t int, i int, v string").repartition(5)


@pytest.mark.parametrize("chunks", [None, 8, 64])
def test_row_numbers(frame, rows, chunks):
    got = {r.i: r.n for r in ordered.row_numbers(frame, ["k"], ["t", "i"], "n", chunks).collect()}
    places = defaultdict(int)
    for k, _, i, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        places[k] += 1
        assert got[i] == places[k]


@pytest.mark.parametrize("chunks", [None, 16])
def test_row_numbers_without_key(frame, rows, chunks):
    got = {r.i: r.n for r in ordered.row_numbers(frame, [], ["t", "i"], "n", chunks).collect()}
    for place, row in enumerate(sorted(rows, key=lambda r: (r[1], r[2])), 1):
        assert got[row[2]] == place


def test_a_repeated_leading_value_is_cut_up(frame):
    sizes = [r["count"] for r in ordered.with_chunks(frame, ["t", "i"], 64).groupBy("_chunk").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 120


def test_few_distinct_values_give_fewer_chunks(spark):
    few = spark.createDataFrame([(1,), (2,), (2,), (None,)], "x int")
    got = {r.x: r["_chunk"] for r in ordered.with_chunks(few, ["x"], 64).collect()}
    assert got[None] == 0 and got[1] <= got[2]


@pytest.mark.parametrize("chunks", [None, 32])
def test_neighbours(frame, rows, chunks):
    cut = ordered.with_chunks(frame, ["t", "i"], chunks)
    before = {r.i: r.p for r in ordered.previous_value(cut, ["k"], ["t", "i"], F.col("v"), "p").collect()}
    after = {r.i: r.p for r in ordered.next_value(cut, ["k"], ["t", "i"], F.col("i"), "p").collect()}
    by_key = defaultdict(list)
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        by_key[k].append((i, v))
    for seq in by_key.values():
        for a, b in zip([None, *seq], seq):
            assert before[b[0]] == (a[1] if a else None)
        for a, b in zip(seq, [*seq[1:], None]):
            assert after[a[0]] == (b[0] if b else None)


@pytest.mark.parametrize("chunks", [None, 16])
def test_quantiles_equal_numpy(frame, rows, chunks):
    got = {r.k: r for r in ordered.quantiles(frame, ["k"], "t", {"a": 0.25, "b": 0.5, "c": 0.9}, chunks).collect()}
    for key in {r[0] for r in rows}:
        values = [r[1] for r in rows if r[0] == key]
        want = np.quantile(values, [0.25, 0.5, 0.9])
        assert [got[key].a, got[key].b, got[key].c] == pytest.approx(list(want))


def test_attach_hot_and_cold_keys(spark, frame, rows):
    values = spark.createDataFrame([("hot", 1), ("k0", 2), ("k9", 3)], "k string, w int")
    for share in (2, 1000):
        weights = frame.groupBy("k").agg(F.count("*").alias("_rows"))
        got = attach(frame, ["k"], values, weights, hot_share=share, check=False).collect()
        assert len(got) == len(rows)
        assert all(r.w == {"hot": 1, "k0": 2}.get(r.k) for r in got)


def test_attach_aggregates_groups_nulls(frame, rows):
    for check in (True, False):
        got = attach_aggregates(frame, ["v"], F.count(F.lit(1)).alias("n"), hot_share=3, check=check).collect()
        counts = defaultdict(int)
        for r in rows:
            counts[r[3]] += 1
        assert len(got) == len(rows) and all(r.n == counts[r.v] for r in got)


def test_at_most(spark):
    frame = spark.range(10)
    assert ordered.at_most(frame, 10) and not ordered.at_most(frame, 9)


def test_only_large_keys_are_cut(frame, rows, monkeypatch):
    monkeypatch.setattr(ordered, "ONE_TASK_ROWS", 100)
    cut = ordered.with_chunks(frame, ["t", "i"], keys=["k"])
    chunks = {r.k: r.n for r in cut.groupBy("k").agg(F.countDistinct("_chunk").alias("n")).collect()}
    assert chunks.pop("hot") > 20 and set(chunks.values()) == {1}
    got = {r.i: r.n for r in ordered.row_numbers(frame, ["k"], ["t", "i"], "n").collect()}
    places = defaultdict(int)
    for k, _, i, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        places[k] += 1
        assert got[i] == places[k]
    monkeypatch.setattr(ordered, "ONE_TASK_ROWS", 500)
    assert "_chunk" not in ordered.with_chunks(frame, ["t", "i"], keys=["k"]).columns
    monkeypatch.setattr(ordered, "HOT_KEY_LIST", 0)
    monkeypatch.setattr(ordered, "ONE_TASK_ROWS", 100)
    whole = ordered.with_chunks(frame, ["t", "i"], keys=["k"])
    assert whole.where("k <> 'hot'").select("_chunk").distinct().count() > 10
