"""Periods, runs and point-in-time look-ups against loops written out here."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from billscope.operators import intervals, ordered

AS_OF = date(2024, 6, 1)


def history(seed, n_keys=40):
    draw = random.Random(seed)
    out = []
    for key in range(n_keys):
        moment = datetime(2023, 1, 1)
        for pos in range(draw.randrange(1, 25)):
            moment += timedelta(hours=draw.choice([0, 0, 30, 400]))
            out.append((key, moment, pos, draw.choice(["open", "close", "both", "none"]), draw.choice(["A", "B", "C", None])))
    return out


@pytest.fixture(scope="module")
def events():
    return history(3)


@pytest.fixture(scope="module")
def frame(spark, events):
    return spark.createDataFrame(events, "id int, ts timestamp_ntz, pos int, kind string, party string").repartition(4)


@pytest.mark.parametrize("chunks", [None, 16, 64])
def test_open_close_periods(frame, events, chunks):
    got = intervals.open_close_periods(
        frame, "id", ["ts", "pos"], F.col("ts").cast("date"), F.col("kind").isin("open", "both"),
        F.col("kind").isin("close", "both"), F.lit(AS_OF), chunks=chunks,
    )
    want = []
    for key in {e[0] for e in events}:
        start = None
        for _, moment, _, kind, _ in sorted((e for e in events if e[0] == key), key=lambda e: (e[1], e[2])):
            if kind in ("open", "both") and start is None:
                start = moment.date()
            elif kind in ("close", "both") and start is not None:
                want.append((key, start, moment.date()))
                start = None
        if start is not None:
            want.append((key, start, AS_OF))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_large_keys_only_give_the_same_intervals(spark, frame, events, monkeypatch):
    """One key ten times as long as the others: only it is cut, and nothing changes."""
    long = [(99, m, 1000 * k + p, kind, party) for k, m, p, kind, party in events]
    both = frame.unionByName(spark.createDataFrame(long, frame.schema))
    day, as_of = F.col("ts").cast("date"), F.lit(AS_OF)

    def results():
        opened = intervals.open_close_periods(
            both, "id", ["ts", "pos"], day, F.col("kind").isin("open", "both"), F.col("kind").isin("close", "both"), as_of
        )
        runs = intervals.value_runs(both, "id", ["ts", "pos"], day, "party", as_of)
        return sorted(map(tuple, opened.collect())), sorted(map(tuple, runs.collect()))

    plain = results()
    monkeypatch.setattr(ordered, "ONE_TASK_ROWS", 60)
    assert results() == plain


@pytest.mark.parametrize("chunks", [None, 16, 64])
def test_value_runs(frame, events, chunks):
    got = intervals.value_runs(
        frame, "id", ["ts", "pos"], F.col("ts").cast("date"), "party", F.lit(AS_OF), chunks=chunks
    )
    want = []
    for key in {e[0] for e in events}:
        current, start = None, None
        for _, moment, _, _, party in sorted((e for e in events if e[0] == key), key=lambda e: (e[1], e[2])):
            if party != current:
                if current is not None:
                    want.append((key, current, start, moment.date()))
                current, start = party, moment.date()
        if current is not None:
            want.append((key, current, start, AS_OF))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_runs_edge_rows(spark):
    rows = [
        (1, 1, "A"), (1, 2, "A"), (1, 3, "B"), (1, 4, "A"),
        (2, 1, None), (2, 2, "A"), (2, 3, None), (2, 4, "A"),
        (3, 1, "Z"),
    ]
    frame = spark.createDataFrame(rows, "id int, t int, v string")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("t"))
    got = intervals.value_runs(frame, "id", ["t"], day, "v", F.lit(AS_OF))
    d = lambda t: date(2024, 1, 1 + t)
    assert sorted(map(tuple, got.collect())) == [
        (1, "A", d(1), d(3)), (1, "A", d(4), AS_OF), (1, "B", d(3), d(4)),
        (2, "A", d(2), d(3)), (2, "A", d(4), AS_OF), (3, "Z", d(1), AS_OF),
    ]


def test_first_value_per_key(frame, events):
    got = intervals.first_value_per_key(frame, "id", ["ts", "pos"], "party", "first").collect()
    first = {}
    for e in sorted(events, key=lambda e: (e[1], e[2])):
        first.setdefault(e[0], e[4])
    assert len(got) == len(events) and all(r["first"] == first[r.id] for r in got)


def spans(spark):
    rows = [
        (1, "A", "2024-01-01", "2024-03-10", 0), (1, "B", "2024-03-10", "2024-05-01", 1),
        (2, "C", "2024-02-15", "2024-02-15", 0), (3, "D", "2024-04-01", "2024-01-01", 0),
        (1, "X", "2024-02-01", "2024-02-20", 2),
    ]
    frame = spark.createDataFrame(rows, "id int, v string, a string, b string, seq int")
    return frame.withColumns({"a": F.col("a").cast("date"), "b": F.col("b").cast("date")})


DAYS = ["2023-12-31", "2024-01-01", "2024-02-15", "2024-03-10", "2024-05-01", "2024-05-02"]


def test_active_on_both_ends_closed(spark):
    days = spark.createDataFrame([(d,) for d in DAYS], "data string")
    got = intervals.active_on(spans(spark), days, start="a", end="b")
    assert sorted((str(r.data), r.v) for r in got.collect()) == [
        ("2024-01-01", "A"), ("2024-02-15", "A"), ("2024-02-15", "C"), ("2024-02-15", "X"),
        ("2024-03-10", "A"), ("2024-03-10", "B"), ("2024-05-01", "B"),
    ]


def test_first_match_takes_the_first_interval_and_keeps_repeats(spark):
    asked = spark.createDataFrame([(k, d) for k in (1, 2, 9) for d in DAYS] + [(1, "2024-03-10")], "id int, data string")
    got = intervals.first_match_on(asked, spans(spark), "id", "v", start="a", end="b", order=["a", "seq"])
    rows = sorted((r.id, str(r.data), r.v) for r in got.collect())
    assert len(rows) == 19
    assert rows.count((1, "2024-03-10", "A")) == 2  # the hand-over day: the old value wins
    assert (1, "2024-02-15", "A") in rows and (1, "2024-05-01", "B") in rows
    assert (2, "2024-02-15", "C") in rows and (9, "2024-01-01", intervals.NOT_FOUND) in rows
    assert (1, "2024-05-02", intervals.NOT_FOUND) in rows


def test_members_in_parts_lose_nothing(spark):
    rows = [("big", i, "PT*" if i % 2 else " PL ") for i in range(95)] + [("small", 1, "XX"), ("small", 2, None)]
    frame = spark.createDataFrame(rows, "g string, id long, partido string")
    listed = intervals.collect_members(frame, ["g"], F.struct("id", "partido"), F.col("id"), "partidos", part_rows=20)
    assert listed.where("g = 'big'").count() > 1
    counted = intervals.bloc_counts(
        listed, "partidos", "partido", {"PT": "E", "PL": "C"}, {"E": "qtd_e", "C": "qtd_c"}
    )
    got = {r.g: (r.qtd_e, r.qtd_c) for r in intervals.sum_parts(counted, ["g"], ["qtd_e", "qtd_c"]).collect()}
    assert got == {"big": (47, 48), "small": (0, 0)}


def test_runs_that_begin_on_one_day_keep_their_order(spark):
    rows = [(1, "2024-01-01 08:00", "Z"), (1, "2024-01-01 09:00", "A"), (1, "2024-01-01 10:00", "M"), (2, "2024-01-05 00:00", "B")]
    events = spark.createDataFrame(rows, "id long, t string, v string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    runs = intervals.value_runs(
        events, "id", ["t"], F.col("t").cast("date"), "v", F.lit("2024-03-01").cast("date"), "a", "b", place="place"
    )
    asked = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-02-01"), (2, "2024-01-01")], "id long, data string")
    asked = asked.withColumn("data", F.col("data").cast("date"))
    got = intervals.first_match_on(asked, runs, "id", "v", start="a", end="b", order=["place"])
    assert {(r.id, str(r.data)): r.v for r in got.collect()} == {
        (1, "2024-01-01"): "Z", (1, "2024-02-01"): "M", (2, "2024-01-01"): intervals.NOT_FOUND
    }


def test_intervals_of_centuries_are_cut_to_the_days_asked(spark):
    rows = [(1, "A", "1500-01-01", "2024-03-10", 0), (1, "B", "2024-03-10", "2600-01-01", 1), (2, "C", "1000-01-01", "1900-01-01", 0)]
    frame = spark.createDataFrame(rows, "id int, v string, a string, b string, seq int")
    frame = frame.withColumns({"a": F.col("a").cast("date"), "b": F.col("b").cast("date")})
    asked = spark.createDataFrame([(k, d) for k in (1, 2) for d in DAYS], "id int, data string")
    days = asked.select(F.col("data").cast("date").alias("_d"))
    assert intervals._spread(frame, days, "a", "b").count() == 4 + 3
    assert intervals._spread(frame, days.where("false"), "a", "b").count() == 0
    got = intervals.first_match_on(asked, frame, "id", "v", start="a", end="b", order=["seq"])
    assert {(r.id, str(r.data)): r.v for r in got.collect()} == {
        **{(1, d): "A" if d <= "2024-03-10" else "B" for d in DAYS}, **{(2, d): intervals.NOT_FOUND for d in DAYS},
    }
    assert intervals.first_match_on(asked.where("false"), frame, "id", "v", start="a", end="b").count() == 0
