import random

import pytest
from pyspark.sql import functions as F

from billscope.llm import quality
from tests.llm.fixtures import awkward, docs, odd_texts, quality_counts

LABELS = "doc_id long, quality int, toxic int"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_counts_of_whole_texts(spark):
    rng = random.Random(4)
    texts = [*odd_texts(), "a b c a b c d", "x\ty\x0bz\x0c q\r\nx\ty", "l\nl\n\n l\nl", "#a *b $%& |<>", "a b c d " * 7 + "é é é é"]
    for _ in range(60):
        lines = [prose(rng, rng.randint(1, 9)) for _ in range(rng.randint(1, 6))]
        texts.append(rng.choice(["\n", " ", "\n\n"]).join(rng.choice(lines) for _ in range(12)))
    rows = [*enumerate(texts), (None, "no id at all")]
    got = quality.text_statistics(awkward(spark, rows)).collect()
    assert sorted((str(r.doc_id), *(r[c] for c in quality.BASE)) for r in got) == sorted((str(i), *quality_counts(t)) for i, t in rows)
    assert quality.text_statistics(docs(spark, [])).count() == 0


def labelled(spark, n=400):
    """Half prose, half prose with symbols; labels follow the symbols."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        bad = i % 2
        words = prose(rng, rng.randint(60, 120)).split(" ")
        rows.append((i, " ".join(w + "$$$" * (bad and rng.random() < 0.4) for w in words)))
        if i % 3:
            labels.append((i, 1 - bad, 0))
    return docs(spark, rows), spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (10**9, 0, 1)], LABELS)


def test_learned_list_separates_unseen_documents(spark):
    rows, labels = labelled(spark)
    judged = quality.judge(rows, labels).collect()
    unseen = [r for r in judged if r.doc_id % 3 == 0]
    assert not any(r.base_failed for r in unseen)
    assert sum(r.kept == (r.doc_id % 2 == 0) for r in unseen) >= 0.99 * len(unseen)


def test_sequential_covering_finds_both_kinds(spark):
    rows = [(x / 50, y / 50, int(x > 40 or (y > 30 and x < 20)), (7 * x + y) % 3) for x in range(50) for y in range(50)]
    frame = spark.createDataFrame(rows, "a double, b double, low int, part long")
    found = quality.learn(frame, statistics=["a", "b"], precision=0.9)
    wrong = frame.withColumn("rejected", found.rule().isNotNull()).where(F.col("rejected") != (F.col("low") == 1)).count()
    assert 2 <= len(found.rules) <= 4 and wrong <= 0.04 * len(rows)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(0, 0, 0), (1, 0, 0)]])
def test_without_two_classes_only_the_base_rule_rejects(spark, labels):
    rng = random.Random(2)
    rows = [(0, prose(rng, 80)), (1, prose(rng, 90)), (2, "short"), (3, "again and again " * 30), (4, None)]
    judged = {r.doc_id: r for r in quality.judge(docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    assert {i for i, r in judged.items() if r.kept} == {0, 1}
    assert {i for i, r in judged.items() if r.base_failed} == {2, 3, 4}


def test_no_documents(spark):
    assert quality.judge(docs(spark, []), spark.createDataFrame([(1, 0, 0)], LABELS)).count() == 0


def test_main_path_has_no_python(spark):
    rows, labels = labelled(spark, 30)
    text = quality.judge(rows, labels)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Python", "Arrow", "Pandas"))
