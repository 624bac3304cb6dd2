"""Vectors learned from the corpus against numpy's decomposition of the same weights."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from billscope.operators import latent, tfidf
from billscope.plans import themes

TOPICS = [
    ["imposto", "renda", "receita", "tributo", "fisco"], ["hospital", "vacina", "saude", "medico", "leito"],
    ["escola", "aluno", "ensino", "professor", "livro"],
]


def corpus(n=150, seed=4):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(TOPICS[i % 3] if rng.random() < 0.9 else rng.choice(TOPICS)) for _ in range(rng.randint(2, 30)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "!"), (0, rows[0][1]), (n + 3, "imposto " * 50_000)]


def weights(spark, rows, model):
    """The weighted rows as a dense matrix, made from the tokens without the library's arrays."""
    df = spark.createDataFrame(rows, "id int, text string").select(
        "id", F.transform(tfidf.tokens(F.col("text")), lambda t: F.pmod(F.xxhash64(t), F.lit(model.width))).alias("b")
    )
    lists = [list(r.b or []) for r in df.collect()]
    counts = np.array([[b.count(i) for i in range(model.width)] for b in lists], float)
    df_ = (counts > 0).sum(0)
    idf = np.where((df_ >= 3) & (df_ <= 0.8 * len(lists)), np.log((len(lists) + 1) / (df_ + 1)) + 1, 0)
    w = counts * idf
    norm = np.sqrt((w * w).sum(1, keepdims=True))
    return np.divide(w, norm, out=np.zeros_like(w), where=norm > 0)


@pytest.fixture(scope="module")
def learned(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id int, text string").repartition(5)
    return rows, df, latent.fit(df, "text", size=6, width=97, rounds=8)


def test_components_are_the_singular_vectors(spark, learned):
    rows, _, model = learned
    a = weights(spark, rows, model)
    u, s, v = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.values, s[:6], rtol=1e-6)
    assert np.allclose(model.components.T @ model.components, np.eye(6), atol=1e-9)
    # no other six directions leave less of the rows
    rest = ((a - a @ model.components @ model.components.T) ** 2).sum()
    assert rest == pytest.approx((s[6:] ** 2).sum(), rel=1e-6)


def test_vectors_are_projections(spark, learned):
    rows, df, model = learned
    a = weights(spark, rows, model) @ model.components
    got = {(r.id, r.text): r.vector for r in model.encode(df, "text").collect()}
    for (i, text), want in zip(rows, a):
        assert np.allclose(got[i, text], want, atol=1e-9)
    assert not any(got[150, None]) and not any(got[151, ""]) and not any(got[152, "!"])


def test_words_of_one_topic_come_near_without_sharing_a_text(spark, learned):
    _, _, model = learned
    words = spark.createDataFrame([(t, w) for t, topic in enumerate(TOPICS) for w in topic], "topic int, w string")
    got = [(r.topic, np.array(r.vector)) for r in model.encode(words, "w").collect()]
    plain = np.array([v / np.linalg.norm(v) for _, v in got])
    near = plain @ plain.T
    same = np.array([[p == q for q, _ in got] for p, _ in got]) & ~np.eye(len(got), dtype=bool)
    other = np.array([[p != q for q, _ in got] for p, _ in got])
    assert near[same].mean() > near[other].mean() + 0.2


def test_lists_of_texts_and_nulls(spark, learned):
    _, _, model = learned
    rows = [(1, ["imposto renda", "", None]), (2, []), (3, None), (4, ["vacina"])]
    got = {r.id: r.v for r in model.encode(spark.createDataFrame(rows, "id int, t array<string>"), "t", "v").collect()}
    one = {r.t: r.v for r in model.encode(spark.createDataFrame([("imposto renda",), ("vacina",)], "t string"), "t", "v").collect()}
    assert got[1] == [one["imposto renda"], [0.0] * 6, [0.0] * 6] and got[2] == [] and got[3] == [] and got[4] == [one["vacina"]]


def test_empty_table_and_stop_words(spark):
    nothing = latent.fit(spark.createDataFrame([], "text string"), "text", size=3, width=11)
    assert nothing.encode(spark.createDataFrame([("a b",)], "text string"), "text").first().vector == [0.0] * 3
    df = spark.createDataFrame([("para imposto",), ("para saude",), ("para escola",)], "text string")
    model = latent.fit(df, "text", size=2, width=1 << 12, words=["para"], min_df=1, max_df=1.0)
    assert (model.idf > 0).sum() == 3
    assert not any(model.encode(spark.createDataFrame([("para",)], "text string"), "text").first().vector)


def test_chains_take_learned_vectors(spark, learned):
    _, df, model = learned
    bills = df.where("id < 60").select("id", F.col("text").alias("ementa")).dropDuplicates(["id"])
    placed = themes.sentence_clusters(bills, model, k=3, starts=3).select("id", "cluster").collect()
    of = {r.id: r.cluster for r in placed}
    most = [max(sum(of[i] == c for i in range(t, 60, 3)) for c in range(3)) for t in range(3)]
    assert min(most) >= 17 and len({max(range(3), key=lambda c: sum(of[i] == c for i in range(t, 60, 3))) for t in range(3)}) == 3
    themed = spark.createDataFrame([(1, ["imposto e renda"], ["tributo", "vacina"])], "id int, sub_ementas array<string>, tokens_temas array<string>")
    assert themes.with_similarity(themed, model).first().similaridade > 0.3


def test_vectors_leave_in_stretches_of_bounded_size():
    sizes = np.array([3, 0, 5000, 4096, 1, 1, 0, 9000, 2] + [1] * 9000)
    parts = list(latent._stretches(sizes))
    assert [s for s, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) == len(sizes)
    assert all(sizes[s : s + n - 1].sum() < latent.VECTORS for s, n in parts)
    assert list(latent._stretches(np.zeros(0, np.int64))) == [] and list(latent._stretches(np.zeros(3, np.int64))) == [(0, 3)]


def test_a_pass_equals_the_dense_product(spark):
    draw = np.random.default_rng(8)
    texts = [draw.integers(0, 3000, 80).tolist() for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "buckets array<int>")
    idf, basis = draw.random(4096) * (draw.random(4096) < 0.9), draw.normal(size=(4096, 9))
    whole = np.zeros((300, 4096))
    for i, cell in enumerate(texts):
        np.add.at(whole[i], cell, 1.0)
    whole *= idf
    whole /= np.linalg.norm(whole, axis=1, keepdims=True)
    assert np.abs(latent._multiply(rows, idf, basis) - whole.T @ (whole @ basis)).max() < 1e-9
