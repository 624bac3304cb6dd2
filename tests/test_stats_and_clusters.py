"""Statistics, shares, cluster metrics and text similarity against brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from billscope.operators import clusters, embed, kmeans, shares, sparse_kmeans, stats, tfidf

# Golden case: dominant theme per cluster in, roll-up out.
GOLDEN_IN = {
    "Direito Penal e Processual Penal": "8:60 12:9 23:1 34:24 39:11 41:19",
    "Direitos Humanos e Minorias": "15:9 20:10 26:16 28:10 29:10 35:15 38:7 42:8 45:7 47:12",
    "Finanças Públicas e Orçamento": "3:1 6:6 7:14 11:1 25:7 30:16 36:23",
    "Direito Civil e Processual Civil": "1:6 9:1 10:15 16:19 27:5 49:6",
    "Trabalho e Emprego": "0:22 5:2 14:3",
    "Direito e Defesa do Consumidor": "19:9 32:3 33:3 40:7",
    "Meio Ambiente e Desenvolvimento Sustentável": "43:16",
    "Educação": "4:8 13:4 22:2 44:1",
    "Viação": "48:8",
    "Defesa e Segurança": "2:2 31:5",
    "Saúde": "21:3 24:1",
    "Energia": "37:3",
    "Processo Legislativo e Atuação Parlamentar": "18:3",
    "Comunicações": "17:2",
    "Administração Pública": "46:1",
}
GOLDEN_OUT = [(124, 27.19), (104, 22.81), (68, 14.91), (52, 11.4), (27, 5.92), (22, 4.82), (16, 3.51), (15, 3.29),
              (8, 1.75), (7, 1.54), (4, 0.88), (3, 0.66), (3, 0.66), (2, 0.44), (1, 0.22)]


def test_theme_rollup_golden(spark):
    rows = [(int(c), t, int(n)) for t, cells in GOLDEN_IN.items() for c, n in (x.split(":") for x in cells.split())]
    got = shares.theme_rollup(spark.createDataFrame(rows, "cluster int, theme string, freq long")).collect()
    assert [(r.freq_total, r.pct_total) for r in got] == GOLDEN_OUT
    assert {r.theme for r in got} == set(GOLDEN_IN)
    assert got[0].clusters == [8, 12, 23, 34, 39, 41]


def test_mode_takes_the_first_seen_on_a_tie(spark):
    rows = [(0, "b", 1), (0, "a", 2), (0, "a", 3), (0, "b", 4), (1, "x", 9), (2, None, 1)]
    got = shares.mode_with_share(spark.createDataFrame(rows, "c int, t string, pos int"), "c", "t", ["pos"])
    assert {r.c: (r.theme, r.freq, r.pct) for r in got.collect()} == {0: ("b", 2, 50.0), 1: ("x", 1, 100.0)}


def test_rates_and_row_shares_with_zero_totals(spark):
    counts = spark.createDataFrame([("a", 0, 0, "L"), ("b", 4, 1, "L"), ("c", 2, 2, None)], "p string, submitted long, approved long, bloc string")
    rated = stats.rate_by_group(counts.drop("bloc"), F.when(F.col("p") != "c", "L"))
    assert [(r.p, r.rate) for r in rated.collect()] == [("b", 25.0)]
    assert [tuple(r) for r in stats.rate_two_level(counts, "bloc").collect()] == [("L", 4, 1, 25.0)]
    wide = spark.createDataFrame([(1, 3, None), (0, 0, 0)], "x int, y int, z int")
    got = stats.row_shares(wide, ["x", "y", "z"]).collect()
    assert (got[0].total, got[0].x, got[0].y, got[0].z) == (4, 25.0, 75.0, None)
    assert (got[1].total, got[1].x) == (0, None)


def test_histogram_bounds(spark):
    values = [0.0, 0.0, 29.99, 30.0, 15.0, None]
    got = {r.bin: r["count"] for r in stats.histogram(spark.createDataFrame([(v,) for v in values], "x double"), "x").collect()}
    assert len(got) == 30 and got[1] == 2 and got[30] == 2 and got[16] == 1 and sum(got.values()) == 5
    flat = stats.histogram(spark.createDataFrame([(4.0,), (4.0,)], "x double"), "x").collect()
    assert sum(r["count"] for r in flat) == 2


def test_density_equals_direct_sum(spark):
    draw = random.Random(2)
    values = [draw.gauss(0, 3) for _ in range(80)] + [1.0] * 5
    got = stats.density(spark.createDataFrame([(v,) for v in values], "x double"), "x", 20).orderBy("point").collect()
    a = np.array(values)
    h = a.std(ddof=1) * len(a) ** -0.2
    for r, x in zip(got, np.linspace(a.min(), a.max(), 20)):
        want = np.exp(-(((a - x) / h) ** 2) / 2).sum() / (len(a) * h * math.sqrt(2 * math.pi))
        assert r.x == pytest.approx(x) and r.density == pytest.approx(want)


def test_box_stats(spark):
    rows = [("g", float(v)) for v in (1, 2, 3, 4, 5, 100)] + [("h", 1.0)] + [(None, 3.0)]
    got = {r.g: r for r in stats.box_stats(spark.createDataFrame(rows, "g string, x double"), "g", "x").collect()}
    assert set(got) == {"g", "h"}
    assert (got["g"].median, got["g"].whisker_low, got["g"].whisker_high, got["g"].outliers) == (3.5, 1.0, 5.0, 1)


def test_funnel_and_shares_add_up(spark):
    frame = spark.range(100).withColumn("k", (F.col("id") % 3).cast("string"))
    steps = [r.rows for r in stats.funnel(frame, {"even": F.col("id") % 2 == 0, "small": F.col("id") < 10}).collect()]
    assert steps == [100, 50, 5]
    assert stats.share_of_total(frame, "k").agg(F.sum("share")).first()[0] == pytest.approx(100)


def brute_silhouette(points):
    out = []
    for i, (x, c) in enumerate(points):
        per = {}
        for j, (y, d) in enumerate(points):
            if i != j:
                per.setdefault(d, []).append(abs(x - y))
        if c not in per:
            out.append(0.0)
            continue
        a = sum(per[c]) / len(per[c])
        b = min(sum(v) / len(v) for d, v in per.items() if d != c)
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return sum(out) / len(out)


@pytest.mark.parametrize("chunks", [None, 8, 64])
def test_silhouette_equals_brute_force(spark, chunks):
    draw = random.Random(5)
    mixed = [(round(draw.random() * 10, 1), draw.randrange(4)) for _ in range(150)] + [(99.0, 7)]
    banded = [(x, int(x // 3)) for x, _ in mixed]
    for points in (mixed, banded):
        frame = spark.createDataFrame(points, "x double, c int")
        assert clusters.silhouette_1d(frame, "x", "c", chunks).first()[0] == pytest.approx(brute_silhouette(points), abs=1e-12)


def test_vector_metrics(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(v) for v in draw.normal(i % 3, 1, 4)], i % 3) for i in range(90)]
    frame = spark.createDataFrame(rows, "i int, v array<double>, c int")
    x, c = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    mean = {k: x[c == k].mean(axis=0) for k in range(3)}
    spread = {k: np.linalg.norm(x[c == k] - mean[k], axis=1).mean() for k in range(3)}
    db = np.mean([max((spread[i] + spread[j]) / np.linalg.norm(mean[i] - mean[j]) for j in range(3) if j != i) for i in range(3)])
    assert clusters.davies_bouldin(frame, "v", "c").first()[0] == pytest.approx(db)
    between = sum((c == k).sum() * ((mean[k] - x.mean(axis=0)) ** 2).sum() for k in range(3))
    within = sum(((x[c == k] - mean[k]) ** 2).sum() for k in range(3))
    assert clusters.calinski_harabasz(frame, "v", "c").first()[0] == pytest.approx((between / 2) / (within / 87))
    centroids = clusters.centroids_of(frame, "v", "c").select(F.col("c").alias("cluster"), "centroid")
    got = {r.i: r.cluster for r in clusters.nearest_centroid(frame.select("i", "v"), "v", centroids).collect()}
    for i, v, _ in rows:
        assert got[i] == min(range(3), key=lambda k: (np.linalg.norm(np.array(v) - mean[k]), k))


def test_agreement_of_equal_and_unrelated_labels(spark):
    same = spark.createDataFrame([(i % 3, str(i % 3)) for i in range(30)], "a int, b string")
    assert clusters.adjusted_rand(same, "a", "b").first()[0] == pytest.approx(1)
    assert clusters.normalized_mutual_info(same, "a", "b").first()[0] == pytest.approx(1)
    crossed = spark.createDataFrame([(i % 3, i // 3) for i in range(9)], "a int, b int")
    assert clusters.normalized_mutual_info(crossed, "a", "b").first()[0] == pytest.approx(0, abs=1e-12)
    assert clusters.adjusted_rand(crossed, "a", "b").first()[0] < 0


def test_tfidf_long_and_vector_forms_agree(spark):
    texts = ["a casa azul casa", "casa verde e azul", "céu azul e casa", "verde mar", "", "mar mar azul"]
    frame = spark.createDataFrame(list(enumerate(texts)), "d int, t string")
    words = ["verde"]
    rows = tfidf.tfidf(frame, "d", "t", words, min_df=2, max_df=0.8).collect()
    long = {}
    for r in rows:
        long.setdefault(r.d, []).append(r.weight)
    assert {r.term for r in rows} == {"casa", "azul", "mar"}
    vectors = tfidf.tfidf_vectors(frame, "t", words=words, min_df=2, max_df=0.8).collect()
    for r in vectors:
        assert sorted(r.features.values) == pytest.approx(sorted(long.get(r.d, [])))
    idf = math.log(7 / 3) + 1
    assert [r.weight for r in rows if r.d == 3] == pytest.approx([1.0])
    assert idf > 1


def test_similarity_rows_do_not_affect_each_other(spark):
    rows = [
        (1, ["ab", "cccc"], ["ab", "c"]), (2, ["abc"], []), (3, [], ["a"]), (4, ["zz", "9"], ["z"]),
    ]
    frame = spark.createDataFrame(rows, "i int, parts array<string>, themes array<string>")
    got = {r.i: r.similarity for r in embed.weighted_best_similarity(
        frame, "parts", embed.letter_profiles(F.col("parts")), embed.letter_profiles(F.col("themes"))
    ).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == 0.0 and got[3] == 0.0 and got[4] == pytest.approx(2 / 3)


def test_encoders(spark):
    frame = spark.createDataFrame([(1, "Educação", ["a", "bb"]), (2, "educação", []), (3, None, None)], "i int, t string, l array<string>")
    got = {r.i: r.vector for r in embed.encode(frame.where("t is not null"), "t", size=32).collect()}
    assert got[1] == got[2] and sum(v * v for v in got[1]) == pytest.approx(1)
    size = lambda texts: np.array([[len(t), 1.0] for t in texts])
    assert [r.vector for r in embed.encode_with(frame, "t", size).orderBy("i").collect()] == [[8, 1], [8, 1], [0, 1]]
    assert [r.vector for r in embed.encode_with(frame, "l", size).orderBy("i").collect()] == [[[1, 1], [2, 1]], [], []]


def test_sweep_picks_the_true_number_of_bands(spark):
    rows = [(band * 100 + i * 0.01,) for band in range(3) for i in range(20)]
    best, table, model = clusters.k_sweep(spark.createDataFrame(rows, "x double"), "x", ks=(2, 3, 5), starts=2)
    assert best == 3 and table.count() == 3 and len(model.clusterCenters()) == 3


def slow_lloyd(points, weights, centres, rest):
    rounds = 0
    while True:
        rounds += 1
        near = ((points[:, None, :] - centres[None]) ** 2).sum(2)
        at = near.argmin(1)
        after = np.array([np.average(points[at == c], axis=0, weights=weights[at == c]) if (at == c).any() else centres[c] for c in range(len(centres))])
        moved = ((after - centres) ** 2).sum()
        centres = after
        if moved <= rest:
            return centres, (((points[:, None, :] - centres[None]) ** 2).sum(2).min(1) * weights).sum()


@pytest.mark.parametrize("width", [1, 3, 70])
def test_runs_together_equal_runs_alone(spark, width):
    draw = np.random.default_rng(width)
    points = np.round(draw.normal(size=(120, width)) + draw.integers(0, 3, (120, 1)) * 4, 3)
    weights = draw.integers(1, 4, 120).astype(float)
    rows = [([float(v) for v in p], float(w)) for p, w in zip(points, weights, strict=True)] + [(None, 1.0), ([float("nan")] * width, 1.0)]
    frame = spark.createDataFrame(rows, "v array<double>, w double").repartition(4)
    got = kmeans.kmeans_runs(frame, "v", [2, 4], starts=3, weight="w", tolerance=0.0)
    # the sample holds all rows, so the same draws give the same starts
    order = {tuple(r.v): i for i, r in enumerate(frame.where("v is not null").orderBy(F.xxhash64("v", F.lit(42)), "v").collect())}
    at = np.argsort([order[tuple(float(x) for x in p)] for p in points])
    for k, run in got.items():
        starts = [kmeans._first(points[at], weights[at], k, np.random.default_rng((42, k, s))) for s in range(3)]
        centres, cost = min((slow_lloyd(points, weights, c, 0.0) for c in starts), key=lambda r: r[1])
        assert run.cost == pytest.approx(cost) and run.values == pytest.approx(kmeans._sorted(centres))
    if width == 1:
        one = frame.select(F.get("v", F.lit(0)).alias("x"))
        placed = one.select("x", got[4].place(F.col("x")).alias("c")).collect()
        line = got[4].values[:, 0]
        assert all((r.c is None) == (r.x is None) for r in placed)
        assert all(r.c == np.abs(line - r.x).argmin() for r in placed if r.x is not None and r.x == r.x)
    assert kmeans.kmeans_runs(frame.where("w > 9"), "v", [2]) == {}


def test_silhouettes_of_several_clusterings_at_once(spark):
    draw = random.Random(6)
    points = [(round(draw.random() * 10, 1), draw.randrange(4), g) for g in range(3) for _ in range(60)]
    frame = spark.createDataFrame(points, "x double, c int, g int")
    got = {r.g: r.silhouette for r in clusters.silhouette_1d(frame, "x", "c", by="g").collect()}
    for g in range(3):
        assert got[g] == pytest.approx(brute_silhouette([p[:2] for p in points if p[2] == g]), abs=1e-12)
    assert clusters.silhouette_1d(frame.where("g > 5"), "x", "c").first()[0] is None


def test_many_centroids_travel_in_parts(spark):
    centroids = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "cluster int, centroid array<double>")
    frame = spark.createDataFrame([(i, [i * 0.7, 1.0]) for i in range(28)], "id int, v array<double>")
    whole = clusters.nearest_centroid(frame, "v", centroids).select("id", "cluster", "distance").collect()
    parts = clusters.nearest_centroid(frame, "v", centroids, limit=3).select("id", "cluster", "distance").collect()
    assert sorted(whole) == sorted(parts)


def test_a_round_on_the_line_equals_a_look_up_of_each_value(spark):
    rng = np.random.default_rng(5)
    x, w = np.round(rng.normal(0, 9, 40_000), 2), rng.integers(1, 4, 40_000).astype(float)
    frame = spark.createDataFrame(pd.DataFrame({"x": x, "w": w})).select(F.array("x").alias("v"), "w")
    # a centre without values, equal centres, and values on a border
    centres = {0: np.array([[-1e6], [-3.0], [0.0], [1.0], [1.0], [7.5]]), 1: np.array([[0.25]])}
    line = kmeans._line(frame).persist()
    assert line.count() < 16  # rounds pass over chunks, not over values
    got = kmeans._line_round(line, centres, True)
    line.unpersist()
    for i, (size, total, cost) in kmeans._round(frame, centres).items():
        assert np.array_equal(got[i][0], size) and sum(got[i][3]) == len(x)
        assert np.allclose(got[i][1], total, rtol=1e-12, atol=1e-9) and np.isclose(got[i][2], cost, rtol=1e-12)


def test_partitions_of_counted_texts_grow_with_their_characters(spark):
    rows = spark.range(40).select("id", F.expr("repeat('ab ', 1 << 20)").alias("t"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tfidf.dealt(rows, "t") == max(least, -(-40 * 3 * (1 << 20) // tfidf.DEALT))
    assert tfidf.dealt(spark.range(400).select("id", F.expr("repeat('ab ', 1 << 20)").alias("t")), "t") == 75
    assert tfidf.dealt(rows.where("id < 0"), "t") == least


def test_sparse_kmeans_is_at_rest_and_best(spark):
    draw = np.random.default_rng(4)
    rows = []
    for i in range(90):
        own = draw.choice(8, 4, replace=False) + 10 * (i % 3)
        w = draw.uniform(1, 2, 4)
        rows += [(i * 7, f"t{t}", float(v)) for t, v in zip(own, w / np.sqrt((w**2).sum()))]
    weights = spark.createDataFrame(rows, "row long, term string, weight double")
    every = spark.createDataFrame([(i * 7,) for i in range(92)], "row long")  # the last two have no weight
    got = {r.row: r.cluster for r in sparse_kmeans.kmeans_sparse(weights, every, 4, starts=5).collect()}
    assert len(got) == 92 and set(got.values()) <= set(range(4))
    names = sorted({t for _, t, _ in rows})
    x = np.zeros((92, len(names)))
    for i, t, v in rows:
        x[i // 7, names.index(t)] = v
    at = np.array([got[i * 7] for i in range(92)])
    centres = np.array([x[at == c].mean(0) for c in range(4)])
    away = ((x[:, None] - centres) ** 2).sum(2)
    assert (away[np.arange(92), at] <= away.min(1) + 1e-9).all()
    # the three kinds of rows stay apart
    assert all(len({i % 3 for i in range(90) if at[i] == c}) == 1 for c in set(at[:90]) if c != at[91])
    again = {r.row: r.cluster for r in sparse_kmeans.kmeans_sparse(weights.repartition(5), every, 4, starts=5).collect()}
    assert again == got


def test_sparse_kmeans_of_few_rows_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(sparse_kmeans, "GROUP_ROWS", 4)
    monkeypatch.setattr(sparse_kmeans, "BLOCK_TERMS", 1)
    rows = [(i, f"t{i % 2}", 1.0) for i in range(12)]
    weights = spark.createDataFrame(rows, "row long, term string, weight double")
    got = sparse_kmeans.kmeans_sparse(weights, weights.select("row"), 5, starts=2).collect()
    assert len(got) == 12 and len({(r.row % 2, r.cluster) for r in got}) == 2
    assert sparse_kmeans.kmeans_sparse(weights.where("row > 99"), weights.select("row"), 3, starts=1).select("cluster").distinct().count() == 1
    assert sparse_kmeans.kmeans_sparse(weights.where("row > 99"), weights.select("row").where("row > 99"), 3).count() == 0
