import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from billscope.llm import best_fit, packing, tokens
from tests.llm.fixtures import awkward, docs, odd_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def some_rows(n=120, seed=3):
    rng = random.Random(seed)
    themes = [["sea", "ship", "wave", "harbour"], ["bread", "oven", "flour", "yeast"], ["court", "judge", "law", "appeal"]]
    rows = [(i, " ".join(rng.choice(rng.choice(themes[i % 3 :][:1])) for _ in range(rng.randint(0, 900)))) for i in range(n)]
    return [*rows, *[(n + i, t) for i, t in enumerate(odd_texts())], (None, "null id"), (0, rows[0][1]), (None, None)]


def whole_ids(rows):
    model = tokens.load(PATH)
    return sorted((str(i), np.append(np.frombuffer(model.encode(t or ""), "<u4"), 0).astype("<u4").tobytes()) for i, t in rows)


def test_each_id_lies_in_one_piece_of_gapless_sequences(spark):
    rows = some_rows()
    pieces = packing.pack(awkward(spark, rows), PATH, window=256).collect()
    sequences: dict[int, list] = {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length and p.length > 0
        sequences.setdefault(p.sequence_id, []).append(p)
    padding = 0
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:i]) for i in range(len(parts))]
        total = sum(p.length for p in parts)
        assert total <= 256
        padding += 0 if total & (total - 1) == 0 else 256 - total
    assert padding == 0
    # pieces of one document, put together by start; rows that repeat an id are told apart by length
    together: dict[tuple, list] = {}
    for p in pieces:
        together.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    want: dict[tuple, list] = {}
    for i, raw in whole_ids(rows):
        want.setdefault((i, len(raw) // 4), []).append(raw)
    for (doc, size), parts in together.items():
        same = want[str(doc), size]
        assert sum(p.length for p in parts) == size * len(same)
        if len(same) == 1:
            assert b"".join(bytes(p.ids) for p in sorted(parts, key=lambda p: p.start)) == same[0]
    assert set(want) == {(str(d), s) for d, s in together}
    assert packing.pack(docs(spark, []), PATH).count() == 0


def test_scores_are_bm25():
    rng = np.random.default_rng(1)
    shard = [rng.integers(0, 30, rng.integers(1, 40)).astype("<u4") for _ in range(20)]
    df = np.array([sum(t in s for s in shard) for t in range(30)])
    idf = np.log(1 + (20 - df + 0.5) / (df + 0.5))
    numbers = packing.Corpus(20, sum(map(len, shard)), idf)
    index = packing.Index(shard, numbers)
    for seed in (0, 7, 19):
        plain = []
        for s in shard:
            norm = packing.K1 * (1 - packing.B + packing.B * len(s) / numbers.mean_length)
            tf = [(t, int((s == t).sum())) for t in set(shard[seed].tolist())]
            plain.append(sum(idf[t] * n * (packing.K1 + 1) / (n + norm) for t, n in tf if n))
        assert np.allclose(index.scores(seed), plain)


def test_frequent_and_rare_tokens_score_alike(monkeypatch):
    rng = np.random.default_rng(2)
    shard = [np.minimum(rng.zipf(1.3, rng.integers(1, 80)), 60_000).astype("<u4") for _ in range(40)]
    numbers = packing.Corpus(90, 4000, np.linspace(0.1, 3, 60_001))
    found = []
    for dense in (1, 5, 16, 1000):
        monkeypatch.setattr(packing, "DENSE", dense)
        index = packing.Index(shard, numbers)
        assert len(index.rows) == sum(n >= dense for n in np.unique(np.concatenate([np.unique(s) for s in shard]), return_counts=True)[1])
        found.append([index.scores(seed) for seed in range(len(shard))])
    for other in found[:-1]:
        assert np.allclose(other, found[-1], rtol=1e-5)


def test_neighbours_fill_the_window():
    sea, oven = np.array([1, 2, 3, 4] * 10, "<u4"), np.array([11, 12, 13, 14] * 10, "<u4")
    items = [(i, 40, 0, sea if i % 2 == 0 else oven) for i in range(8)]
    numbers = packing.Corpus(8, 320, np.ones(20))
    closed, rest = packing.fill(items, 80, numbers)
    assert [sorted(p[0] for p in taken) for taken in closed] == [[0, 2], [1, 3], [4, 6], [5, 7]] and not rest


def test_corpus_counts_all_documents(spark):
    rows = some_rows(30)
    numbers = packing.corpus(packing.tokenized(docs(spark, rows), PATH))
    ids = [np.frombuffer(raw, "<u4") for _, raw in whole_ids(rows)]
    assert numbers.documents == len(rows) and numbers.tokens == sum(map(len, ids))
    assert abs(numbers.idf[0] - np.log(1 + 0.5 / (len(rows) + 0.5))) < 1e-12


def test_best_fit_equals_a_plain_search():
    rng = random.Random(6)
    for _ in range(30):
        sizes = [rng.randint(1, 64) for _ in range(rng.randint(0, 120))]
        rooms: list[int] = []
        for size in sorted(sizes, reverse=True):
            fitting = [r for r in rooms if r >= size]
            if fitting:
                rooms[rooms.index(min(fitting))] -= size
            else:
                rooms.append(64 - size)
        rows = best_fit.best_fit(sizes, 64)
        assert sorted(i for row in rows for i in row) == list(range(len(sizes)))
        assert sorted(64 - sum(sizes[i] for i in row) for row in rows) == sorted(rooms)


def test_matrix_round_trip(spark, tmp_path):
    rows = some_rows(40)
    matrix = best_fit.token_matrix(awkward(spark, rows), PATH, length=128)
    best_fit.write_matrix(matrix, str(tmp_path / "m"))
    for r in spark.read.parquet(str(tmp_path / "m")).collect():
        assert len(r.ids) == 2 * len(r.positions) == 512 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 128
        positions = np.frombuffer(r.positions, "<u2").tolist()
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b] == list(range(b - a))
    segments = best_fit.read_documents(spark, str(tmp_path / "m"))
    got = segments.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "ids"))).alias("s")).where("doc_id > 0").collect()
    want = {i: raw for i, raw in whole_ids(rows)}
    assert {str(r.doc_id): b"".join(bytes(s.ids) for s in r.s) for r in got} == {k: v for k, v in want.items() if k not in ("None", "0")}
    assert best_fit.token_matrix(docs(spark, []), PATH).count() == 0


def test_distinct_ids_and_their_counts():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0, "<u4"), np.array([7], "<u4"), rng.integers(0, 9, 400).astype("<u4"), np.full(5, 65_535, "<u4")):
        want = np.unique(ids, return_counts=True)
        assert all(np.array_equal(a, b) for a, b in zip(packing.distinct(ids), want, strict=True))


def test_ids_come_without_a_list_of_numbers():
    model = tokens.load(PATH)
    calls = []
    model.ranked.encode_ordinary, kept = lambda text: calls.append(text) or [], model.ranked.encode_ordinary
    try:
        for text in ("Art. 5 \u00e9 \U0001f600", "", f"a {tokens.UNUSED} b"):
            assert np.frombuffer(model.encode(text), "<u4").tolist() == model.tokenizer.encode(text, add_special_tokens=False).ids
    finally:
        model.ranked.encode_ordinary = kept
    assert not calls
