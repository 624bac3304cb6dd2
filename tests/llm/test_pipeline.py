import random

import public_tokenizers

import corpus_pipeline as pipeline
from billscope.llm import packing, private
from tests.llm.fixtures import WORD, quality_counts
from tests.llm.test_repeats_and_simhash import slow_fingerprint

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_stages_on_planted_documents(spark, tmp_path):
    rng = random.Random(11)
    passage = prose(rng, 90)
    texts = {i: prose(rng, 120) for i in range(30)}
    texts |= {30 + i: texts[i] for i in range(3)}  # copies
    texts |= {40: prose(rng, 60) + passage + prose(rng, 60), 41: prose(rng, 70) + passage + prose(rng, 50)}
    short, long_ = prose(rng, 45), " ".join(rng.choice("abcdefgh") * 3 for _ in range(51))
    texts |= {42 + i: f"{prose(rng, 60)} {short} {prose(rng, 20)}" for i in range(2)}  # too few words, though over 160 bytes
    texts |= {44 + i: f"{prose(rng, 60)} {long_} {prose(rng, 20)}" for i in range(2)}  # 51 words in 203 bytes
    texts |= {50: prose(rng, 80) + " mail me at someone.else@mail3.example.com " + prose(rng, 50), 60: "too short", 61: None}
    junk = {70 + i: " ".join(w + "###" for w in prose(rng, 90).split()) for i in range(30)}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in {**texts, **junk}.items()]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 70), 0) for i in [*range(0, 30), *range(70, 95)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for number, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == pipeline.COLUMNS
        out.write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        seen.append({r.doc_id: r for r in docs.collect()})
        assert docs.count() == len(seen[-1]) and all(r.n_chars == len(r.text) for r in seen[-1].values())
    good, unique, cut, clean = seen
    assert set(good) == {i for i, t in texts.items() if quality_counts(t)[0] >= 50}
    assert set(unique) == set(good) - {30, 31, 32}
    assert len({slow_fingerprint(r.text, 4) for r in unique.values()}) == len(unique)
    for i in (40, 41):
        assert passage not in cut[i].text and cut[i].n_chars == unique[i].n_chars - len(passage)
    assert all(long_ not in cut[i].text and len(cut[i].text) == len(unique[i].text) - len(long_) - 2 for i in (44, 45))
    assert len(short) > pipeline.REPEAT_BYTES and all(short in cut[i].text for i in (42, 43))
    assert all(cut[i].text == unique[i].text for i in cut if i not in (40, 41, 44, 45))
    assert "[EMAIL]" in clean[50].text and not private.base_spans(clean[50].text)
    assert all(clean[i].text == cut[i].text for i in clean if i != 50)
    packed = pipeline.packing_stage(spark, docs, folder).collect()
    assert {p.doc_id for p in packed} == set(clean)
    whole = pipeline.run(spark, folder).collect()
    assert sorted((p.doc_id, p.start, p.length) for p in whole) == sorted((p.doc_id, p.start, p.length) for p in packed)
    assert all(WORD.findall(r.text) for r in clean.values())


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    empty = spark.createDataFrame([], DOCUMENTS)
    clash = spark.createDataFrame([(1, "x", "en", "s", 1, "q", 5, 7)], DOCUMENTS + ", spans string, digest long, kept long")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
        stage(spark, clash, folder).count()
    assert packing.pack(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
