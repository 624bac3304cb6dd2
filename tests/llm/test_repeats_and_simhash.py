import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from billscope.llm import repeats, simhash
from billscope.llm.components import components
from tests.llm.fixtures import awkward, docs, links_by_pairs, odd_texts, repeats_by_counting, scattered


def passages(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    base = "".join(rng.choice("abcde é") for _ in range(500))
    texts = []
    for _ in range(40):
        t = "".join(rng.choice("abcde é") for _ in range(rng.randint(0, 150)))
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 400)
            t += base[a : a + rng.randint(10, 180)] + "".join(rng.choice("xyz") for _ in range(rng.choice([0, 1, 20])))
        texts.append(t)
    return [*texts, "a" * 200, "ab" * 90, texts[3], texts[3], "x" + base, "y" + base, "z" + base + "!", None, ""]


@pytest.mark.parametrize(("length", "seed"), [(40, 1), (64, 2), (71, 3)])
def test_repeats_equal_counting_every_string(spark, length, seed):
    texts = passages(seed)
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    got = repeats.remove_repeats(docs(spark, rows), length).collect()
    want = repeats_by_counting([(t or "").encode() for t in texts], length)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)


def test_repeats_across_tiles_and_a_hot_passage(spark, monkeypatch):
    monkeypatch.setattr(repeats, "TILE", 97)
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdef ") for _ in range(120))
    texts = ["".join(rng.choice("uvwxyz ") for _ in range(rng.randint(0, 300))) + passage + str(i) for i in range(60)]
    got = repeats.remove_repeats(awkward(spark, list(enumerate(texts))), 50).collect()
    want = repeats_by_counting([t.encode() for t in texts], 50)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)


def test_repeats_of_odd_and_no_texts(spark):
    texts = odd_texts()
    got = repeats.remove_repeats(docs(spark, list(enumerate(texts))), 400).collect()
    want = repeats_by_counting([(t or "").encode() for t in texts], 400)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert repeats.remove_repeats(docs(spark, []), 400).count() == 0


def test_cut_text_drops_halved_characters():
    assert repeats.cut_text("aéb", [{"start": 0, "end": 2}]) == "b"
    assert repeats.cut_text("aéb", [{"start": 1, "end": 3}]) == "ab"


def test_passages_count_whole_words():
    raw = b"aa bb cc dd ee"
    assert repeats.passages(raw, [{"start": 0, "end": 8}], 2) == [(0, 8)]
    assert repeats.passages(raw, [{"start": 1, "end": 8}], 2) == []  # "a bb cc": two whole words
    assert repeats.passages(raw, [{"start": 2, "end": 7}], 1) == []  # " bb c"
    assert repeats.passages(raw, [{"start": 1, "end": 2}], 0) == repeats.passages(b"aaaa", [{"start": 1, "end": 3}], 0) == []
    assert repeats.passages(raw, [{"start": 6, "end": 10}, {"start": 9, "end": 14}], 2) == [(6, 14)]
    assert repeats.cut_passages("é bb cc", [{"start": 3, "end": 5}, {"start": 5, "end": 8}], 1) == "é "


def test_remaining_text_beside_its_digest(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdeé ") for _ in range(90))
    rows = [(i, f"x{i}é{passage}é{i}y") for i in range(3)] + [(9, None)]
    got = {r.doc_id: r for r in repeats.remove_repeats(docs(spark, rows), 64, keep="text").collect()}
    assert got[9].text == "" and all(got[i].text == f"x{i}{i}y" for i in range(3))
    assert all(got[i].kept_sha256 == hashlib.sha256(got[i].text.encode()).hexdigest() for i in got)


def slow_fingerprint(text: str | None, words: int) -> int:
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("distance", [0, 1, 3, 4, 6])
def test_links_equal_all_pairs(spark, distance):
    values = scattered(400, distance)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = links_by_pairs(signed, distance)  # bit counts of negative differences agree for equal signs only
    want = {s: r for s, r in zip(signed, map(links_by_pairs(values, distance).get, values), strict=True)}
    for limit, parts in ((simhash.BUCKET, 2), (simhash.BUCKET, 5)) + (((1, 2),) if distance in (3, 4) else ()):
        if limit == 1:  # every bucket takes the way for large ones
            some = sorted(signed)[:60]
            frame = spark.createDataFrame([(v,) for v in some], "fp long")
            unsigned = {v: v % (1 << 64) for v in some}
            roots = links_by_pairs(list(unsigned.values()), distance)
            want = {v: roots[unsigned[v]] for v in some}
        found = components(simhash.links(frame, distance, limit, parts))
        root = {r.node: r.root for r in found.collect()}
        groups: dict[int, set] = {}
        for v, r in want.items():
            groups.setdefault(r, set()).add(v)
        mine: dict[int, set] = {}
        for v in want:
            mine.setdefault(root.get(v, v), set()).add(v)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_near_duplicates_of_documents(spark):
    rng = random.Random(5)
    long = ["".join(rng.choice("abcdefgh ") for _ in range(2500)) for _ in range(8)]
    near = [t.replace(t[100:110], "changed") for t in long]
    rows = [*enumerate([*odd_texts(), *long, *near, *long[:3]]), (3, long[0]), (None, long[1]), (None, "alone and without id")]
    got = simhash.near_duplicates(awkward(spark, rows)).collect()
    prints = [slow_fingerprint(t, 4) for _, t in rows]
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{p:016x}") for (i, _), p in zip(rows, prints, strict=True))
    roots = links_by_pairs(sorted(set(prints)), 4)
    low: dict[int, int | None] = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            low[roots[p]] = min(i, low.get(roots[p], i))
    want = sorted((str(i), str(low.get(roots[p]))) for (i, _), p in zip(rows, prints, strict=True))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(1, 1), (None, 3), (9, 8), (8, 9)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(100, 141)} == {100}
    assert {found[i] for i in [7, *range(200, 260)]} == {7}
    assert found[9] == found[8] == 8 and 3 not in found
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_ignores_only_ascii_case():
    assert simhash.fingerprint("A B c\td", 4) == simhash.fingerprint("a b C d", 4)
    assert simhash.fingerprint("É b c d", 4) != simhash.fingerprint("é b c d", 4)


def test_rounds_settle(spark):
    pairs = spark.range(0, 500).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"))
    found = components(pairs)
    assert found.where("node = 512").first().root == 1
