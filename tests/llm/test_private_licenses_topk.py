import random
import re

import numpy as np
import pytest

from billscope.llm import licenses, private, topk
from tests.llm.fixtures import awkward, docs, odd_texts

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    def luhn(s):
        total = 0
        for i, c in enumerate(reversed(s)):
            d = int(c) * (1 + i % 2)
            total += d - 9 * (d > 9)
        return total % 10 == 0

    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    parts = ["a", "b.c", "@", "x-1.com", ".", "1", "22", "255", "256", "4111 1111 1111 1111", "4337166598464399", "+1 (555) 123-4567",
             "+", " ", "-", "é", "%", "(", ")", "00", "mail8.example.com", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert private.base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "9" * 300_000, "+" * 300_000, "@" * 300_000, "a." * 150_000 + "@b", "1." * 150_000, "x" * 300_000 + "1"):
        base = private.base_spans(text)
        assert list(private.candidates(text, base)) or True


def planted():
    rng = random.Random(3)
    rows = []
    for i in range(40):
        word = " ".join(rng.choice(["sun", "moon", "tree", "river"]) for _ in range(20))
        if i % 2 == 0:
            rows.append((i, f"{word} please contact user{i}@mail.example.com {word}"))
        elif i % 4 == 1:
            rows.append((i, f"{word} please contact badge-{i:05d}x, {word}"))
        else:
            rows.append((i, f"{word} version v{i}.12345 {word} tree river{i}code"))
    return rows


def test_trusted_contexts_find_unseen_identifiers_only(spark):
    rows = [*planted(), *[(100 + i, t) for i, t in enumerate(odd_texts())], (None, "please contact badge-99999z"), (1, planted()[1][1])]
    got = private.find_private(awkward(spark, rows)).collect()
    assert len(got) == len(rows)
    texts: dict = {}
    for i, t in rows:
        texts.setdefault(i, t or "")
    for r in got:
        words = {texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == private.KINDS.index("id")}
        if r.doc_id is None:
            assert words == {"badge-99999z"}
        elif r.doc_id < 40 and r.doc_id % 4 == 1:
            assert words == {f"badge-{r.doc_id:05d}x"}
        else:
            assert not words
        assert [tuple(s) for s in r.base] == private.base_spans(texts[r.doc_id])
    assert private.find_private(docs(spark, [])).count() == 0


def test_both_ways_of_counting_agree(spark, monkeypatch):
    frame = docs(spark, planted())
    patterns = spark.createDataFrame([("please contact",), ("sun moon",), ("never there",)], "pattern string")
    one = {(r.pattern, r.total) for r in private.count_patterns(frame, patterns).collect()}
    monkeypatch.setattr(private, "CARRIED_PATTERNS", 1)
    assert {(r.pattern, r.total) for r in private.count_patterns(frame, patterns).collect()} == one and len(one) == 2


def test_redaction():
    spans = [{"start": 2, "kind": 0, "end": 5}, {"start": 4, "kind": 4, "end": 7}, {"start": 9, "kind": 3, "end": 10}]
    assert private.redact("0123456789", spans) == "01[EMAIL]78[PHONE]"


def longest(pairs):
    best = [1] * len(pairs)
    for i in range(len(pairs)):
        best[i] = 1 + max((best[j] for j in range(i) if pairs[j][1] < pairs[i][1]), default=0)
    return max(best, default=0)


def test_patience_keeps_the_longest_order():
    rng = random.Random(2)
    for _ in range(100):
        pairs = list(enumerate(rng.sample(range(50), rng.randint(0, 20))))
        found = licenses._increasing(pairs)
        assert len(found) == longest(pairs) and all(a[1] < b[1] for a, b in zip(found, found[1:]))


def test_alignment_is_increasing_and_matches_equal_words():
    rng = random.Random(4)
    for _ in range(100):
        a, b = ([rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 25))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    words = "to be or not to be that is the question".split()
    assert len(licenses.align(["x", *words, "y"], words)) == len(words)


def test_licenses_in_whole_texts(spark):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("charge", "cost").replace("Software", "Program", 1)
    line = licenses.TEMPLATES["GPL-3.0"]
    rows = [(0, "some words. " * 4000 + mit), (1, f"{line}\nprose between\n{line}"), (2, changed), (3, "a license to copy and sell"),
            (None, line), (4, "Licensed " * 500), *[(10 + i, t) for i, t in enumerate(odd_texts())]]
    found: dict = {}
    for r in licenses.scan_licenses(awkward(spark, rows)).collect():
        found.setdefault(r.doc_id, []).append((r.license, r.coverage, r.start, r.end))
    assert [(n, c) for n, c, *_ in found[0]] == [("MIT", 1.0)] and rows[0][1][found[0][0][2] :].startswith("Permission")
    assert sorted((n, c) for n, c, *_ in found[1]) == [("GPL-3.0", 1.0)] * 2
    assert [n for n, *_ in found[2]] == ["MIT"] and 0.8 <= found[2][0][1] < 1
    assert [n for n, *_ in found[None]] == ["GPL-3.0"]
    assert set(found) == {0, 1, 2, None}
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def plain_top(rows, asked, k, scale):
    good = [
        (i, np.floor(scale * np.array(v, np.float32).astype(float)).astype(object)) for i, v in rows
        if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all()
    ]
    out = []
    for q in sorted(set(asked)):
        scores = sorted(
            (-int(sum(int(a) * int(b) for a, b in zip(mine, v))), i)
            for j, mine in good if j == q for i, v in good if i != q and len(v) == len(mine)
        )
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return out


@pytest.mark.parametrize("kind", ["spread", "steep", "ties"])
def test_top_k_equals_all_products(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "BUCKET", 16)
    monkeypatch.setattr(topk, "BLOCK", 4)
    rng = np.random.default_rng(7)
    if kind == "spread":
        vectors = rng.normal(size=(150, 6)) * rng.lognormal(0, 1.5, (150, 1))
    elif kind == "steep":
        vectors = np.repeat(rng.normal(size=(8, 6)), 20, 0) + rng.normal(size=(160, 6)) * 0.02
    else:
        vectors = rng.integers(-1, 2, (120, 4)).astype(float)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(500, None), (501, []), (502, [1.0, None, 1.0]), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (505, [0.0] * vectors.shape[1]),
             (506, [1.0, 2.0]), (507, [2.0, 1.0]), (None, [1.0] * 6), (3, rows[3][1]), (10, rows[10][1])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    asked = [i for i, _ in rows if i is not None and i % 10 == 0 or i in (505, 506)]
    got = topk.top_k(frame, frame.where("vec_id % 10 = 0 or vec_id in (505, 506)"), k=5, scale=64).collect()
    assert sorted(map(tuple, got)) == sorted(plain_top(rows, asked, 5, 64))


def test_top_k_of_large_integers_and_of_nothing(spark):
    rows = [(0, [3e15, 1.0]), (1, [2.0, -1e15]), (2, [1e15, 1.0]), (3, [1e30, 1.0]), (4, [-1e308, 0.0])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, topk.top_k(frame, frame.where("vec_id = 2"), k=9, scale=1).collect()))
    # products that don't fit in a long count as the nearest one
    assert got == [(2, 1, 0, topk.MOST), (2, 2, 3, topk.MOST), (2, 3, 1, 10**15), (2, 4, 4, topk.LEAST)]
    mixed = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [3e6, 0.0], 0), (2, [2.0, 0.0], 0)], "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, topk.top_k(mixed, mixed.where("vec_id in (0, 1)"), k=9, scale=1024).collect()))
    assert got == [(0, 1, 1, 3 * 10**6 * 2**20), (0, 2, 2, 2**21), (1, 1, 2, 6 * 10**6 * 2**20), (1, 2, 0, 3 * 10**6 * 2**20)]
    small = spark.createDataFrame([(0, [3e8, 1.0], 0), (1, [2.0, -1e8], 0), (2, [1e8, 7.0], 0)], "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, topk.top_k(small, small.where("vec_id = 2"), k=9, scale=1).collect()))
    assert got == [(2, 1, 0, 3 * 10**16 + 7), (2, 2, 1, 2 * 10**8 - 7 * 10**8)]
    none = spark.createDataFrame([], VECTORS)
    assert topk.top_k(none, none).count() == 0


def test_top_k_keeps_every_good_row_of_an_id(spark):
    rows = [(5, [None, 1.0]), (5, []), (5, [1.0, 1.0]), (5, [3.0, 0.0]), (6, [2.0, 1.0]), (6, [float("nan"), 9.0]), (7, [0.0, 5.0]), (7, None)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    got = sorted(map(tuple, topk.top_k(frame, frame, k=2, scale=1).collect()))
    assert got == [(5, 1, 6, 6), (5, 2, 7, 5), (6, 1, 5, 6), (6, 2, 7, 5), (7, 1, 5, 5), (7, 2, 6, 5)]


def test_no_break_spaces_count_the_same_in_both_ways(spark, monkeypatch):
    texts = ["bei Tel.\u00a0: +49 30 1234567", "bei\u3000x TEL.\u00a0: 5a", "a\x1cb c\x85d e\vf", "x" * 300 + " \u0130Y " + "x" * 300 + " \u0130y"]
    frame = docs(spark, list(enumerate(texts)))
    wanted = {(p, n) for p, n in ((f"{private._key('x' * 300)} i\u0307y", 2), ("bei tel.\u00a0:", 1), ("bei\u3000x tel.\u00a0:", 1), ("a\x1cb c\x85d", 1), ("c\x85d e", 1))}
    patterns = spark.createDataFrame([(p,) for p, _ in wanted], "pattern string")
    assert {tuple(r) for r in private.count_patterns(frame, patterns).collect()} == wanted
    monkeypatch.setattr(private, "CARRIED_PATTERNS", 1)
    assert {tuple(r) for r in private.count_patterns(frame, patterns).collect()} == wanted
    assert private.Before(texts[0]).pattern(texts[0].index("+")) == "bei tel.\u00a0:"


def test_found_identifiers_bring_new_patterns(spark):
    # a chain of contexts; only the first one stands before addresses
    rows = [(i, f"we please contact user{i}@mail.example.com today") for i in range(100)]
    for step, words in enumerate(["please contact", "badge number", "holder of"]):
        for old in [] if step == 0 else [*range(6)] * 5:
            rows.append((len(rows), f"then {words} link{step - 1}-{old} again"))
        rows += [(len(rows) + k, f"then {words} link{step}-{k} again") for k in range(6)]
    rows += [(900, "link2-3 stands first"), (901, "then some other link2-3 here"), (902, "then some other plain-77 here")]
    kind = private.KINDS.index("id")
    got = {r.doc_id: [t[s.start : s.end] for s in r.spans if s.kind == kind] for r in private.find_private(docs(spark, rows)).collect() for t in [dict(rows)[r.doc_id]]}
    for i, text in rows[100:-3]:
        assert len(got[i]) == 1 and got[i][0].startswith("link"), text
    assert (got[900], got[901], got[902]) == (["link2-3"], ["link2-3"], [])


def test_relatives_and_contained_notices_are_told_apart(spark):
    header = licenses.TEMPLATES["Apache-2.0-header"]
    lines = {n: t for n, t in licenses.TEMPLATES.items() if len(t) < 100}
    rows = [(i, f"prose before {t} and after") for i, t in enumerate(lines.values())]
    rows += [(50, header), (51, header.replace("compliance", "accord")), (52, " some words between ".join(lines.values())), (53, "Licensed under CC BY-SA 4.0.")]
    got: dict = {}
    for r in licenses.scan_licenses(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert [got[i] for i in range(len(lines))] == [[n] for n in lines]
    assert got[50] == got[51] == ["Apache-2.0-header"] and sorted(got[52]) == sorted(lines) and 53 not in got
