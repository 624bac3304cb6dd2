import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from billscope.llm import lines, manifest
from tests.llm.fixtures import awkward, docs, odd_texts

BLANKS = " \t\n\v\f\r"


def key_of(line: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def plain_lines(rows, least, shortest):
    """(doc_id, n_lines, n_dropped, kept) of each row."""
    low = -(1 << 70)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key_of(line)].add(low if i is None else i)
    out = []
    for i, text in rows:
        all_lines = (text or "").split("\n")
        kept = [
            x for x in all_lines
            if len(key_of(x)) < shortest or len(holders[key_of(x)]) < least or max(holders[key_of(x)]) == (low if i is None else i)
        ]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found_lines(frame, least, shortest):
    return sorted((tuple(r) for r in lines.dedup_lines(frame, least, shortest).collect()), key=repr)


def shared_rows(seed):
    rng = random.Random(seed)
    stock = [f"{w} Éa shared LINE of some length {i}" for i, w in enumerate(["a", "Ä", "漢", "x" * 3000, " pad "])]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(stock) if rng.random() < 0.6 else f"own {i} {rng.random()}"
            line = line.lower() if line.isascii() and rng.random() < 0.5 else line
            parts.append(rng.choice(["", " ", "\t\f", "\v"]) + line + rng.choice(["", "\r", "  "]))
        rows.append((i if i % 11 else None, "\n".join(parts)))
    rows += [(100 + i, t) for i, t in enumerate(odd_texts())]
    rows += [(7, rows[8][1]), (7, rows[8][1]), (200, "\n".join([stock[0]] * 400 + ["end"])), (201, "\n" * 5000 + stock[1])]
    return rows


@pytest.mark.parametrize("way", ["plain", "large"])
def test_lines_equal_counting(spark, monkeypatch, way):
    if way == "large":  # the ways taken where tables are too long to be sent around
        monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(lines, "CARRIED_ROWS", 0)
    rows = shared_rows(3)
    assert found_lines(docs(spark, rows), 5, 20) == plain_lines(rows, 5, 20)
    assert found_lines(awkward(spark, rows), 3, 1) == plain_lines(rows, 3, 1)


def test_a_hot_line_and_the_edges_of_the_rule(spark):
    line = "L" * 40
    rows = [(i, f"{line}\nrow {i}\n{line.lower()}") for i in range(300)] + [(900, line[:-1]), (901, f" {line}")]
    got = {r.doc_id: r for r in lines.dedup_lines(docs(spark, rows)).collect()}
    assert all(got[i].kept == f"row {i}" and got[i].n_dropped == 2 for i in range(299))
    assert got[299].kept == rows[299][1] and got[900].n_dropped == got[901].n_dropped == 0
    four = docs(spark, [(i, line) for i in range(4)] + [(3, line + "\n" + line)])
    assert {r.n_dropped for r in lines.dedup_lines(four).collect()} == {0}
    five = lines.dedup_lines(docs(spark, [(i, line) for i in range(5)] + [(4, line)])).collect()
    assert sorted((r.doc_id, r.kept) for r in five) == [(i, "") for i in range(4)] + [(4, line)] * 2
    assert lines.dedup_lines(docs(spark, [])).count() == 0


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h("".join(now[i : i + 8])) for i in range(0, len(now), 8)])
    return levels


def steps(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        out.append((at % 8, run[: at % 8] + run[at % 8 + 1 :]))
        at //= 8
    return out


def up(leaf, path):
    for at, others in path:
        leaf = h("".join([*others[:at], leaf, *others[at:]]))
    return leaf


def plain_manifest(rows):
    """(id, leaf, subroot, root, proof) of (id, group, leaf) rows."""
    groups = defaultdict(list)
    for i, g, leaf in rows:
        groups[g].append((-(1 << 63) if i is None else i, leaf, i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[1] for x in sorted(groups[g], key=lambda x: x[:2])]) for g in names}
    top = climb([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, (_, leaf, i) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            out.append((i, leaf, trees[g][-1][0], top[-1][0], steps(trees[g], at) + steps(top, k)))
    return sorted(out, key=repr)


def proved(frame):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [(s.at, list(s.others)) for s in r.proof]) for r in frame.collect()), key=repr)


def leaf_rows(sizes):
    rows = []
    for g, n in sizes.items():
        rows += [(None if i == 5 else i * 3 % 1001, g, h(f"{g}{i}")) for i in range(n)]
    return rows


@pytest.mark.parametrize("sizes", [
    {"en": 1}, {None: 9}, {"en": 8, "é": 64, "z": 65, None: 3, "": 1}, {f"g{i}": i % 4 + 1 for i in range(30)},
])
def test_manifest_equals_climbing(spark, sizes):
    rows = leaf_rows(sizes)
    frame = spark.createDataFrame(rows + rows[:2], "doc_id long, lang string, leaf string")
    assert proved(manifest.manifest(frame)) == plain_manifest(rows + rows[:2])


def test_manifest_over_several_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(manifest, "DEPTH", 1)
    monkeypatch.setattr(manifest, "BLOCK", 8)
    monkeypatch.setattr(manifest, "PLAIN_ROWS", 50)
    rows = leaf_rows({"en": 700, "de": 64, "fr": 1, None: 10}) + leaf_rows({f"g{i}": 1 for i in range(12)})
    frame = spark.createDataFrame(rows, "doc_id long, lang string, leaf string")
    clash = frame.select("*", F.lit(1).alias("n"), F.lit("x").alias("tree"), F.lit("y").alias("h"), F.lit(2).alias("LANG"), F.lit(3).alias("pos"))
    want = plain_manifest(rows)
    assert proved(manifest.manifest(clash)) == want
    folded = manifest.manifest(frame.withColumn("other", F.lit(h("?"))), carry=["other"]).select(
        "leaf", "root", manifest.fold(F.col("leaf"), F.col("proof")).alias("up"), manifest.fold(F.col("other"), F.col("proof")).alias("wrong"), "proof"
    ).collect()
    assert len(folded) == len(rows) and all(r.up == r.root != r.wrong for r in folded)
    assert all(r.wrong == up(h("?"), [(s.at, s.others) for s in r.proof]) for r in folded)


def test_leaves_of_odd_values(spark):
    frame = spark.createDataFrame([(1, "é", None), (2, "", "x" * 100000), (None, None, None)], "a long, b string, c string")
    got = [r[0] for r in frame.select(manifest.leaf(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [h("1:12:é-"), h("1:20:100000:" + "x" * 100000), h("---")]
    empty = frame.where("a = 9").select(F.col("a").alias("doc_id"), F.col("b").alias("lang"), F.col("b").alias("leaf"))
    assert manifest.manifest(empty).count() == 0
    assert zlib.crc32(b"12") == spark.range(1).select(F.crc32(F.lit("12"))).first()[0]
