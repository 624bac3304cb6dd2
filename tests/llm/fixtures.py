"""Small inputs and plain re-computations that the operators are held against."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def awkward(spark, rows):
    """The rows with extra columns whose names clash with ones that operators use."""
    schema = "text_ string, n_words long, Key string, row long, spans string, digest string, doc_id long, text string, ids string"
    return spark.createDataFrame([("x", 1, "k", 2, "s", "d", i, t, "q") for i, t in rows], schema).withColumnRenamed("text_", "TEXT")


def odd_texts() -> list[str | None]:
    return [None, "", " ", "\n\n", "one", "é 漢 🙂", "a" * 5000, "word " * 3000, "same text here", "same text here"]


def quality_counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    )


def repeats_by_counting(texts: list[bytes], length: int) -> list[tuple[int, int, int, str]]:
    counts = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if counts[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def links_by_pairs(values: list[int], distance: int) -> dict[int, int]:
    """Smallest value of the component of each value."""
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def scattered(n: int, seed: int = 1, near: int = 5) -> list[int]:
    """Random 64-bit values with some close neighbours."""
    rng = random.Random(seed)
    values = set()
    while len(values) < n:
        v = rng.getrandbits(64)
        for _ in range(rng.randint(1, near)):
            values.add(v)
            for _ in range(rng.randint(1, 6)):
                v ^= 1 << rng.randrange(64)
    return sorted(values)[:n]
