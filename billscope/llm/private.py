"""Personal data: base patterns of four kinds, and bootstrapped contextual extraction.

Base spans are the leftmost non-overlapping matches of fixed patterns, with their checks. They
are also the seeds of the bootstrap: a lexical pattern is the two words before an entity. Tokens
that hold a digit and are no base span are candidates, with the pattern before them. Spark scores
the graph of patterns and instances in rounds:

    confidence(pattern)  = sum of score(instance) over its occurrences / occurrences of the two words
    score(instance)      = 1 for a seed, else 1 - product of (1 - confidence) over trusted patterns

A pattern is trusted with at least ``support`` different instances, seeds or found ones, and
``confidence``; the occurrences of its words are counted over the whole corpus, whatever follows
them, so words that merely happen to stand before an address once are worth nothing. Each round
adds the patterns that instances found in the last one support, until no confidence rises any more.
Candidates found behind a trusted pattern are spans of the kind ``id`` wherever they stand.
Candidates are tokens of four or more characters with a digit; identifiers without a digit are not
looked for.

Texts are read once for spans and once for each round that brings new patterns; the rest works on the few tokens
with digits. Occurrences of a pattern are summed before they meet their scores, so a pattern or
an instance with a third of all occurrences is one row.

Null texts count as empty. Repeated rows and null ids are rows of their own; an empty table gives
no rows. Work on a text is linear in its length.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billscope.llm.common import documents, each_row, map_batches
from billscope.operators.ordered import at_most
from billscope.shared import settle

KINDS = ["email", "ip", "card", "phone", "id"]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match that starts inside a run of digits would start at the run, so only runs are tried
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
DIGIT = re.compile(r"[0-9]")
EDGES = ".,;:!?()[]{}<>\"'"
#: Patterns that a check shows to be few enough travel with the counting tasks.
CARRIED_PATTERNS = 200_000
#: Characters from which a word of a pattern goes by its digest.
LONG_WORD = 256
#: Confidences that rise by no more than this have come to rest.
SETTLED = 1e-9


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The part before @ starts at its run of characters, or after the last match."""
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            taken = found.end()
            yield start, taken
        at = text.find("@", max(at + 1, taken))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all base spans, by start and kind; code points, end exclusive."""
    found = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _key(word: str) -> str:
    """A word in lower case as part of a pattern; very long ones by their digest, so patterns stay short."""
    low = word.lower()
    return low if len(low) <= LONG_WORD else "#" + hashlib.sha256(low.encode("utf-8", "surrogatepass")).hexdigest()


class Before:
    """The two whole words before an offset, in words by the six separators."""

    def __init__(self, text: str):
        self.text = text
        self.starts: list[int] | None = None

    def pattern(self, start: int) -> str | None:
        if self.starts is None:
            spans = [m.span() for m in TOKEN.finditer(self.text)]
            self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]
        i = bisect.bisect_right(self.starts, start) - 1  # the word that holds the offset
        if i < 2:
            return None
        return " ".join(_key(self.text[self.starts[j] : self.ends[j]]) for j in (i - 2, i - 1))


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with a digit, without punctuation at their edges, that touch no base span."""
    taken = iter([*base, (len(text) + 1, 0, len(text) + 1)])
    start, _, end = next(taken)
    at = DIGIT.search(text)
    while at:
        a, b = at.start(), TOKEN.match(text, at.start()).end()
        at = DIGIT.search(text, b)
        while a > 0 and text[a - 1] not in " \t\n\v\f\r":
            a -= 1
        while a < b and text[a] in EDGES:
            a += 1
        while b > a and text[b - 1] in EDGES:
            b -= 1
        while end <= a:
            start, _, end = next(taken)
        if b - a >= 4 and b <= start:
            yield a, b


def read_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, digest of the text, base spans, and occurrences (pattern, instance, seed, start, end)."""

    def work(batches: Iterator[pa.RecordBatch]):
        for doc, digest, text in each_row(batches):
            base = base_spans(text)
            seen, before = [], Before(text)
            for start, kind, end in base:
                pattern = before.pattern(start)
                if pattern:
                    seen.append((pattern, f"{KINDS[kind]}:{text[start:end]}", True, start, end))
            for start, end in candidates(text, base):
                # without two words before it a candidate can still be found by its other occurrences
                seen.append((before.pattern(start), f"id:{text[start:end]}", False, start, end))
            yield (
                doc, digest, [{"start": a, "kind": k, "end": b} for a, k, b in base],
                [dict(zip(("pattern", "instance", "seed", "start", "end"), x, strict=True)) for x in seen],
            )

    rows = documents(docs, id_column, text_column).select("doc_id", F.xxhash64("text").alias("digest"), "text")
    return map_batches(
        rows, work,
        "doc_id long, digest long, base array<struct<start:int,kind:int,end:int>>,"
        " seen array<struct<pattern:string,instance:string,seed:boolean,start:int,end:int>>",
    )


def count_patterns(docs: DataFrame, patterns: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(pattern, total): how often the two words of each pattern follow each other in all texts."""
    texts = documents(docs, id_column, text_column).select("text")
    carried = at_most(patterns, CARRIED_PATTERNS)
    wanted = frozenset(r.pattern for r in patterns.collect()) if carried else None
    first = frozenset(p.split(" ", 1)[0] for p in wanted) if carried else None

    # both ways split and lower alike, they differ in where the pairs meet the patterns
    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            counts: Counter[str] = Counter()
            for (text,) in each_row(iter([batch])):
                # of bytes, split() takes exactly the six separators
                words = [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]
                words = [_key(w) for w in words] if max(map(len, words), default=0) > LONG_WORD // 4 else " ".join(words).lower().split(" ")
                counts.update(
                    f"{a} {b}" for a, b in zip(words, words[1:], strict=False)
                    if wanted is None or a in first and f"{a} {b}" in wanted
                )
            yield from counts.items()

    found = map_batches(texts, work, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("total"))
    return found if carried else found.join(patterns, "pattern", "left_semi")


def bootstrap(
    docs: DataFrame, read: DataFrame, support: int = 5, confidence: float = 0.6, rounds: int | None = None,
    id_column: str = "doc_id", text_column: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns (pattern, confidence) and scored instances (instance, score) at the fixed point.

    ``rounds`` only bounds the search where a caller asks for it.
    """
    graph = settle(
        read.select(F.explode("seen").alias("s")).where("s.pattern is not null")
        .groupBy("s.pattern", "s.instance", "s.seed").agg(F.count(F.lit(1)).alias("n"))
    )
    seeds = settle(graph.where("seed").select("instance").distinct().withColumn("score", F.lit(1.0)))
    scores, totals, last, done = seeds, None, None, 0
    while True:
        # instances trusted so far support patterns; those that are new are counted over all texts
        supported = graph.join(scores, "instance").groupBy("pattern").agg(F.count(F.lit(1)).alias("of")).where(F.col("of") >= support)
        new = supported.select("pattern")
        new = settle(new if totals is None else new.join(totals, "pattern", "left_anti"))
        grown = totals is None or not new.isEmpty()
        if grown:
            counted = count_patterns(docs, new, id_column, text_column)
            totals = settle(counted if totals is None else totals.unionByName(counted))
        trusted = settle(
            graph.join(totals, "pattern").join(scores, "instance").groupBy("pattern")
            # a word that holds several entities stands once after its pattern
            .agg((F.sum(F.col("n") * F.col("score")) / F.greatest(F.first("total"), F.sum("n"))).alias("confidence"))
            .where(F.col("confidence") >= confidence)
        )
        # confidences only rise, so the rounds end
        moved = trusted if last is None else trusted.join(last.withColumnRenamed("confidence", "was"), "pattern", "left").where(
            F.col("was").isNull() | (F.col("confidence") - F.col("was") > SETTLED)
        )
        done += 1
        still = moved.isEmpty()
        if still and last is not None:
            break
        # noisy-or over the trusted patterns of a candidate; a confidence of one leaves nothing
        left = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-12)))))
        found = graph.where(~F.col("seed")).join(trusted, "pattern").groupBy("instance").agg((1 - left).alias("score"))
        scores, last = settle(seeds.unionByName(found)), trusted
        if still or done == rounds:
            break
    return trusted, scores


def trusted_patterns(
    docs: DataFrame, read: DataFrame, support: int = 5, confidence: float = 0.6, rounds: int | None = None,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Patterns (pattern, confidence) that the bootstrap trusts after its last round."""
    return bootstrap(docs, read, support, confidence, rounds, id_column, text_column)[0]


def find_private(
    docs: DataFrame, support: int = 5, confidence: float = 0.6, rounds: int | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, digest of the text, base and found spans (start, kind, end) of every document."""
    read = settle(read_documents(docs, id_column, text_column)).withColumn("row", F.monotonically_increasing_id())
    _, scores = bootstrap(docs, read.drop("row"), support, confidence, rounds, id_column, text_column)
    # a found instance is one wherever it stands; one occurrence is one span
    known = scores.where(F.col("instance").startswith("id:")).select("instance")
    more = read.where(F.size("seen") > 0).select("row", F.explode("seen").alias("s")).where("not s.seed").select(
        "row", "s.instance", F.struct(F.col("s.start").alias("start"), F.lit(KINDS.index("id")).alias("kind"), F.col("s.end").alias("end")).alias("span")
    ).join(known, "instance", "left_semi").groupBy("row").agg(F.collect_list("span").alias("more"))
    return read.join(more, "row", "left").select(
        "doc_id", "digest", "base",
        F.sort_array(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans"),
    )


def span_list(spans: str):
    """Spans as kind:start:end, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s.kind), s.start.cast("string"), s.end.cast("string"))), ","
    )


def redact(text: str, spans: list[dict]) -> str:
    """The text with each span replaced by its kind in brackets; spans that touch are one."""
    out, last = [], 0
    for span in sorted(spans, key=lambda s: (s["start"], s["kind"])):
        if span["start"] >= last:
            out += [text[last : span["start"]], f"[{KINDS[span['kind']].upper()}]"]
        last = max(last, span["end"])
    return "".join([*out, text[last:]])

