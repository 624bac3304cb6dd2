"""Quality rules: a learned decision list over text statistics, in Spark expressions only.

Statistics are array functions inside the row; nothing of a text is shuffled. Labelled rows are
read against quantile thresholds, and sequential covering learns one rule after another for the
rows of low quality. A rule grows by the condition with the best information gain on two thirds
of the labelled rows, then drops conditions from its end as long as that raises its worth on the
other third, and stays if it is right on at least ``precision`` of both parts. Rows that it
covers are left out before the next one is learned. The list is a CASE expression: the first rule
that holds rejects, a row without one is kept.

The driver sees counts per (statistic, threshold) only, a bounded number.

Null texts count as empty and have zero in every statistic; labels that are null or belong to no
document are left out; a document with several labels counts once for each. Without labels, or
without two classes, the list is empty and all that passes the base rule is kept. Repeated rows
and null ids are judged like any others. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billscope.llm.common import SPACES, digest, documents, pick
from billscope.shared import settle

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["symbol_share", "dup_line_share", "repeat_share", "word_length", "upper_share", "digit_share", "mark_share"]


def text_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, digest of the text, the counts in BASE and further ones of every whole text."""
    rows = documents(docs, id_column, text_column)
    words = F.filter(F.split("text", f"[{SPACES}]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    hashed = rows.select(
        "doc_id", digest().alias("digest"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("[0-9]")).cast("long").alias("n_digits"),
        F.regexp_count("text", F.lit("[!?;:,.]")).cast("long").alias("n_marks"),
        words.alias("words"), lines.alias("lines"),
    ).select(
        "doc_id", "digest", "n_symbols", "n_upper", "n_digits", "n_marks",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    # identifiers of three words in a row, from those of two
    two = hashed.withColumn("h", _neighbours("h", lambda a, b: F.xxhash64(a, b)))
    three = two.withColumn("h", _neighbours("h", lambda a, b: F.xxhash64(a, b)))
    ordered = three.withColumn(
        "h", F.when(F.size(F.array_distinct("h")) == F.size("h"), F.array().cast("array<struct<w:bigint,i:int>>")).otherwise(
            F.sort_array(F.transform("h", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        ),
    )
    # starts of windows that occur again: equal to a neighbour in the order, on either side
    twice = ordered.withColumn("same", _neighbours("h", lambda a, b: a.w == b.w)).withColumn(
        "starts",
        F.sort_array(F.array_compact(F.zip_with(
            F.zip_with("h", F.concat(F.array(F.lit(False)), "same"), lambda x, s: F.struct(x.i.alias("i"), s.alias("s"))),
            F.concat("same", F.array(F.lit(False))),
            lambda x, s: F.when(x.s | s, x.i),
        ))),
    )
    covered = twice.withColumn("gaps", _neighbours("starts", lambda a, b: F.least(b - a, F.lit(3))))
    repeated = F.when(F.size("starts") == 0, F.lit(0)).otherwise(F.aggregate("gaps", F.lit(3), lambda total, gap: total + gap))
    return covered.select(
        "doc_id", "digest", *BASE[:-1], repeated.cast("long").alias("n_repeat_words"), "n_lines", "n_upper", "n_digits", "n_marks"
    )


def _neighbours(column: str, combine) -> Column:
    """``combine`` on each element and its successor; one element less than the array has."""
    size = F.greatest(F.size(column) - 1, F.lit(0))
    return F.zip_with(F.slice(column, 1, size), F.slice(column, 2, size), combine)


def with_shares(stats: DataFrame) -> DataFrame:
    """Statistics that do not grow with the length of a text."""

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    return stats.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words"),
        "upper_share": share("n_upper", "word_chars"), "digit_share": share("n_digits", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
    })


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool  # statistic > threshold, else <=
    threshold: float

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; each is a conjunction that rejects the rows it covers."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rule(self) -> Column:
        """Number of the first rule that holds, from 1; null for rows to keep."""
        found = F.lit(None).cast("int")
        for number, conditions in reversed(list(enumerate(self.rules, 1))):
            found = F.when(_all(conditions), F.lit(number)).otherwise(found)
        return found


def _all(conditions: list[Condition]) -> Column:
    held = F.lit(True)
    for c in conditions:
        held = held & c.column()
    return held


def learn(
    rows: DataFrame,
    low: str = "low",
    part: str = "part",
    statistics: list[str] | None = None,
    thresholds: int = 40,
    rules: int = 8,
    conditions: int = 4,
    precision: float = 0.97,
) -> DecisionList:
    """Decision list for the rows with ``low`` = 1; ``part`` 0 prunes, all other values grow."""
    statistics = statistics or [*SHARES, "n_words"]
    steps = [i / thresholds for i in range(thresholds + 1)]
    # halfway between neighbouring quantiles, those of all rows and those of the rows to reject
    values = zip(*[part.approxQuantile(statistics, steps, 0.001) for part in (rows, rows.where(F.col(low) == 1))], strict=True)
    grid = [
        (s, [(a + b) / 2 for a, b in itertools.pairwise(sorted({*every, *rejected}))])
        for s, (every, rejected) in zip(statistics, values, strict=True)
    ]
    grid = [(s, cuts) for s, cuts in grid if cuts]
    # the bin of a value is the number of its thresholds that lie below it
    binned = settle(rows.select(
        *statistics, F.col(low).cast("int").alias("low"), (F.col(part) == 0).alias("prune"),
        F.array(*[
            F.struct(F.lit(k).alias("k"), _bin(s, c).alias("bin")) for k, (s, c) in enumerate(grid)
        ]).alias("bins"),
    )) if grid else None
    learned: list[list[Condition]] = []
    while binned is not None and len(learned) < rules:
        left = binned
        for r in learned:
            left = left.where(~_all(r))
        grown = _grow(left.where(~F.col("prune")), grid, conditions)
        pruned = _prune(left, grown, precision) if grown else []
        if not pruned:
            break
        learned.append(pruned)
    return DecisionList(learned)


def _bin(statistic: str, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < F.col(statistic)))


def _grow(rows: DataFrame, grid: list[tuple[str, list[float]]], most: int) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < most:
        counts: dict[tuple[int, int], tuple[int, int]] = {
            (r.k, r.bin): (r.p, r.n)
            for r in rows.where(_all(rule)).select("low", F.explode("bins").alias("b")).groupBy("b.k", "b.bin").agg(
                F.sum("low").alias("p"), F.sum(1 - F.col("low")).alias("n")
            ).collect()  # at most thresholds + 2 rows for each statistic
        }
        p0, n0 = (sum(v[i] for (k, _), v in counts.items() if k == 0) for i in (0, 1))
        if not p0 or not n0:
            break
        best, gain = None, 0.0
        for k, (statistic, cuts) in enumerate(grid):
            p = n = 0
            for i, cut in enumerate(cuts):
                more = counts.get((k, i), (0, 0))
                p, n = p + more[0], n + more[1]
                for above, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    worth = a * (math.log2(a / (a + b)) - math.log2(p0 / (p0 + n0))) if a else 0.0
                    if worth > gain * (1 + 1e-9):
                        best, gain = Condition(statistic, above, cut), worth
        if best is None:
            break
        rule.append(best)
    return rule


def _prune(rows: DataFrame, rule: list[Condition], precision: float) -> list[Condition]:
    """The best prefix of the rule on the pruning part; none if it is not right often enough."""
    lengths = range(1, len(rule) + 1)
    row = rows.agg(*[
        F.sum(F.when(_all(rule[:i]) & (F.col("prune") == part) & (F.col("low") == value), 1).otherwise(0)).alias(f"{part}{value}{i}")
        for i in lengths for part in (False, True) for value in (0, 1)
    ]).first()

    def right(part: bool, i: int) -> tuple[int, int]:
        return row[f"{part}1{i}"] or 0, row[f"{part}0{i}"] or 0

    fits = []
    for i in lengths:
        (p, n), (grown_p, grown_n) = right(True, i), right(False, i)
        if p and p >= precision * (p + n) and grown_p >= precision * (grown_p + grown_n):
            fits.append(((p - n) / (p + n) * math.log2(1 + p), -i))
    return rule[: -max(fits)[1]] if fits else []


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    quality: str = "quality",
    labelled_rows: int = 2_000_000,
    precision: float = 0.97,
) -> DataFrame:
    """doc_id, digest, statistics, base_failed, rule (null: none) and kept of every document.

    The list is fitted on labelled rows that pass the base rule. ``labelled_rows`` bounds them:
    beyond it they are thinned out evenly by a hash of the id.
    """
    stats = settle(with_shares(text_statistics(docs, id_column, text_column)).withColumn("base_failed", base_failed()))
    marks = pick(labels, doc_id=id_column, quality=quality).where("quality is not null and doc_id is not null")
    share = labelled_rows / max(1, marks.count())
    if share < 1:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = stats.where(~F.col("base_failed")).join(marks, "doc_id").withColumn(
        "low", (F.col("quality") == 0).cast("int")
    ).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)))
    rule = learn(rows, precision=precision).rule()
    return stats.withColumn("rule", F.when(~F.col("base_failed"), rule)).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    )
