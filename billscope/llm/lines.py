"""Removal of lines that many documents share.

A line's key is the line without the six separators at its ends and with A-Z in lower case. Keys
of at least ``shortest`` code points that stand in at least ``documents_at_least`` documents are
shared: their lines go from all documents but the one with the largest id that holds them.

Three scans and no text in a shuffle of lines:

* lines are exploded and counted by a 128-bit hash of their key, with map-side sums; only hashes
  with enough lines go on. A line with a third of all occurrences is one row per task.
* the lines of those hashes (hash, document, position) are written down. Grouping by hash and
  document before grouping by hash gives the exact number of different documents, and no hash
  collects its documents in one task.
* the positions to drop, one row per document that loses lines, meet the texts again - broadcast
  where a check of rows and bytes allows it, else in a shuffle join that moves each text once - and
  the other lines are joined in their order. Flags and lines are walked once, whatever their number.

Null and empty texts are one empty line. Rows that share an id are one document when documents are
counted, and so are all rows without an id, which counts as the smallest; each row keeps its own
result row. A key that repeats within a document counts once; the document that keeps it keeps all
its lines. Very long texts and lines are ordinary ones. An empty table gives no rows. Of columns
with clashing names only the two asked for play a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billscope.llm.common import digest, documents
from billscope.operators.keyed import BROADCAST_ROWS, attach, small_side
from billscope.operators.ordered import at_most
from billscope.shared import release, settle

#: The separators that are stripped from both ends of a line.
BLANKS = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]
#: Documents that lose lines, two longs and their positions, travel to the texts up to this many and 32 MB.
CARRIED_ROWS = 1_000_000


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def hashed_lines(rows: DataFrame, shortest: int, *columns: str) -> DataFrame:
    """``columns``, the position of each line whose key is long enough, and the key's hash."""
    lines = rows.select(*columns, F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    long_lines = lines.where(F.length("line") >= shortest).select(*columns, "pos", F.btrim("line", F.lit(BLANKS)).alias("key"))
    keys = long_lines.where(F.length("key") >= shortest).select(*columns, "pos", lower_ascii(F.col("key")).alias("key"))
    return keys.select(*columns, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def shared_lines(rows: DataFrame, documents_at_least: int, shortest: int) -> DataFrame:
    """(doc_id, digest, drop): sorted positions of the lines that each document loses."""
    often = settle(
        hashed_lines(rows, shortest).groupBy(*HASH).agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") >= documents_at_least)
    )
    lines = hashed_lines(rows, shortest, "doc_id", "digest")
    if at_most(often, BROADCAST_ROWS):
        found = lines.join(F.broadcast(often.select(*HASH)), HASH, "left_semi")
    else:
        found = attach(lines, HASH, often.withColumn("known", F.lit(True)), check=False).where("known").drop("known")
    found = settle(found)
    per_document = found.groupBy(*HASH, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    rules = settle(
        per_document.groupBy(*HASH).agg(
            F.count(F.lit(1)).alias("documents"), F.max("doc_id").alias("keeper"), F.sum("n").alias("_rows")
        ).where(F.col("documents") >= documents_at_least).select(*HASH, "keeper", F.lit(True).alias("shared"), "_rows")
    )
    judged = attach(found, HASH, rules).where(F.col("shared") & ~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = settle(
        judged.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("pos")).alias("drop"))
    )
    for table in (often, found, rules):
        release(table)
    return drops


def _without(lines: Column, drop: Column) -> Column:
    """The lines whose positions are not among the sorted ones of ``drop``, joined by newlines."""
    before = F.concat(F.array(F.lit(-1)), F.slice(drop, F.lit(1), F.size(drop) - 1))
    no, yes = F.lit(False), F.array(F.lit(True))
    flags = F.concat(
        F.flatten(F.zip_with(before, drop, lambda a, b: F.concat(F.array_repeat(no, b - a - 1), yes))),
        F.array_repeat(no, F.size(lines) - 1 - F.element_at(drop, -1)),
    )
    # null lines take no part in the joined text
    return F.array_join(F.zip_with(lines, flags, lambda line, gone: F.when(~gone, line)), "\n")


def dedup_lines(
    docs: DataFrame, documents_at_least: int = 5, shortest: int = 40, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, n_lines (before), n_dropped and kept, the text of the other lines, for every row."""
    rows = documents(docs, id_column, text_column).select("doc_id", digest().alias("digest"), "text")
    drops = shared_lines(rows, documents_at_least, shortest)
    side = small_side(drops.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "drop"), CARRIED_ROWS)
    joined = rows.join(side, rows.doc_id.eqNullSafe(F.col("_id")) & (rows.digest == F.col("_digest")), "left")
    lines = split_lines(F.col("text"))
    return joined.select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(_without(lines, F.col("drop"))).alias("kept"),
    )
