"""From documents to packed training sequences, one operator of ``billscope.llm`` a stage.

Each stage takes all that its predecessor kept, and its decisions take effect: rejected documents
and copies go, repeated strings and personal data leave the texts, and the last stage returns the
pieces of the packed sequences. ``n_chars`` follows the text. Documents are known by ``doc_id``;
rows that repeat an id with different texts are documents of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billscope.llm import packing, private, quality, repeats, simhash
from billscope.llm.common import digest, pick, rewrite
from billscope.shared import fresh_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A repeated passage goes if it has more words than this.
PASSAGE_WORDS = 50
#: Length of the strings that are searched for: less than what 51 words of three letters and a space take.
REPEAT_BYTES = 160


def whole(docs: DataFrame) -> DataFrame:
    return pick(docs, **{c: c for c in COLUMNS}).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned list rejects."""
    docs = whole(docs)
    judged = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = judged.where("kept").select("doc_id", "digest").distinct()
    rows = docs.withColumn("digest", F.xxhash64("text"))
    return rows.join(kept, [rows.doc_id.eqNullSafe(kept.doc_id), rows.digest == kept.digest], "left_semi").select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    docs = whole(docs)
    groups = simhash.near_duplicates(docs, words=4, distance=4)
    # fingerprints of a group without any id have no component id; they stay apart by fingerprint
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("apart")]
    first = groups.groupBy(*group).agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "doc_id", "digest")).alias("one")
    ).select("one.doc_id", "one.digest")
    rows = docs.withColumn("digest", digest())
    stay = rows.join(first, [rows.doc_id.eqNullSafe(first.doc_id), rows.digest == first.digest], "left_semi")
    # of rows with one id and one text, one stays
    return stay.dropDuplicates(["doc_id", "digest"]).select(*COLUMNS)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of more than ``PASSAGE_WORDS`` whole words that stand anywhere else.

    Every run of repeated ``REPEAT_BYTES``-byte strings is looked at; those with fewer words stay.
    """
    docs = whole(docs)
    found = repeats.spans(repeats.known(docs), REPEAT_BYTES)
    return rewrite(docs, found, "spans", lambda text, spans: repeats.cut_passages(text, spans, PASSAGE_WORDS))


def private_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with the kind of a span in place of each piece of personal data."""
    docs = whole(docs)
    found = private.find_private(docs).where(F.size("spans") > 0)
    return rewrite(docs, found, "spans", private.redact)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with their ids."""
    return packing.pack(whole(docs), public_tokenizers.path("byte_bpe_50k.json"), window=1024)


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", simhash_stage),
    ("suffix-array dedup", repeats_stage),
    ("PII", private_stage),
    ("packing", packing_stage),
]

#: Learned rules, fingerprints and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            path = fresh_path(spark, f"stage{number}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
