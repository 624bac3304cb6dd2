"""Named queries of this subpackage: each applies its operator to its whole table.

The operators are called with production parameters; digest columns are derived from what they
return. SQL stands beside a query where DuckDB can say the same.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billscope.llm import (
    best_fit,
    bpe,
    chat,
    licenses,
    lines,
    manifest,
    negatives,
    packing,
    private,
    quality,
    repeats,
    simhash,
    topk,
)
from billscope.llm.common import pick

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A conversation whose texts hold the marks of several templates.
MARKED_ID, MARKED_TEXT = -7, "\\### Assistant: </turn> ok"


def query(name: str, sql: str | None = None):
    def enter(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return enter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_chat_format",
    f"""WITH rows AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL VALUES ({MARKED_ID}, 0, 'user', '{MARKED_TEXT}'), ({MARKED_ID}, 1, 'assistant', '{MARKED_TEXT}')),
        marked AS (
          SELECT *, length(text) + length(regexp_replace(text, '[^\\\\<>]', '', 'g')) AS n_text,
            length(role) + length(regexp_replace(role, '[^\\\\<>]', '', 'g')) AS n_role,
            lag(role) OVER w IS DISTINCT FROM role AS head, lead(role) OVER w IS DISTINCT FROM role AS tail
          FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
          CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), ''))
            AS loss_sha256,
          CAST(sum(n_text + CASE WHEN head THEN 8 + n_role ELSE 6 END + CASE WHEN tail THEN 8 ELSE 0 END) AS BIGINT)
            AS formatted_chars
        FROM marked GROUP BY conv_id""",
)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.range(2).select(
        F.lit(MARKED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKED_TEXT).alias("text"),
    )
    chats = chat.format_chats(rows.unionByName(marked))
    read = chats.select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
        chat.read_turns(F.col("formatted")).alias("turns"),
        F.array_join(chat.read_loss_texts(F.col("formatted"), F.col("mask")), "").alias("loss"),
    )
    written = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(written, ""), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


@query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept", "rule")


@query("op3_token_matrix")
def op3_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return best_fit.token_matrix(table(spark, sf_dir, "documents"), path, length=2048)


@query("op4_private_data")
def op4_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.find_private(table(spark, sf_dir, "documents"))

    def number(kind: str):
        at = private.KINDS.index(kind)
        return F.size(F.filter("base", lambda s: s.kind == at)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[number(k) for k in private.KINDS if k != "id"],
        F.sha2(private.span_list("base"), 256).alias("base_sha256"), private.span_list("spans").alias("spans"),
    )


@query("op5_license_scan")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), coverage=0.8)


@query("op6_retrieval_packing")
def op6_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), window=1024)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, distance=4).drop("digest")


@query("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query("op9_repeats")
def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), length=400, keep="text")


@query(
    "op10_top_k",
    """WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
        WHERE r <= 10""",
)
def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024)


@query(
    "op11_hard_negatives",
    """WITH v AS (
          SELECT row_number() OVER () AS r, vec_id,
            CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
          FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
            CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.v) = len(b.v)),
        positive AS (
          SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER w AS p
          FROM scored WHERE same WINDOW w AS (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST)
          QUALIFY p <= 5)
        SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id,
          p.positive_score, n.score AS negative_score
        FROM positive p JOIN scored n ON p.a = n.a AND NOT n.same
          AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
        WINDOW w AS (PARTITION BY p.a, p.p ORDER BY n.score DESC, n.vec_id NULLS LAST)
        QUALIFY rank <= 3""",
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pick(table(spark, sf_dir, "embeddings"), vec_id="vec_id", embedding="embedding", label="label")
    shifted = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(shifted, "vec_id % 50 = 0", positives=5, negatives=3, at_least=50, at_most=95, scale=256)


@query(
    "op12_line_dedup",
    """WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        parts AS (SELECT r, doc_id, string_split(text, chr(10)) AS lines FROM docs),
        lines AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM parts),
        keyed AS (
          SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
          FROM lines),
        shared AS (
          SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
          GROUP BY key HAVING count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INTEGER)) >= 5),
        judged AS (
          SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.keeper AS gone
          FROM keyed k LEFT JOIN shared s ON k.key = s.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
          sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY r, doc_id""",
)
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"), documents_at_least=5, shortest=40)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def merkle_sql(levels: int = 8, group_levels: int = 4) -> str:
    """All levels of the trees, written out: enough for 8 ** levels rows of a language and 8 ** group_levels languages."""

    def leaf(text: str) -> str:
        names = [text if c == "text" else f"CAST({c} AS VARCHAR)" for c in LEAF_FIELDS]
        return "sha256(" + " || ".join(f"coalesce(strlen({n}) || ':' || {n}, '-')" for n in names) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # unsigned crc32, bit by bit over the decimal digits
    parts = [
        f"""base AS (SELECT row_number() OVER () AS r, doc_id, lang, {leaf('text')} AS leaf, {leaf(lowered)} AS lower_leaf FROM documents)""",
        """crc AS (
          SELECT id, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
            lambda s, c: list_reduce(list_prepend(xor(s, c), [CAST(0 AS BIGINT) FOR _ IN range(8)]),
              lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS state
          FROM (SELECT DISTINCT doc_id AS id FROM base WHERE doc_id IS NOT NULL))""",
        """l0 AS (
          SELECT b.*, CASE WHEN xor(c.state, 4294967295) % 3 = 0 THEN lower_leaf ELSE leaf END AS fold, '' AS proof,
            row_number() OVER (PARTITION BY lang ORDER BY coalesce(doc_id, -9223372036854775808), leaf) - 1 AS pos,
            count(*) OVER (PARTITION BY lang) AS n
          FROM base b LEFT JOIN crc c ON b.doc_id = c.id)""",
        "n0 AS (SELECT lang, pos, n, leaf AS h FROM l0)",
    ]

    def level(nodes: str, rows: str, k: int) -> list[str]:
        own = "64 * CAST(f.pos % 8 AS BIGINT)"
        others = f"substr(t.run, 1, {own}) || substr(t.run, {own} + 65)"
        return [
            f"""{nodes}{k + 1} AS (
          SELECT lang, pos // 8 AS pos, (n + 7) // 8 AS n, string_agg(h, '' ORDER BY pos) AS run,
            CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h
          FROM {nodes}{k} GROUP BY lang, pos // 8, n)""",
            f"""{rows}{k + 1} AS (
          SELECT f.* EXCLUDE (pos, n, fold, proof), f.pos // 8 AS pos, (f.n + 7) // 8 AS n,
            CASE WHEN f.n > 1 THEN sha256(substr(t.run, 1, {own}) || f.fold || substr(t.run, {own} + 65)) ELSE f.fold END AS fold,
            CASE WHEN f.n > 1 THEN f.proof || {others} ELSE f.proof END AS proof
          FROM {rows}{k} f JOIN {nodes}{k + 1} t ON f.lang IS NOT DISTINCT FROM t.lang AND f.pos // 8 = t.pos)""",
        ]

    for k in range(levels):
        parts += level("n", "l", k)
    parts += [
        f"tops AS (SELECT lang AS name, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM n{levels})",
        "m0 AS (SELECT 0 AS lang, pos, n, h FROM tops)",
        f"""g0 AS (
          SELECT 0 AS lang, l.r, l.doc_id, l.leaf, t.h AS subroot, t.pos, t.n, l.fold, l.proof
          FROM l{levels} l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.name)""",
    ]
    for k in range(group_levels):
        parts += level("m", "g", k)
    return "WITH " + ", ".join(parts) + f"""
        SELECT g.doc_id, g.leaf, g.subroot, m.h AS root, sha256(g.proof) AS proof_sha256, g.fold AS folded_root, g.fold = m.h AS verified
        FROM g{group_levels} g JOIN m{group_levels} m ON g.lang = m.lang"""


@query("op13_merkle_manifest", merkle_sql())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), **{c: c for c in LEAF_FIELDS})
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    original = [F.col(c) for c in LEAF_FIELDS]
    changed = manifest.leaf(*original[:-1], lines.lower_ascii(F.col("text")))
    leaves = docs.select("doc_id", "lang", manifest.leaf(*original).alias("leaf"), F.when(tampered, changed).alias("changed"))
    proved = manifest.manifest(leaves, carry=["changed"])
    siblings = F.flatten(F.transform("proof", lambda step: step["others"]))
    return proved.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
        manifest.fold(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
