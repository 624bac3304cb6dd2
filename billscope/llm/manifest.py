"""Merkle manifest of a table: a tree per group, a tree over the groups, and a proof for each row.

A row's digest is its leaf. The leaves of a group, in the order of their ids, are nodes of level 0;
every ``FAN`` consecutive nodes become the digest of their digests, until one is left, the group's
subroot. The subroots, in the order of their groups, give the root in the same way.

A position is written in digits to the base ``FAN``. Rows of a block - those that agree in all but
the last ``DEPTH`` digits - are dealt to one task by one exchange; there the digit columns are grouped
away one after the other, and each grouping nests the structs of the last one. A block is one row
of at most ``FAN ** DEPTH`` leaves, whatever the group's size. The digests of blocks are the nodes of
the next tier, which is rolled up alike; tiers grow with the logarithm of the table.

Proofs come down the same way. The path above a block and the block's nested row are put under each
other and grouped by the block; exploding the nested arrays level by level then prepends a step
(own place, digests of the others) to the path. No join takes part, and nothing larger than a block
stands in one row.

Ties of ids are ordered by their leaf, so equal rows have proofs with equal digests. Null ids count
as the smallest long. Null groups are a group, the first one. Null and empty texts have different
leaves. Groups of any size are numbered in chunks. An empty table gives no rows. Columns other than
those asked for, clashing names too, play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billscope.llm.common import pick
from billscope.operators.ordered import CHUNK, at_most, chunk_count, running_sums, with_chunks
from billscope.shared import settle

FAN, DEPTH = 8, 4
BLOCK = FAN**DEPTH
#: Rows from which a group is always numbered in chunks.
PLAIN_ROWS = 20_000
STEP = "array<struct<at:int,others:array<string>>>"


def leaf(*values: Column) -> Column:
    """Digest of values: each its byte count, a colon and itself as text, or a dash for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts
    ]), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof give."""
    return F.aggregate(proof, digest, lambda now, step: F.sha2(F.concat(
        F.array_join(F.slice(step["others"], F.lit(1), step["at"]), ""), now,
        F.array_join(F.slice(step["others"], step["at"] + 1, F.greatest(F.size(step["others"]) - step["at"], F.lit(0))), ""),
    ), 256))


def _numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``pos`` from 0 within the keys, and ``n``, the rows of the key."""
    chunks = None if at_most(rows, PLAIN_ROWS) else chunk_count(rows)
    cut = with_chunks(rows, order, chunks, keys=keys)
    counted = running_sums(cut, keys, order, {"pos": F.lit(1).cast("long")}, totals=True)
    return counted.withColumn("pos", F.col("pos") - 1).withColumnRenamed("pos_total", "n").drop(CHUNK)


def _roll(nodes: DataFrame, payload: Sequence[str]) -> DataFrame:
    """One row per block of ``nodes`` (tree, n, pos, h, payload): tree, n, block, h and the nested kids.

    ``n`` is the number of nodes of the tree. A level above a lone node is no level: it keeps its digest.
    """
    digits = [f"_d{i}" for i in range(DEPTH)]
    now = nodes.select(
        "tree", "n", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"),
        *[(F.floor(F.col("pos") / FAN**i) % FAN).cast("int").alias(d) for i, d in enumerate(digits)],
        "h", *payload,
    ).repartition("tree", "block")
    held: list[str] = list(payload)
    for level, digit in enumerate(digits):
        rest = ["tree", "n", "block", *digits[level + 1 :]]
        kids = F.sort_array(F.collect_list(F.struct(F.col(digit).alias("at"), "h", *held))).alias("kids")
        joined = F.sha2(F.array_join(F.transform("kids", lambda k: k["h"]), ""), 256)
        h = F.when(F.col("n") > FAN**level, joined).otherwise(F.get("kids", F.lit(0))["h"])
        now = now.groupBy(*rest).agg(kids).withColumn("h", h)
        held = ["kids"]
    return now.select("tree", "n", "block", "h", "kids")


def _descend(blocks: DataFrame, above: DataFrame, carried: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """(tree, pos, payload, carried, path) of every node of the blocks; ``path`` begins at the node.

    ``above`` has tree, block, path and the carried columns.
    """
    whole = blocks.select("tree", "block", "n", "kids")
    both = whole.unionByName(above.select("tree", "block", "path", *carried), allowMissingColumns=True)
    now = both.groupBy("tree", "block").agg(*[F.first(c, True).alias(c) for c in ("n", "kids", "path", *carried)])
    now = now.withColumn("pos", F.col("block"))
    for level in reversed(range(DEPTH)):
        opened = now.select(
            "tree", "n", "pos", "path", *carried, F.transform("kids", lambda k: k["h"]).alias("run"), F.explode("kids").alias("kid")
        )
        step = F.struct(
            F.col("kid.at").alias("at"), F.filter("run", lambda h, i: i != F.col("kid.at")).alias("others")
        )
        steps = F.when(F.col("n") > FAN**level, F.array(step)).otherwise(F.array().cast(STEP))
        below = [F.col("kid.kids").alias("kids")] if level else [F.col(f"kid.{p}").alias(p) for p in payload]
        now = opened.select(
            "tree", "n", (F.col("pos") * FAN + F.col("kid.at")).alias("pos"), *below, *carried,
            F.concat(steps.cast(STEP), "path").alias("path"),
        )
    return now.drop("n")


def prove(nodes: DataFrame, payload: Sequence[str], above: Callable[[DataFrame], DataFrame] | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """Every node of ``nodes`` (tree, n, pos, h, payload) with ``path`` and ``top``, its tree's digest.

    ``above`` is asked for the path above each tree, with the table (tree, h) of all tops, and gives
    (tree, path, carried).
    """
    tiers = [_tier(nodes, payload)]
    most = tiers[0].agg(F.max("n")).first()[0] or 0
    while most > BLOCK:
        tiers.append(_tier(tiers[-1].select(
            "tree", F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("block").alias("pos"), "h"
        ), []))
        most = -(-most // BLOCK)
    tops = tiers[-1].select("tree", "h")
    top = tops.select("tree", F.lit(0).cast("long").alias("block"), F.array().cast(STEP).alias("path"), F.col("h").alias("top"))
    if above is not None:
        reached = above(tops).select("tree", F.lit(0).cast("long").alias("block"), "path", *carried)
        top = top.drop("path").unionByName(reached, allowMissingColumns=True).groupBy("tree", "block").agg(
            *[F.first(c, True).alias(c) for c in ("top", "path", *carried)]
        )
    now = top
    for i, tier in reversed(list(enumerate(tiers))):
        kept = payload if i == 0 else []
        now = _descend(tier, now, ["top", *carried], kept)
        if i:
            now = now.withColumnRenamed("pos", "block")
    return now


def _tier(nodes: DataFrame, payload: Sequence[str]) -> DataFrame:
    return settle(_roll(nodes, payload))


def manifest(
    rows: DataFrame, leaf_column: str = "leaf", id_column: str = "doc_id", group_column: str = "lang", carry: Sequence[str] = ()
) -> DataFrame:
    """doc_id, leaf, carried columns, subroot, root and proof of every row of a table of leaves.

    ``proof`` lists the steps from the leaf to the root: the own place in the run and the digests of the
    run's others. :func:`fold` leads a leaf up a proof.
    """
    names = [f"c{i}" for i in range(len(carry))]
    table = pick(rows, id=id_column, tree=group_column, h=leaf_column, **dict(zip(names, carry, strict=True))).withColumn(
        "key", F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63)))
    )
    table = settle(table)
    leaves = _numbered(table, ["tree"], ["key", "h"]).withColumn("leaf", F.col("h"))

    def over_groups(tops: DataFrame) -> DataFrame:
        one = tops.select(F.col("tree").alias("name"), "h").withColumn("known", F.col("name").isNotNull())
        numbered = _numbered(one.withColumn("tree", F.lit(0)), ["tree"], ["known", "name"])
        found = prove(numbered.select("tree", "n", "pos", "h", "name"), ["name"])
        return found.select(F.col("name").alias("tree"), "path", F.col("top").alias("root"))

    found = prove(leaves.select("tree", "n", "pos", "h", "id", "leaf", *names), ["id", "leaf", *names], over_groups, ["root"])
    return found.select(
        F.col("id").alias(id_column), "leaf", *[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)],
        F.col("top").alias("subroot"), "root", F.col("path").alias("proof"),
    )
