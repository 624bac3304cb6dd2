"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted by (turn, role, text).
Adjacent turns of one role become one block by array functions, and a block is written as

    <turn ROLE>\\nTEXT<more>TEXT</turn>\\n

In roles and texts ``\\``, ``<`` and ``>`` are written ``\\s``, ``\\l`` and ``\\g``, so no text
can hold a control string and every text comes back unchanged. The loss mask is a list of
(characters, loss) runs that cover the output from its first code point to its last; the
texts of the trained role are its only loss runs.

Null roles and texts count as empty, equal rows stay separate turns, null order values come
first, rows with a null conversation form one conversation, an empty table gives no rows.
A conversation is one output cell by definition, so its turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billscope.llm.common import pick

HEAD, HEAD_END, MORE, TAIL = "<turn ", ">\n", "<more>", "</turn>\n"
PIECES = "<turn [^>]*>\\n|<more>|</turn>\\n|[^<]+"


def escape(text: Column) -> Column:
    for raw, written in (("\\", "\\s"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for raw, written in ((">", "\\g"), ("<", "\\l"), ("\\", "\\s")):
        text = F.replace(text, F.lit(written), F.lit(raw))
    return text


def format_chats(
    df: DataFrame,
    conversation: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    trained_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: conv_id, formatted text and its loss mask (see the module)."""
    rows = pick(df, conv_id=conversation, turn=order, role=role, text=text)
    turn = F.struct(
        "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform("turns", lambda t: t.role))
    # positions at which a role begins, each with the position after its last turn
    heads = F.array_compact(
        F.zip_with(
            F.transform("turns", lambda t, i: F.struct(t.role.alias("role"), (i + 1).alias("at"))),
            F.slice(before, 1, F.size("turns")),
            lambda t, last: F.when(~t.role.eqNullSafe(last), t.at),
        )
    )
    blocks = turns.withColumn("heads", heads).withColumn(
        "blocks",
        F.zip_with(
            "heads", F.concat(F.slice("heads", 2, F.size("heads")), F.array(F.size("turns") + 1)),
            lambda first, end: F.slice("turns", first, end - first),
        ),
    )
    pieces = F.flatten(F.transform("blocks", lambda block: _written(block, trained_role)))
    return blocks.select("conv_id", pieces.alias("pieces")).select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p.piece), "").alias("formatted"),
        F.filter(
            F.transform("pieces", lambda p: F.struct(F.length(p.piece).alias("n_chars"), p.loss.alias("loss"))),
            lambda run: run.n_chars > 0,
        ).alias("mask"),
    )


def _written(block: Column, trained_role: str) -> Column:
    """Pieces (piece, loss) of one block of turns with one role."""

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("piece"), loss.alias("loss"))

    off = F.lit(False)
    texts = F.flatten(
        F.transform(
            block,
            lambda t, i: F.array(
                piece(F.when(i == 0, F.concat(F.lit(HEAD), escape(t.role), F.lit(HEAD_END))).otherwise(MORE), off),
                piece(escape(t.text), t.role == trained_role),
            ),
        )
    )
    return F.concat(texts, F.array(piece(F.lit(TAIL), off)))


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) as they were before formatting, read from the formatted text."""
    blocks = F.filter(F.split(formatted, TAIL), lambda b: b != "")

    def block_turns(block: Column) -> Column:
        role = unescape(F.substring_index(F.substring(block, len(HEAD) + 1, 1 << 30), HEAD_END, 1))
        # what follows the head; a role can be empty, a head cannot
        body = F.substring(block, F.lit(1) + F.instr(block, HEAD_END) + F.lit(1), F.lit(1 << 30))
        return F.transform(F.split(body, MORE), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, block_turns))


def read_loss_texts(formatted: Column, mask: Column) -> Column:
    """Stretches of the formatted text under the loss mask, unescaped and in order."""
    pieces = F.regexp_extract_all(formatted, F.lit(PIECES), F.lit(0))
    return F.transform(
        F.filter(
            F.zip_with(pieces, mask, lambda p, run: F.struct(p.alias("piece"), run.n_chars.alias("n"), run.loss.alias("loss"))),
            lambda x: x.loss & (F.length(x.piece) == x.n),
        ),
        lambda x: unescape(x.piece),
    )
