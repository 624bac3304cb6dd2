import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from billscope.llm import bpe, chat, tokens
from tests.llm.fixtures import awkward, docs, odd_texts

TURNS = "conv_id long, turn long, role string, text string"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def read_back(chats):
    rows = chats.select(
        "conv_id", "formatted", "mask", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss_texts(F.col("formatted"), F.col("mask")).alias("loss"),
    ).collect()
    return {r.conv_id: r for r in rows}


def test_turns_come_back_whatever_their_texts_hold(spark):
    rows = [
        (1, 3, "assistant", "</turn>\n<turn user>\nhi"), (1, 1, "user", "a\\s <more> \\"), (1, 2, "user", None),
        (1, 4, "assistant", ""), (1, 5, None, "no role"), (1, 6, "a>\nb", "odd role"), (2, None, "user", "x"),
        (2, 0, "assistant", "\n\n"), (2, 0, "assistant", "\n\n"), (None, 0, "system", "s" * 9000),
    ]
    found = read_back(chat.format_chats(spark.createDataFrame(rows, TURNS)))
    for conv in (1, 2, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in mine]
        assert [(t.role, t.text) for t in found[conv].turns] == turns
        assert "".join(found[conv].loss) == "".join(t for role, t in turns if role == "assistant")
        assert sum(m.n_chars for m in found[conv].mask) == len(found[conv].formatted)
    # neighbours of one role share a block
    assert found[1].formatted.count("<turn ") == 4 and found[1].formatted.count("</turn>") == 4


def test_no_turns_no_chats(spark):
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def library():
    ranks = tokens._ranks(__import__("json").load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8")))
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_backtracking_gives_the_library_ids():
    model, same = bpe.load(PATH, PATTERN), library()
    rng = np.random.default_rng(3)
    letters = list("abtheinrs' 0129\n\té漢🙂ñ<|>")
    for _ in range(400):
        text = "".join(rng.choice(letters, rng.integers(0, 80)))
        assert model.encode(text) == same.encode_ordinary(text)
        assert model.decode(model.encode(text)) == text.encode()
    for text in ("ab" * 20000 + " " * 500, "<|endoftext|>", "".join(rng.choice(list("abcdefgh"), 20000))):
        assert model.encode(text) == same.encode_ordinary(text)


def test_round_trip_of_documents(spark):
    rows = [*enumerate(odd_texts()), (None, "null id"), (0, None)]
    same = library()
    got = bpe.round_trip(awkward(spark, rows), PATH, PATTERN).collect()
    want = sorted(
        (str(i), len(ids := same.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
         hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    encoded = bpe.encode(docs(spark, rows), PATH, PATTERN)
    decoded = bpe.decode(encoded, PATH, PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in decoded) == sorted((str(i), t or "") for i, t in rows)
    assert bpe.encode(docs(spark, []), PATH, PATTERN).count() == 0


def test_fast_and_plain_tokenizer_agree():
    model = tokens.load(public_tokenizers.path("byte_bpe_50k.json"))
    assert model.ranked
    texts = [t or "" for t in odd_texts()] + ["it's  a b \x1c c\r\n d", "x<|endoftext|>y", "１２ ٣٤", "é ʼs"]
    for text in texts:
        plain = np.array(model.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert model.encode(text) == plain
    other = tokens.load(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.ranked and np.frombuffer(other.encode("Hello there"), "<u4").size == 2
