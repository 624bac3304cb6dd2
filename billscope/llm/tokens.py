"""Token ids of whole texts by a public tokenizer file.

Where the merges of a byte-level file stand in the order of their ids, ``tiktoken`` with those
ids as ranks gives the ids of the ``tokenizers`` library at a fifth of its time; tests hold the
two against each other. All other files, and texts that hold an added token, go to
``tokenizers`` itself.
"""

from __future__ import annotations

import json

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

UNUSED = "<|billscope:unused|>"

_loaded: dict[str, TokenIds] = {}


class TokenIds:
    """Encoder of one tokenizer file; ids leave as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            layout = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x["content"] for x in layout.get("added_tokens") or []]
        before = layout.get("pre_tokenizer") or {}
        plain = (
            before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
            and before.get("use_regex", True) and not layout.get("normalizer")
        )
        ranks = _ranks(layout) if plain else None
        # the library writes arrays only where it knows a special token; texts that hold this one go to ``tokenizers``
        self.ranked = ranks and tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={UNUSED: max(ranks.values()) + 1}
        )
        self.added.append(UNUSED)

    def encode(self, text: str) -> bytes:
        if self.ranked and not any(a in text for a in self.added):
            return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.fromiter(ids, "<u4", len(ids)).tobytes()


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, by its rule."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranks(layout: dict) -> dict[bytes, int] | None:
    """Token bytes to ids, if the ids of the merged tokens follow the order of the merges."""
    model, letters = layout["model"], byte_letters()
    vocabulary, added = model["vocab"], {x["content"] for x in layout.get("added_tokens") or []}
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged) or len(set(merged)) + 256 != len(vocabulary.keys() - added):
        return None
    return {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in added}


def load(path: str) -> TokenIds:
    """The encoder of a file, read once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = TokenIds(path)
    return _loaded[path]
