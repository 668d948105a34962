"""Ids of a byte-level BPE vocabulary, as the library for its file gives them, several times as fast.

The vocabulary's ids are its merge ranks, so the rank-driven encoder gives the same ids; this is
checked when a file is read. A text whose split exceeds that encoder's limits (millions of blanks in
a row) goes to the library itself. Strings of special tokens count as such, the library's default.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from clauseforge.llm.bpe import byte_letters

#: Fixed value: how byte-level vocabularies of this kind split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteEncoder:
    """Texts to ids; ValueError if the file is of another kind."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        vocab, special = model["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec["normalizer"] is None
        if model["type"] != "BPE" or not plain or any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError(f"{path} is no byte-level BPE vocabulary in order of its merges")
        bytes_of = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(map(bytes_of.__getitem__, token)): n for token, n in vocab.items() if token not in special}
        self.special = set(special)
        self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str | None) -> np.ndarray:
        """Unsigned 32-bit ids of a text; none of a null one."""
        if not text:
            return np.zeros(0, np.uint32)
        try:
            return self.fast.encode_to_numpy(text, allowed_special=self.special)
        except ValueError:
            return np.array(library(self.path).encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)
