"""Ids of whole texts by a byte-level BPE vocabulary file."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from .wordbpe import byte_alphabet

#: Fixed value: the pattern by which byte-level vocabularies of this kind cut texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBPE:
    """From a tokenizers JSON file. Where its ids are in the order of its merges,
    which makes ranks of them, texts go through the faster library for ranks; ids
    are the same (a test compares every code point). Other files go through the
    tokenizers library itself. Special strings inside texts count as their token."""

    def __init__(self, path: str) -> None:
        self.library, self.ranked = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, back = spec["model"], {c: b for b, c in enumerate(byte_alphabet())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = {k: v for k, v in model["vocab"].items() if k not in special}
        in_order = all(vocab.get(a + b) == i + len(back) for i, (a, b) in enumerate(pairs)) and all(vocab.get(c, len(back)) < len(back) for c in back)
        plain = spec["normalizer"] is None and spec["pre_tokenizer"].get("use_regex") and not spec["pre_tokenizer"].get("add_prefix_space") and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        if in_order and plain and len(vocab) == len(pairs) + len(back):
            ranks = {bytes(back[c] for c in k): v for k, v in vocab.items()}
            self.ranked = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = tuple(special)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=self.dtype)
        if self.ranked is None:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype)
        allowed = "all" if any(s in text for s in self.special) else set()
        try:
            return self.ranked.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()).astype(self.dtype)
        except ValueError:  # very long white space is beyond its pattern's stack
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype)


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)
