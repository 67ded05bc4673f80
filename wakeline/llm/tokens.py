"""Byte-level BPE read from a tokenizer file, for counting and packing."""

from __future__ import annotations

import json

import numpy as np

from wakeline.llm.bpe import byte_symbols

#: Fixed value: the pattern that byte-level vocabularies of this family split text by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """Same ids as the tokenizers library gives for ``path`` without added special tokens."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        number = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(number[s] for s in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text in self.special:
            ranks.pop(text.encode(), None)
        self._bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks,
                                      special_tokens=self.special)

    def ids(self, text: str) -> np.ndarray:
        """Special tokens written in the text become their ids, as the library does."""
        if any(s in text for s in self.special):
            return np.asarray(self._bpe.encode(text, allowed_special="all"), dtype="<u4")
        return np.asarray(self._bpe.encode_ordinary(text), dtype="<u4")

    def count(self, text: str) -> int:
        """Tokens of the text alone, in which special strings are ordinary text."""
        return len(self._bpe.encode_ordinary(text))
