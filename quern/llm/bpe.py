"""Byte-level BPE ids of a public vocabulary, as the ``tokenizers`` library gives them."""

from __future__ import annotations

import base64
import os

import numpy as np


#: The id that stands behind each document, in packing and in training order.
END_ID = 1


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Bpe:
    """``encode(text)``: little-endian unsigned 32-bit ids. The rank file beside the json, where there is one, gives the same ids some four times as fast; texts that name a special token go to the json's own tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.ranks = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.ranks is None or any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One for each Python worker, which runs many tasks."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]
