"""Byte-level subword ids of whole texts."""

from __future__ import annotations

import base64
import re
from array import array
from functools import cached_property

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

BYTE_BPE, BYTE_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
END_TEXT = "<|endoftext|>"
#: Very long runs of white space (Unicode's), for which the rank file's splitting pattern needs a stack that grows with the run.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


class ByteBpe:
    """Ids as ``tokenizers`` gives them for a byte-level BPE file, without added special tokens.

    The ids come from the same vocabulary's rank file, which takes a fifth of the time; texts that hold the special token's string go
    through ``tokenizers`` itself. Both paths are parameters.
    """

    def __init__(self, path: str = "", ranks: str = ""):
        self.path = path or public_tokenizers.path(BYTE_BPE)
        with open(ranks or public_tokenizers.path(BYTE_RANKS), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.raw = [b""] * (max(table.values()) + 2)
        for x, i in table.items():
            self.raw[i] = x
        self.raw[-1] = END_TEXT.encode()  # the special token's id is the last
        self.core = tiktoken.Encoding("byte", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @cached_property
    def tokenizer(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        """Unsigned 32-bit ids of one text."""
        if END_TEXT in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if not LONG_SPACE.search(text):
            return np.frombuffer(array("I", self.core.encode_ordinary(text)), np.uint32)
        out, at = [], 0
        for run in LONG_SPACE.finditer(text):  # all but the last character of a run is one word of the pattern; that one belongs to what follows
            end = run.end() - (run.end() < len(text))
            out += self.core.encode_ordinary(text[at : run.start()])
            out += self.core._encode_single_piece(text[run.start() : end].encode())
            at = end
        return np.array(out + self.core.encode_ordinary(text[at:]), np.uint32)
