"""Byte-level BPE over vocabulary files whose place is a parameter; each process loads a file once."""

from __future__ import annotations

import base64
import os
import re
from array import array

import numpy as np
import tiktoken

# The pattern of word pieces that looks ahead at white space, and Unicode's white space.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|"
_LOOKING_AHEAD, _PLAIN = _WORDS + r"\s+(?!\S)|\s+", _WORDS + r"\s+"
_BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: A run's last blank, where something follows the run.
_LAST_BLANK = re.compile(rf"{_BLANK}({_BLANK})(?!{_BLANK}|\Z)")

_LOADED: dict[tuple[str, str], tiktoken.Encoding] = {}
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a file of ranks (base64 token and rank in each line)."""
    if (path, pattern) not in _LOADED:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _LOADED[path, pattern] = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path, pattern]


class Encoder:
    """Ids of texts, without special tokens.

    A pattern that looks ahead is slow to match. Where it does so only to leave the last blank of a run to the word
    behind, texts are cut before that blank instead, and the pattern without the look-ahead gives the same pre-tokens.
    """

    def __init__(self, path: str, pattern: str) -> None:
        self.cut = pattern == _LOOKING_AHEAD
        self.encoding = encoding(path, _PLAIN if self.cut else pattern)
        self.kind = np.dtype("<u2" if self.encoding.max_token_value < 1 << 16 else "<u4")

    def ids(self, text: str) -> np.ndarray:
        places = [0, *(m.start(1) for m in _LAST_BLANK.finditer(text))] if self.cut else [0]
        if len(places) == 1:
            return np.frombuffer(array("I", self.encoding.encode_ordinary(text)), "<u4")
        found = array("I")
        for begin, end in zip(places, [*places[1:], len(text)], strict=True):
            found.fromlist(self.encoding.encode_ordinary(text[begin:end]))
        return np.frombuffer(found, "<u4")


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]
