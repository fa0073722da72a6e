"""Statistics of one text that quality rules are based on; words are parted by the six ASCII blanks."""

from __future__ import annotations

import numpy as np

#: Words of a window that counts as repeated if found again.
SPAN = 8
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def repeated_words(words: list[bytes], span: int = SPAN) -> int:
    """Words inside windows of ``span`` words that occur twice or more, the first occurrence included.

    Windows are compared by 64-bit sums of word numbers times fixed odd factors, then by their words.
    """
    n = len(words) - span + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    sums = np.zeros(n, np.uint64)
    for i in range(span):
        mixed = (ids[i : i + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        sums = (sums + (mixed ^ (mixed >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
    _, inverse, counts = np.unique(sums, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse] > 1)
    if not len(again):
        return 0
    rows = np.lib.stride_tricks.sliding_window_view(ids, span)[again]
    _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, np.int64)
    at = again[counts[inverse.ravel()] > 1]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + span, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str | None) -> dict[str, int]:
    """Counts of words, code points in words, symbols, repeated lines and repeated words, and some more."""
    text = text or ""
    words = text.encode().split()
    seen: set[str] = set()
    lines = repeated = 0
    for line in text.split("\n"):
        if line.strip(_BLANKS):
            lines += 1
            repeated += line in seen
            seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, _BLANKS)),
        "n_symbols": sum(map(text.count, _SYMBOLS)),
        "n_dup_lines": repeated,
        "n_repeat_words": repeated_words(words),
        "n_lines": lines,
        "n_distinct": len(set(words)),
    }
