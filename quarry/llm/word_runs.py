"""Periodic runs of words inside texts, and texts with each run collapsed to its first period.

A run is a stretch of words that repeats with a smallest period, at least so often, and that no neighbouring word
extends. Runs are found by the branching-tandem test on an enhanced suffix array: an interval of suffixes that share
``d`` words holds a square (a doubled stretch of ``d`` words) for every two of them that are ``d`` places apart, and
the square branches if they part right behind; of each interval only the suffixes of its smaller children are tried, by
looking up whether the rank of place ``i + d`` or ``i - d`` lies in the interval. Each branching square ends a
repetition; turned to the left as far as words agree it is a whole one, and squares of one repetition fall together.
There are no tree nodes: intervals come from one pass over the common-prefix lengths with a stack.

Many texts share one suffix array: words get numbers by text, so that no two texts have one in common. A word of a
run occurs at least as often as the run repeats; stretches between rarer words that are too short for a run never
enter the array, which changes no result.

Defined results: a null or empty text has no words and no runs, its collapsed text is empty; words are parted by the six
ASCII blanks and compared byte by byte; repeated rows get equal results; overlapping runs count each, a word goes if any of
them drops it. A text is handled whole in one task, in memory that grows with its own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a run at least, and periods.
LEAST_LENGTH, LEAST_PERIODS = 6, 4
#: Words of the texts that share a suffix array (a longer text has one of its own).
TOGETHER = 1 << 17
#: Passes over a text, at most, that part stretches at rare words; any number of them gives the same runs.
PASSES = 8

RUNS = "runs array<struct<start: bigint, length: bigint, period: bigint>>"


def _renumbered(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].reshape(len(values))


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``s`` (numbers from 0) in order, and their ranks, by doubling: only ties are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], s[order][1:] != s[order][:-1]]))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))  # the place where its group begins
    width = 1
    while True:
        sizes = np.diff(np.append(head, n))
        tied = np.repeat(sizes > 1, sizes)
        at = np.flatnonzero(tied)
        if not len(at):
            return order, rank
        who = order[at]
        behind = who + width
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)], -1)
        turn = np.lexsort((second, rank[who]))
        who, second = who[turn], second[turn]
        order[at] = who
        group = rank[who]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        starts = at[new]
        rank[who] = np.repeat(starts, np.diff(np.append(np.flatnonzero(new), len(at))))
        head = np.union1d(head, starts)
        width *= 2


def common_prefixes(s: np.ndarray, order: np.ndarray, rank: np.ndarray) -> list[int]:
    """Words that each suffix in order shares with the one before it (0 for the first), in linear time."""
    n, words = len(s), s.tolist()
    before, found, shared = np.concatenate([[-1], order[:-1]])[rank].tolist(), [0] * (n + 1), 0
    for i, (j, r) in enumerate(zip(before, rank.tolist(), strict=True)):
        if j < 0:
            shared = 0
            continue
        most = n - max(i, j)
        while shared < most and words[i + shared] == words[j + shared]:
            shared += 1
        found[r] = shared
        if shared:
            shared -= 1
    return found


def branching_squares(s: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and half lengths of the branching squares of ``s``; at place ``i`` only half lengths to ``longest[i]`` are asked for."""
    order, rank = suffix_array(s)
    shared, most = common_prefixes(s, order, rank), longest[order].tolist()
    tried: list[tuple[int, int, int, int, int]] = []  # first and last rank of a smaller child; depth, first and last rank of its interval
    stack: list[tuple[int, int, list[int]]] = []
    for p in range(1, len(s) + 1):
        depth, begin = shared[p], p - 1
        while stack and stack[-1][0] > depth:
            d, begin, cuts = stack.pop()
            if d <= most[begin]:
                ends = [begin, *cuts, p]
                largest = max(range(len(ends) - 1), key=lambda c: ends[c + 1] - ends[c])
                tried += [(ends[c], ends[c + 1] - 1, d, begin, p - 1) for c in range(len(ends) - 1) if c != largest]
        if depth:
            if stack and stack[-1][0] == depth:
                stack[-1][2].append(p)
            else:
                stack.append((depth, begin, [p]))
    if not tried:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high, depth, left, right = np.array(tried, np.int64).T
    size = high - low + 1
    which = np.repeat(np.arange(len(low)), size)
    place = order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - low, size)]
    depth, left, right = depth[which], left[which], right[which]
    squares = []
    for other in (place + depth, place - depth):
        inside = (other >= 0) & (other < len(s))
        r = rank[np.where(inside, other, 0)]
        inside &= (r >= left) & (r <= right)
        i, d = np.minimum(place, other)[inside], depth[inside]
        ahead = i + 2 * d
        parts = (ahead >= len(s)) | (s[np.minimum(ahead, len(s) - 1)] != s[i + d])
        squares.append(np.stack([i[parts], d[parts]]))
    i, d = np.unique(np.concatenate(squares, 1), axis=1)
    return i, d


def _turned(s: np.ndarray, i: int, d: int) -> int:
    """How many words before place ``i`` equal the word ``d`` places later, without a gap."""
    done, width = 0, 64
    while done < i:
        width = min(width * 2, i - done)
        end = i - done
        unlike = np.flatnonzero(s[end - width : end] != s[end - width + d : end + d])
        if len(unlike):
            return done + width - 1 - int(unlike[-1])
        done += width
    return done


def repetitions(s: np.ndarray, longest: np.ndarray, least_length: int, least_periods: int) -> list[tuple[int, int, int]]:
    """Start, end and smallest period of the runs in ``s``."""
    i, d = branching_squares(s, longest)
    need = np.maximum(least_length, least_periods * d) - 2 * d  # words still wanted to the left
    able = i >= need
    for back in (np.ones_like(d), np.minimum(d, need), need):  # three places of those, to pass over most squares at once
        at = np.maximum(i - back, 0)
        able &= (need <= 0) | (s[at] == s[at + d])
    i, d, need = i[able], d[able], need[able]
    by_end: dict[int, list[tuple[int, int]]] = {}
    found = []
    for k in np.argsort(d, kind="stable").tolist():
        place, period = int(i[k]), int(d[k])
        end = place + 2 * period
        known = by_end.setdefault(end, [])
        if any(period % q == 0 and start <= place for q, start in known):
            continue  # the same words with a smaller period
        start = place - _turned(s, place, period)
        if end - start >= max(least_length, least_periods * period):
            known.append((period, start))
            found.append((start, end, period))
    return found


def _stretches(words: np.ndarray, least_length: int, least_times: int) -> np.ndarray:
    """Which places may lie in a run: stretches, long enough, of words that occur often enough in their stretch."""
    kept = np.ones(len(words), bool)
    stretch = np.zeros(len(words), np.int64)
    for _ in range(PASSES):
        at = np.flatnonzero(kept)
        pairs = words[at] * (int(stretch.max(initial=0)) + 1) + stretch[at]
        _, where, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        still = at[counts[where.reshape(len(at))] >= least_times]
        now = np.zeros(len(words), bool)
        now[still] = True
        breaks = np.concatenate([[True], ~now[1:] | ~now[:-1]])
        stretch = np.cumsum(breaks)
        sizes = np.bincount(stretch[now], minlength=len(words) + 2) if len(words) else np.zeros(2, np.int64)
        now &= sizes[stretch] >= least_length
        done = now.sum() == len(at)
        kept = now
        if done:
            break
    return kept


def runs_of(texts: list[list[bytes]], least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs as (start, length, period), by start, then period."""
    parts, owners, places = [], [], []
    top = 0
    for t, words in enumerate(texts):
        if len(words) < least_length:
            continue
        numbers: dict[bytes, int] = {}
        s = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        at = np.flatnonzero(_stretches(s, least_length, least_periods))
        if len(at):
            gap = np.flatnonzero(np.diff(at) > 1) + 1
            for stretch in np.split(at, gap):
                parts.append(s[stretch] + top)
                owners.append(t)
                places.append(int(stretch[0]))
                top += len(numbers)  # stretches have no word in common
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if parts:
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        longest = np.repeat(sizes // least_periods, sizes)
        for start, end, period in repetitions(_renumbered(np.concatenate(parts)), longest, least_length, least_periods):
            k = int(np.searchsorted(ends, start, "right"))
            found[owners[k]].append((start - int(ends[k] - sizes[k]) + places[k], end - start, period))
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by single blanks, without those that stand in a run behind its first period."""
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
    return b" ".join(words)


def word_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """``key``, ``n_words``, ``runs`` (start, length, period) and ``collapsed``, the text without what runs repeat."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            texts, answers, waiting, begin = [(b or b"").split() for b in batch["text"]], [], 0, 0
            for end, words in enumerate(texts, 1):
                waiting += len(words)
                if waiting >= TOGETHER or end == len(texts):
                    answers += runs_of(texts[begin:end], least_length, least_periods)
                    begin, waiting = end, 0
            yield pd.DataFrame(
                {
                    "key": batch["key"],
                    "n_words": [len(w) for w in texts],
                    "runs": [[{"start": a, "length": n, "period": q} for a, n, q in r] for r in answers],
                    "collapsed": [collapsed(w, r).decode("utf-8", "replace") for w, r in zip(texts, answers, strict=True)],
                }
            )

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("binary").alias("text"))
    made = rows.mapInPandas(found, f"key string, n_words bigint, {RUNS}, collapsed string")
    return made.select(F.col("key").cast(docs.schema[key].dataType).alias(key), "n_words", "runs", "collapsed")
