"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams of one to three characters. A text gets the language whose profile its
own ranking is least out of place with: an n-gram costs the difference of its two ranks, a missing one the
profile's length. Texts are lower-cased, and runs of anything but letters count as one blank.

Defined results: a null text, or one without a letter, gives ``und`` with score 0, as does a model that learned
no language; rows with a null id are never learned from and not held out; an empty string is a language like any
other; equal distances go to the language first in order; repeated rows are learned from as often as they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: N-grams of a profile.
LENGTH = 400
#: Code points handled at once.
BLOCK = 1 << 20
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters; made once in each process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(codes, return_inverse=True)
    return found, np.bincount(where, counts, len(found)).astype(np.int64)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a text's n-grams (three code points of 21 bits), in order, and how often each occurs."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    points = np.concatenate([[32], np.where(_letters()[points], points, 32), [32]])
    points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
    codes, counts = [], []
    for start in range(0, len(points), BLOCK):  # n-grams that start in the block
        part = points[start : start + BLOCK + 2].astype(np.int64)
        first = part[:BLOCK]
        two, three = (part[: max(0, min(BLOCK, len(part) - n))] for n in (1, 2))
        grams = [first[first != 32], two << 21 | part[1 : len(two) + 1], three << 42 | part[1 : len(three) + 1] << 21 | part[2 : len(three) + 2]]
        c, n = np.unique(np.concatenate(grams), return_counts=True)
        codes.append(c)
        counts.append(n)
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (codes[0], counts[0]) if len(codes) == 1 else _merged(np.concatenate(codes), np.concatenate(counts))


def ranking(text: str | None, length: int = LENGTH) -> np.ndarray:
    """A text's most frequent n-grams, most frequent first, equal counts by code; empty if it has no letter."""
    if not text or not _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)].any():
        return np.zeros(0, np.int64)
    codes, counts = gram_counts(text)
    return codes[np.argsort(-counts, kind="stable")[:length]]


@dataclass
class Profiles:
    """Ranks by language; ``ranks`` has a row for each language and a column for each of ``codes``, sorted."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    length: int

    def closest(self, text: str | None) -> tuple[str, float]:
        """The language and a score: 1 less the distance's share of the largest possible."""
        own = ranking(text, self.length)
        if not len(own) or not self.languages:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        theirs = np.where(self.codes[at] == own, self.ranks[:, at], -1)
        out = np.where(theirs < 0, self.length, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(out))
        return self.languages[best], float(1 - out[best] / (self.length * len(own)))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", length: int = LENGTH) -> Profiles:
    """Profiles from every row of ``docs`` that has a language; what reaches the driver is bounded by the languages."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, texts in batch.groupby("lang")["text"]:
                parts = [gram_counts(t) for t in texts]
                codes, counts = _merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                yield pd.DataFrame({"lang": name, "code": codes, "n": counts})

    counts = rows.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= length)  # each task keeps its first ``length`` before the shuffle
    top = top.select("lang", "code", F.expr("rank - 1").alias("rank")).toPandas()
    languages, codes = sorted(top["lang"].unique()), np.sort(top["code"].unique()).astype(np.int64)
    ranks = np.full((len(languages), len(codes)), -1, np.int64)
    ranks[np.searchsorted(languages, top["lang"]) if languages else [], np.searchsorted(codes, top["code"])] = top["rank"]
    return Profiles(languages, codes, ranks, length)


def predicted(text: Column, profiles: Profiles) -> Column:
    """A struct of ``lang_pred`` and ``score`` for a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([profiles.closest(t) for t in batch], columns=["lang_pred", "score"])

    return predict(text)
