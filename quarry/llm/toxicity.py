"""Toxicity of texts: a factorization machine over hashed terms, which learns pairs of terms beside single ones.

The terms of a text are its different words, in lower case, and the first letters of longer words, hashed into
buckets. A score is the logistic of a constant, a weight for each bucket and, for each pair of buckets, the product
of two vectors of factors, so that an insult beside the mention of a group can count for more than both alone. All
pairs together cost no more than the terms: half of the squared sum of factors less the sum of their squares.

The model is fitted on at most ``most`` different labelled texts, those with the least hash of id, text and label. Buckets
that tell the labels apart get weights and factors, at most ``MOST_BUCKETS``; all others count for nothing. Weights are
fitted first, so that factors take what single terms leave.

Defined results: a null or empty text has no terms and gets the constant's score; labels that are null are not learned
from; rows equal in id, text and label are learned from once, a text with both labels from both; labels without a
document count for nothing; without labels of both kinds the score is the share of label 1 (one half if there are
none); an empty table gives an empty result; further columns are not read, and labels, languages, sources and ids
never enter a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quarry.llm.quality_classifier import labelled

#: Labelled texts a model is fitted on at most.
MOST_ROWS = 20_000
BUCKETS = 1 << 20
MOST_BUCKETS = 1 << 15
#: A bucket is used if its chi-square statistic reaches this.
LEAST_CHI = 10.0
#: Steps for weights alone, then for weights and factors.
FACTORS, ALONE, STEPS = 6, 80, 50
RATE, FACTOR_RATE = 0.3, 0.03
SHRINK_WEIGHTS, SHRINK_FACTORS = 1e-6, 1e-4
#: Letters of a word's beginning that is a term of its own.
STEM = 4

_WORD = re.compile(r"\w+")


def terms(text: str | None) -> np.ndarray:
    """The buckets of a text's terms, in order, each once."""
    found = set(_WORD.findall((text or "").lower()))
    found |= {"^" + w[:STEM] for w in found if len(w) > STEM}
    return np.unique(np.fromiter((crc32(t.encode("utf-8", "replace")) % BUCKETS for t in found), np.int64, len(found)))


@dataclass
class FactorizationMachine:
    """``buckets``, in order, are those with a weight; each has a row of ``factors``."""

    base: float
    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def total(self, at: np.ndarray) -> float:
        """The score before the logistic, of the rows ``at``."""
        f = self.factors[at]
        return self.base + self.weights[at].sum() + 0.5 * float(np.square(f.sum(0)).sum() - np.square(f).sum())

    def rows(self, found: np.ndarray) -> np.ndarray:
        """The rows of those buckets that have a weight."""
        at = np.minimum(np.searchsorted(self.buckets, found), max(0, len(self.buckets) - 1))
        return at[self.buckets[at] == found] if len(self.buckets) else at[:0]

    def probability(self, text: str | None) -> float:
        return float(_logistic(np.float64(self.total(self.rows(terms(text))))))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _chosen(texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The buckets that get weights, in order."""
    n, ones = len(y), y.sum()
    among = np.bincount(np.concatenate([*texts, np.zeros(0, np.int64)]), minlength=1)
    positive = np.bincount(np.concatenate([*(t for t, label in zip(texts, y, strict=True) if label), np.zeros(0, np.int64)]), minlength=len(among))
    expected = among * (ones / n)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.square(positive - expected) / (expected * (1 - ones / n) * (1 - among / n))
    chi = np.where((among > 1) & (among < n), np.nan_to_num(chi), 0.0)
    fit = np.flatnonzero(chi >= LEAST_CHI)
    return np.sort(fit[np.lexsort((fit, -chi[fit]))[:MOST_BUCKETS]])


def fit(texts: list[np.ndarray], y: np.ndarray, seed: int = 0) -> FactorizationMachine:
    """A model of P(y = 1) from the buckets of texts and labels 0 or 1, by gradient steps over all texts."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = FactorizationMachine(float(np.log(share / (1 - share))), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    if not len(y) or y.min() == y.max():
        return model
    model.buckets = _chosen(texts, y)
    size = len(model.buckets)
    rows = [model.rows(t) for t in texts]
    column, owner = np.concatenate(rows), np.repeat(np.arange(len(y)), [len(r) for r in rows])
    base, weights, factors = np.array([model.base]), np.zeros(size), np.random.default_rng(seed).normal(0, 0.05, (FACTORS, size))
    weight_steps, factor_steps = _Steps([base, weights], RATE), _Steps([factors], FACTOR_RATE)
    for step in range(ALONE + STEPS):
        total = base[0] + np.bincount(owner, weights[column], len(y))
        if step >= ALONE:
            each = factors[:, column]
            sums = np.stack([np.bincount(owner, e, len(y)) for e in each])
            total += 0.5 * (np.square(sums).sum(0) - np.bincount(owner, np.square(each).sum(0), len(y)))
        error = (_logistic(total) - y) / len(y)
        weight_steps.take([np.array([error.sum()]), np.bincount(column, error[owner], size) + SHRINK_WEIGHTS * weights])
        if step >= ALONE:
            slope = np.stack([np.bincount(column, error[owner] * (s[owner] - e), size) for s, e in zip(sums, each, strict=True)])
            factor_steps.take([slope + SHRINK_FACTORS * factors])
    model.base, model.weights, model.factors = float(base[0]), weights, np.ascontiguousarray(factors.T)
    return model


class _Steps:
    """Gradient steps with momentum and a rate by parameter (Adam) on arrays in place."""

    def __init__(self, parts: list[np.ndarray], rate: float) -> None:
        self.parts, self.rate, self.taken = parts, rate, 0
        self.first, self.second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]

    def take(self, slopes: list[np.ndarray]) -> None:
        self.taken += 1
        for p, g, m, v in zip(self.parts, slopes, self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.taken)) / (np.sqrt(v / (1 - 0.99**self.taken)) + 1e-8) / (1 + self.taken / 40)


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", most: int = MOST_ROWS) -> FactorizationMachine:
    """A model from ``most`` labelled texts at most; the buckets of their terms, not the texts, reach the driver."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"key": batch["key"], "y": batch["y"], "x": [terms(t).astype("<i4").tobytes() for t in batch["text"]]})

    found = labelled(docs, labels, text, key, label, most).mapInPandas(hashed, "key string, y double, x binary").toPandas()
    order = sorted(range(len(found)), key=lambda i: (found["key"].iat[i], found["y"].iat[i], found["x"].iat[i]))
    return fit([np.frombuffer(found["x"].iat[i], "<i4") for i in order], found["y"].to_numpy(float)[order])


def score(text: Column, model: FactorizationMachine) -> Column:
    """The probability of label 1 for a text column."""

    @F.pandas_udf(DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.probability(t) for t in batch], dtype=float)

    return scored(text)
