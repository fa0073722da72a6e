"""Quality classifier: a generalised additive model with pairwise interactions, boosted in cycles.

Each feature of a text is cut into bins at quantiles. Boosting goes round the features; for each it fits a tree
of at most four leaves to the logistic loss and adds it to that feature's lookup table, so that in the end a
feature is one table over its bins. Then the pairs of features that explain most of what is left get tables over
coarse bins in the same way. A score is a sum of table entries, looked up for a whole batch at once.

The model is fitted on at most ``most`` different labelled texts, those with the least hash of id, text and label; scoring
reads every text whole.

Defined results: a null or empty text has features of zero and gets a score like any other; labels that are
null are not learned from; rows equal in id, text and label are learned from once, a text with both labels from both;
labels without a document count for nothing; without labels of both kinds the score is the share of label 1 (one half if there are none); an empty table gives an empty result; further columns are
not read, and labels, languages, sources and ids never enter a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Labelled rows a model is fitted on at most.
MOST_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, SMOOTH = 120, 60, 0.2, 5.0

FEATURES = (
    "log_words", "word_length", "capitals", "digits", "symbols", "exclamations", "bars", "stops", "commas",
    "line_length", "distinct_words", "commonest_word", "repeated_word", "repeated_lines", "short_words", "long_words",
)


def _class_table() -> np.ndarray:
    kinds = np.zeros(256, np.int64)
    for k, signs in enumerate((b"#*$%&<>^~=_{}[]\\@", b"!?", b"|", b".:;", b",", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 1):
        kinds[list(signs)] = k
    return kinds


_CLASSES = _class_table()


def features(text: str | None) -> list[float]:
    """The features of one text, in the order of ``FEATURES``; bytes are counted, words are parted by ASCII blanks."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    of = np.bincount(_CLASSES[np.frombuffer(data, np.uint8)], minlength=8)
    n, size = len(words), max(1, sum(map(len, words)))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in data.split(b"\n") if x]
    again = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(np.log1p(n)), size / n, of[7] / size, of[6] / size, of[1] / size, of[2] / size, of[3] / size, of[4] / size, of[5] / size,
        float(np.log1p(len(data) / len(lines))), len(counts) / n**0.8, max(counts.values()) / n, again / n,
        1 - len(set(lines)) / len(lines), float((lengths <= 2).mean()), float((lengths >= 12).mean()),
    ]


def _matrix(texts: pd.Series) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))


@dataclass
class AdditiveModel:
    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cuts, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += values[np.searchsorted(cuts, x[:, j], "right")]
        for (i, j), values in zip(self.pairs, self.pair_tables, strict=True):
            total += values[np.searchsorted(self.pair_cuts[i], x[:, i], "right"), np.searchsorted(self.pair_cuts[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SMOOTH)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values by bin of the best tree on sums of gradients and curvatures in bin order."""
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
        at = int(np.argmax(gains)) + 1
        if gains[at - 1] > _gain(g.sum(), h.sum()) + 1e-9:
            return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + SMOOTH))


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a table of sums into four by one cut of each side."""
    best, values = 0.0, np.zeros(g.shape)
    sums = [np.pad(s.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for s in (g, h)]
    for a in range(1, g.shape[0]):
        for b in range(1, g.shape[1]):
            boxes = [((0, a), (0, b)), ((0, a), (b, None)), ((a, None), (0, b)), ((a, None), (b, None))]
            cells = []
            for (r0, r1), (c0, c1) in boxes:
                r, c = r1 or g.shape[0], c1 or g.shape[1]
                cells.append([s[r, c] - s[r0, c] - s[r, c0] + s[r0, c0] for s in sums])
            gain = sum(_gain(np.float64(x), np.float64(y)) for x, y in cells) - _gain(g.sum(), h.sum())
            if gain > best + 1e-9:
                best, values = float(gain), np.zeros(g.shape)
                for ((r0, r1), (c0, c1)), (x, y) in zip(boxes, cells, strict=True):
                    values[r0:r1, c0:c1] = x / (y + SMOOTH)
    return best, values


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """A model of P(y = 1) from a matrix of features and labels 0 or 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    model.cuts = [_cuts(c, BINS) for c in x.T]
    bins = [np.searchsorted(c, v, "right") for c, v in zip(model.cuts, x.T, strict=True)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    for _ in range(ROUNDS):
        for b, values in zip(bins, model.tables, strict=True):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(values)), np.bincount(b, h, len(values)))
            values += step
            total += step[b]

    model.pair_cuts = [_cuts(c, PAIR_BINS) for c in x.T]
    coarse = [np.searchsorted(c, v, "right") for c, v in zip(model.pair_cuts, x.T, strict=True)]
    shapes = [len(c) + 1 for c in model.pair_cuts]

    def sums(i: int, j: int) -> list[np.ndarray]:
        at = coarse[i] * shapes[j] + coarse[j]
        return [np.bincount(at, s, shapes[i] * shapes[j]).reshape(shapes[i], shapes[j]) for s in slopes()]

    gains = sorted(((-_quarters(*sums(i, j))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)))
    model.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain < 0]
    model.pair_tables = [np.zeros((shapes[i], shapes[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), values in zip(model.pairs, model.pair_tables, strict=True):
            step = RATE * _quarters(*sums(i, j))[1]
            values += step
            total += step[coarse[i], coarse[j]]
    return model


def labelled(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, most: int) -> DataFrame:
    """``key``, ``text`` and ``y`` of the ``most`` different labelled texts with the least hash of key, text and label.

    They are chosen by keys and hashes alone, after the join, so that neither repeated ids nor labels without a
    document shift the bound; texts are read for the chosen ones only.
    """
    marks = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.xxhash64(text).alias("mark"))
    given = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), (F.col(label) > 0).cast("double").alias("y"))
    chosen = marks.distinct().join(given.distinct(), "key").orderBy(F.xxhash64("key", "mark", "y"), "key", "mark", "y").limit(most)
    texts = docs.select(F.col(key).cast("string").alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    return texts.join(F.broadcast(chosen), ["key", "mark"]).dropDuplicates(["key", "mark", "y"]).drop("mark")  # ``most`` rows are broadcast


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", most: int = MOST_ROWS) -> AdditiveModel:
    """A model from ``most`` labelled texts at most; their features, not the texts, reach the driver."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "y": batch["y"], "x": list(_matrix(batch["text"]))})

    found = labelled(docs, labels, text, key, label, most).mapInPandas(measure, "key string, y double, x array<double>").toPandas()
    order = np.lexsort([*np.array(found["x"].tolist(), float).reshape(len(found), len(FEATURES)).T, found["y"], found["key"].astype(str)])
    data = found.iloc[order]
    return fit(np.array(data["x"].tolist(), float).reshape(len(data), len(FEATURES)), data["y"].to_numpy(float))


def score(text: Column, model: AdditiveModel) -> Column:
    """The probability of label 1 for a text column."""

    @F.pandas_udf(DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.probability(_matrix(batch)))

    return scored(text)
