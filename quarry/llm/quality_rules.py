"""Quality rules: base limits, then robust multivariate outliers of each language and source.

Texts are measured once. The statistics, transformed, of all texts within the base limits give each group's
minimum-covariance-determinant estimate. Three starts (medians and quartiles; mean and covariance; covariance of
directions from the median) take two concentration steps each: the three quarters of the group's texts that are least
distant give mean and covariance anew. The start of the least determinant goes on for three more. Then distances are
scaled so that their median is that of a chi-square distribution, the texts within its 97.5 % quantile give the final
mean and covariance, and a text is rejected beyond the quantile that one in 1 / ``tail`` ordinary texts would pass.

A step is one aggregate over all texts, by group and by narrow classes of distance, so that groups of any size meet as
partial sums. Statistics are rounded to 1 / 1024, so that sums are exact and don't depend on how the texts are dealt over
tasks (up to sixteen million texts in a class; beyond that to fifteen digits).

Groups with fewer than ``least`` texts are judged by their language, languages with fewer by all texts.

Defined results: a null text counts as empty; a text with fewer than 20 words, or with more than 30 in 100 words
repeated in windows of eight, fails the base limits; null languages and sources form groups of their own; null and
repeated ids are kept as they stand; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import checkpointed, joined_by_key
from quarry.llm.text_statistics import statistics

LEAST, SHARE, TRIALS, STEPS = 200, 0.75, 2, 3
#: Share of normally spread texts beyond the limit (small, as statistics of clean texts have far heavier tails than that),
#: and beyond the bound of the final mean and covariance.
TAIL, OUTER = 1e-15, 0.025
#: Parts of one to which statistics are rounded.
GRID = 1024
#: Added to each variance, so that statistics that hardly vary in a group can't dominate.
RIDGE = 0.01
#: Groups, at most, whose estimates (300 bytes each) are broadcast.
FEW = 10_000
#: Classes of distance to a doubling of the square.
CLASSES = 16

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_DIMENSIONS = 7
_X = [f"x{i}" for i in range(_DIMENSIONS)]
_PAIRS = [(i, j) for i in range(_DIMENSIONS) for j in range(i + 1)]
#: An estimate is an array of the mean and the lower triangle of the whitening matrix.
_ESTIMATE = "g string, start int, n long, median double, size double, state array<double>"


def chi_square(upper: float) -> float:
    """What a chi-square variable of seven degrees of freedom exceeds with probability ``upper``, by halving intervals."""

    def exceeded(x: float) -> float:
        r = math.sqrt(x)
        return math.erfc(r / math.sqrt(2)) + math.sqrt(2 / math.pi) * math.exp(-x / 2) * (r + r**3 / 3 + r**5 / 15)

    low, high = 0.0, 2000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if exceeded(middle) > upper else (low, middle)
    return high


def transformed(s: dict[str, int], text: str) -> list[float]:
    """The statistics as a vector in which ordinary texts spread evenly."""
    n = max(1, s["n_words"])
    return [
        float(np.log1p(s["n_words"])),
        float(np.log1p(s["word_chars"] / n)),
        float(np.log1p(s["n_symbols"] / n)),
        float(np.log1p(s["n_dup_lines"] / max(1, s["n_lines"]))),
        float(np.log1p(s["n_repeat_words"] / n)),
        s["n_distinct"] / n**0.85,
        sum(map(str.isupper, text)) / max(1, s["word_chars"]),
    ]


def measured(docs: DataFrame, text: str, key: str, lang: str, source: str) -> DataFrame:
    """The id, the counts, ``base_failed``, the transformed vector, and the three groups a text belongs to."""

    @F.pandas_udf(", ".join([*(f"{c} long" for c in _COUNTS), *(f"{x} double" for x in _X)]))
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(statistics(t), t or "") for t in batch]
            yield pd.DataFrame([[*(s[c] for c in _COUNTS), *(round(v * GRID) / GRID for v in transformed(s, t))] for s, t in found], columns=[*_COUNTS, *_X])

    failed = (F.col("s.n_words") < 20) | (100 * F.col("s.n_repeat_words") > 30 * F.col("s.n_words"))
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    of_lang = F.concat(F.lit("lang "), named(lang))
    groups = F.array(F.concat(of_lang, F.lit("\x00source "), named(source)), of_lang, F.lit("all"))
    return docs.select(F.col(key).alias("id"), measure(F.col(text)).alias("s"), groups.alias("groups")).select(
        "id", "s.*", failed.alias("base_failed"), "groups"
    )


def _square() -> Column:
    """Squared Mahalanobis distance of the vector under ``state``, as the length of the whitened difference."""
    state = F.col("state")
    at = {pair: _DIMENSIONS + k for k, pair in enumerate(_PAIRS)}
    rows = [reduce(add, (state[at[i, j]] * (F.col(_X[j]) - state[j]) for j in range(i + 1))) for i in range(_DIMENSIONS)]
    return reduce(add, (r * r for r in rows))


def _state(mean: np.ndarray, covariance: np.ndarray) -> list[float]:
    whitening = np.linalg.inv(np.linalg.cholesky(covariance + RIDGE * np.eye(_DIMENSIONS)))
    return [*mean.tolist(), *(float(whitening[p]) for p in _PAIRS)]


def _row(g: str, start: int, n: int, mean: np.ndarray, covariance: np.ndarray, median: float = 0.0) -> tuple:
    state = _state(mean, covariance)
    return g, start, n, median, float(-np.log([state[_DIMENSIONS + _PAIRS.index((i, i))] for i in range(_DIMENSIONS)]).sum()), state


def _estimated(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _ESTIMATE.split(", ")])


def _quartiles(values: pd.DataFrame) -> pd.DataFrame:
    """The start from medians and quartiles, from how often each value of each statistic occurs in a group."""
    mean, spread, n = np.zeros(_DIMENSIONS), np.ones(_DIMENSIONS), 0
    for i, part in values.sort_values(["i", "x"]).groupby("i"):
        upto, x = part["n"].cumsum().to_numpy(), part["x"].to_numpy()
        n = int(upto[-1])
        low, mean[i], high = (x[np.searchsorted(upto, q * n)] for q in (0.25, 0.5, 0.75))
        spread[i] = (high - low) / 1.349
    return _estimated([_row(values["g"].iloc[0], 0, n, mean, np.diag(spread**2))])


def _moments(sums: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
    mean, products = np.split(sums / n, [_DIMENSIONS])
    covariance = np.zeros((_DIMENSIONS, _DIMENSIONS))
    for (i, j), product in zip(_PAIRS, products, strict=True):
        covariance[i, j] = covariance[j, i] = product - mean[i] * mean[j]
    return mean, covariance


def _more_starts(sums: pd.DataFrame) -> pd.DataFrame:
    """The starts from mean and covariance, and from the covariance of directions, scaled to the quartiles' spread."""
    r = sums.iloc[0]
    mean, covariance = _moments(np.array(r["sums"], float), r["n"])
    first = np.array(r["state"], float)
    scale = 1 / np.array([first[_DIMENSIONS + _PAIRS.index((i, i))] for i in range(_DIMENSIONS)])
    directions = np.zeros((_DIMENSIONS, _DIMENSIONS))
    for (i, j), s in zip(_PAIRS, r["directions"], strict=True):
        directions[i, j] = directions[j, i] = s
    directions /= max(np.trace(directions) / _DIMENSIONS, 1e-9)
    rows = [_row(r["g"], 1, r["n"], mean, covariance), _row(r["g"], 2, r["n"], first[:_DIMENSIONS], directions * np.outer(scale, scale))]
    return _estimated([(r["g"], 0, r["n"], 0.0, 0.0, r["state"]), *rows])


def _ordered(classes: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Classes of distance in order, with counts, running counts and sums, and the median of the squares."""
    classes = classes.sort_values("class")
    n, upto = classes["n"].to_numpy(), classes["n"].cumsum().to_numpy()
    names = classes["class"].to_numpy()
    return names, n, upto, np.stack(classes["sums"].tolist()), 2.0 ** ((names[int(np.searchsorted(upto, upto[-1] / 2))] + 0.5) / CLASSES)


def _step(classes: pd.DataFrame) -> pd.DataFrame:
    """The next estimate from a group's sums by class of distance; ``median`` belongs to the estimate before."""
    _, n, upto, sums, median = _ordered(classes)
    near = int(np.searchsorted(upto, SHARE * upto[-1])) + 1
    return _estimated([_row(classes["g"].iloc[0], classes["start"].iloc[0], upto[-1], *_moments(sums[:near].sum(axis=0), n[:near].sum()), median)])


def _reweighted(classes: pd.DataFrame) -> pd.DataFrame:
    """The estimate from all texts within the chi-square bound, once the distances' median is that of the distribution."""
    names, n, upto, sums, median = _ordered(classes)
    near = max(1, int(np.searchsorted(names, CLASSES * np.log2(median * chi_square(OUTER) / chi_square(0.5)))))
    return _estimated([_row(classes["g"].iloc[0], classes["start"].iloc[0], upto[-1], *_moments(sums[:near].sum(axis=0), n[:near].sum()), median)])


def estimates(rows: DataFrame) -> DataFrame:
    """One row for each group of ``rows`` (columns ``groups`` and the vector): ``n``, ``median`` (of squares), ``state``."""
    values = rows.select("groups", F.posexplode(F.array(*_X)).alias("i", "x")).groupBy("groups", "i", "x").agg(F.count("*").alias("n"))
    values = values.select(F.explode("groups").alias("g"), "i", "x", "n").groupBy("g", "i", "x").agg(F.sum("n").alias("n"))
    state = checkpointed(values.groupBy("g").applyInPandas(_quartiles, _ESTIMATE))
    few = state.count() <= FEW  # then each text gets its estimate without a shuffle by group
    each = rows.select(F.explode("groups").alias("g"), *_X)
    total = 0 if few else each.count()
    terms = [*map(F.col, _X), *(F.col(_X[i]) * F.col(_X[j]) for i, j in _PAIRS)]

    def placed(state: DataFrame) -> DataFrame:
        state = state.select("g", "start", F.col("n").alias("texts"), "state")
        return each.join(F.broadcast(state), "g") if few else joined_by_key(each, state, ["g"], total, "texts")

    def stepped(state: DataFrame, step: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
        distance = placed(state).withColumn("class", F.floor(CLASSES * F.log2(_square() + 1e-9)).cast("int"))
        classes = distance.groupBy("g", "start", "class").agg(F.count("*").alias("n"), F.array(*map(F.sum, terms)).alias("sums"))
        return checkpointed(classes.groupBy("g", "start").applyInPandas(step, _ESTIMATE))

    whitened = [F.col("state")[_DIMENSIONS + _PAIRS.index((i, i))] * (F.col(_X[i]) - F.col("state")[i]) for i in range(_DIMENSIONS)]
    square = reduce(add, (w * w for w in whitened)) + 1e-9
    directions = F.array(*(F.sum(whitened[i] * whitened[j] / square) for i, j in _PAIRS))
    sums = placed(state).groupBy("g").agg(F.count("*").alias("n"), F.array(*map(F.sum, terms)).alias("sums"), directions.alias("directions"), F.any_value("state").alias("state"))
    trial = checkpointed(sums.groupBy("g").applyInPandas(_more_starts, _ESTIMATE))
    for _ in range(TRIALS):
        trial = stepped(trial, _step)
    best = trial.groupBy("g").agg(F.min(F.struct("size", "start")).alias("b")).select("g", F.col("b.start").alias("start"))
    state = checkpointed(trial.join(best, ["g", "start"]))
    for _ in range(STEPS):
        state = stepped(state, _step)
    state = stepped(state, _reweighted)
    after = stepped(state, _step)  # only gives the median of the distances
    return state.drop("median").join(after.select("g", "median"), "g")


def judged(
    docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source", tail: float = TAIL, least: int = LEAST
) -> DataFrame:
    """One row per row of ``docs``: the id, the counts, ``base_failed``, ``kept``, and ``distance``, whose squares are scaled to chi-square."""
    rows = checkpointed(measured(docs, text, key, lang, source))
    models = checkpointed(estimates(rows.where("not base_failed")).where((F.col("n") >= least) | (F.col("g") == "all")))
    few = models.count() <= FEW  # else the joins are left to adaptive execution
    for level in range(3):
        model = models.select(F.col("g").alias(f"g{level}"), F.struct("median", "state").alias(f"model{level}"))
        rows = rows.join(F.broadcast(model) if few else model, F.get("groups", F.lit(level)) == F.col(f"g{level}"), "left")
    rows = rows.select("id", *_COUNTS, "base_failed", *_X, F.coalesce(*(f"model{i}" for i in range(3))).alias("model"))
    rows = rows.select("id", *_COUNTS, "base_failed", *_X, "model.*")
    distance = F.coalesce(F.sqrt(_square() * chi_square(0.5) / F.col("median")), F.lit(0.0))  # without any estimate: no outlier
    kept = ~F.col("base_failed") & (F.col("distance") <= chi_square(tail) ** 0.5)
    return rows.withColumn("distance", distance).select(F.col("id").alias(key), *_COUNTS, "base_failed", kept.alias("kept"), "distance")
