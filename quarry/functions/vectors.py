"""Column functions on vectors (arrays of numbers), in double precision."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import Remembered, let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def hashed_embedding(tokens: Column, size: int = 64) -> Column:
    """A deterministic stand-in for a model: token counts by hash, scaled to length 1; zero without tokens."""

    def counted(at: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(at, lambda x: x == i)).cast("double"))

    def scaled(counts: Column) -> Column:
        length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
        return let(F.struct(counts.alias("counts"), length.alias("length")), lambda v: F.transform(v["counts"], lambda x: F.when(v["length"] > 0, x / v["length"]).otherwise(0.0).cast("float")))

    slots = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
    return let(let(slots, counted), scaled)


#: Takes texts, gives a vector for each, in order.
Model = Callable[[list[str]], Sequence[Sequence[float]]]


def embedding(text: Column, load: Callable[[], Model], block: int = 64) -> Column:
    """Vectors of ``text`` by a model of one's own, as an array of floats; null for a null text.

    ``load`` is called once in each task, on the executor, before the first text; the model then gets at most ``block``
    texts at once, empty ones too. A model that gives more or fewer vectors than it got texts is an error.
    """

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for batch in batches:
            model = model or load()
            texts = batch.dropna()
            found = []
            for start in range(0, len(texts), block):
                part = texts.iloc[start : start + block].tolist()
                given = [[float(x) for x in v] for v in model(part)]
                if len(given) != len(part):
                    raise ValueError(f"the model gave {len(given)} vectors for {len(part)} texts")
                found += given
            yield pd.Series(found, index=texts.index, dtype=object).reindex(batch.index).astype(object).where(batch.notna(), None)

    return vectors(text)


#: Numbers of a vector of hashed words.
HASHED = 64
_WORD = re.compile(r"[^\W_]+")


def hashed_words_model() -> Model:
    """A stand-in for a trained model, the same everywhere: counts of words by hash, scaled to length 1; zero without words."""
    slots = Remembered(lambda word: hashlib.md5(word.encode()).digest()[0] % HASHED)

    def vectors(texts: list[str]) -> list[list[float]]:
        found = []
        for text in texts:
            counts = [0] * HASHED
            for slot, n in Counter(map(slots.__getitem__, _WORD.findall(text.lower()))).items():
                counts[slot] = n
            length = math.sqrt(sum(c * c for c in counts)) or 1.0
            found.append([c / length for c in counts])
        return found

    return vectors


def hashed_words(text: Column) -> Column:
    return embedding(text, hashed_words_model, block=32)
