"""Packing of documents into token windows, each filled with lexical neighbours of its first document.

Each document has a first and a second term, drawn by MinHash weighted towards rare tokens, so that documents share
them the more often the more rare tokens they share. Documents are ordered by a column with few values (such as the
language), first term, second term and a hash of id and tokens, dealt over tasks by ranges of that order, and each
task cuts its rows, as they come, into shards of bounded bytes and rows, so that documents with common rare tokens
stand in one shard or in the next ones, and no group of documents, however large, makes a large task or shard.

A shard builds a BM25 inverted index over its documents' tokens. A window opens with what is left of the document that
the last one cut, else the next unused document: its seed. When a document ends inside the window, the index gives
the unused document that scores best against the seed; if none shares a useful term, the next unused one follows. Only
the last window of a shard can stay short, so padding is below one window a shard.

Defined results: a null text counts as empty; an empty text is the end id alone; a null id is kept as it is; rows
are packed as often as they stand; an empty table gives an empty result; further columns are not read; ties in
order or score go to the row that comes first.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import written
from quarry.llm.tokens import encoder

#: UTF-8 bytes of text in a shard, about; bytes each document counts for besides, which bound a shard's rows.
SHARD_BYTES, ROW_BYTES = 2_000_000, 40
#: Bits of a window's number within its shard, and of a shard's within its task.
WINDOW_BITS, SHARD_BITS = 28, 15
K1, B = 1.2, 0.75
#: Power of the inverse document frequency in the weight of a token.
RARE = 3.0
PIECES = "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Vocabulary:
    """A file of ranks, the pattern that parts text into pre-tokens, special strings with their ids, the end id."""

    ranks: str
    pattern: str
    special: tuple[tuple[str, int], ...] = ()
    end: int = 1

    def kind(self) -> np.dtype:
        """The least unsigned integers that hold every id."""
        most = max([self.end, encoder(self.ranks, self.pattern).encoding.max_token_value, *(i for _, i in self.special)])
        return np.dtype("<u2" if most < 1 << 16 else "<u4")

    def ids(self, text: str) -> np.ndarray:
        words = encoder(self.ranks, self.pattern)
        if not any(name in text for name, _ in self.special):
            return np.append(words.ids(text), np.uint32(self.end))
        parts = [text]
        for name, value in self.special:
            parts = [y for x in parts for y in (_between(x, name, value) if isinstance(x, str) else [x])]
        found = [words.ids(x) if isinstance(x, str) else np.array([x]) for x in parts]
        return np.concatenate([*found, [self.end]]).astype("<u4")


def _between(text: str, name: str, value: int) -> list[str | int]:
    first, *rest = text.split(name)
    return [first, *(y for x in rest for y in (value, x))]


class InvertedIndex:
    """BM25 over the token ids of a shard's documents; tokens in half of the documents or more are not indexed."""

    def __init__(self, documents: list[np.ndarray]) -> None:
        n = len(documents)
        counted = [np.unique(d, return_counts=True) for d in documents]
        self.terms = [t for t, _ in counted]
        terms, tf = np.concatenate(self.terms), np.concatenate([n for _, n in counted])
        owner = np.repeat(np.arange(n), [len(t) for t in self.terms])
        lengths = np.array([len(d) for d in documents], float)
        df = np.bincount(terms)
        idf = np.log((n - df + 0.5) / (df + 0.5))
        useful = (idf[terms] > 0) & (df[terms] > 1)
        terms, tf, owner = terms[useful], tf[useful], owner[useful]
        order = np.argsort(terms, kind="stable")
        self.owner = owner[order]
        norm = K1 * (1 - B + B * lengths / lengths.mean())
        self.weight = (idf[terms] * tf * (K1 + 1) / (tf + norm[owner]))[order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(df)))])
        self.end = self.begin[1:]
        self.size = n

    def scores(self, document: int) -> np.ndarray:
        """Scores of all documents for the terms of one."""
        begin, end = self.begin[self.terms[document]], self.end[self.terms[document]]
        lengths = end - begin
        at = np.repeat(begin - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        return np.bincount(self.owner[at], self.weight[at], self.size)

    def keep(self, documents: np.ndarray) -> None:
        """Leaves only these documents' postings (a boolean for each document); no score of theirs changes."""
        kept = documents[self.owner]
        upto = np.concatenate([[0], np.cumsum(kept)])
        self.owner, self.weight, self.begin = self.owner[kept], self.weight[kept], upto[self.begin]
        self.end = self.begin[1:]

    def nearest(self, document: int) -> list[int]:
        """The documents that share a useful term with one, best first."""
        scores = self.scores(document)
        found = np.flatnonzero(scores > 0)
        return found[np.argsort(-scores[found], kind="stable")].tolist()


def pack(documents: list[np.ndarray], window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces as (document, start, length, window, offset) in the order of the windows."""
    index = InvertedIndex(documents)
    unused = bytearray(b"\x01") * len(documents)
    following = number = fill = 0
    seed, neighbours = -1, iter(())
    left = len(documents) // 2
    for taken in range(len(documents)):
        if fill and seed >= 0:
            if len(documents) - taken < left:  # half of the postings are of used documents
                index.keep(np.frombuffer(unused, bool))
                left //= 2
            neighbours, seed = iter(index.nearest(seed)), -1  # ranked once a window, and only if it has room
        current = next((d for d in neighbours if unused[d]), -1) if fill else -1
        if current < 0:
            following = unused.index(1, following)
            current = following
        unused[current] = 0
        start, tokens = 0, len(documents[current])
        while start < tokens:
            if not fill:
                seed = current
            length = min(window - fill, tokens - start)
            yield current, start, length, number, fill
            start, fill = start + length, fill + length
            if fill == window:
                number, fill = number + 1, 0


class _Distinct:
    """The distinct tokens of documents, in any order, by the place where each stands last."""

    def __init__(self) -> None:
        self.last = np.zeros(0, np.int64)

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        if (most := int(tokens.max())) >= len(self.last):
            self.last = np.zeros(2 * most + 1, np.int64)
        at = np.arange(len(tokens))
        self.last[tokens] = at
        return tokens[self.last[tokens] == at]


def _counts(kind: np.dtype) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """In how many documents each token stands, for the rows of a task; token -1 counts the documents."""
        n, documents, distinct = np.zeros(0, np.int64), 0, _Distinct()
        for batch in batches:
            for b in batch["ids"]:
                tokens = distinct(np.frombuffer(b, kind))
                if len(distinct.last) > len(n):
                    n = np.concatenate([n, np.zeros(len(distinct.last) - len(n), np.int64)])
                n[tokens] += 1
            documents += len(batch)
        seen = np.flatnonzero(n)
        yield pd.DataFrame({"token": [-1, *seen], "n": [documents, *n[seen]]})

    return count


def _draws(counts: pd.DataFrame) -> np.ndarray:
    """Two random numbers for each token, the smaller the rarer it is; infinite for tokens of no or one document."""
    df = np.zeros(int(counts["token"].max() if len(counts) else 0) + 1)
    found = counts[counts["token"] >= 0]
    df[found["token"]] = found["n"]
    idf = np.log((counts["n"][counts["token"] == -1].sum() + 1) / np.maximum(df, 1))
    drawn = np.random.default_rng(42).exponential(size=(len(df), 2)).T  # a token's draws don't depend on how many there are
    return np.where((df > 1) & (idf > 0), drawn / np.maximum(idf, 1e-9) ** RARE, np.inf)


def _terms(ids: Column, draws: np.ndarray, kind: np.dtype) -> Column:
    """The first and second term of a document: the tokens whose draws are least; -1 for none."""

    @F.pandas_udf("first long, second long")
    def terms(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        distinct = _Distinct()
        for batch in batches:
            found = np.full((len(batch), 2), -1)
            for i, b in enumerate(batch):
                tokens = distinct(np.frombuffer(b, kind))
                own = draws[:, tokens]
                at = own.argmin(axis=1)
                found[i] = np.where(np.isinf(own[[0, 1], at]), -1, tokens[at])
            yield pd.DataFrame(found, columns=["first", "second"])

    return terms(ids)


def _filled(window: int, shard_bytes: int, kind: np.dtype) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """From a task's rows, in order, to the pieces of its shards."""

    def packed_shard(keys: list, documents: list[np.ndarray], shard: int) -> pd.DataFrame:
        found = [
            (keys[d], start, length, zlib.crc32(documents[d][start : start + length].astype("<u4")), len(documents[d]), (shard << WINDOW_BITS) + number, offset)
            for d, start, length, number, offset in pack(documents, window)
        ]
        pieces = pd.DataFrame(found, columns=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        return pieces.assign(key=pieces["key"].astype("Int64"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = TaskContext.get().partitionId() << SHARD_BITS
        keys, documents, size, value = [], [], 0, None
        for batch in batches:
            batch_keys = batch["key"].astype("Int64").astype(object).where(batch["key"].notna(), None)
            for key, near, more, ids in zip(batch_keys, batch["near"], batch["bytes"], batch["ids"], strict=True):
                if documents and (near != value or size + more > shard_bytes):
                    yield packed_shard(keys, documents, shard)
                    keys, documents, size, shard = [], [], 0, shard + 1
                keys.append(key)
                documents.append(np.frombuffer(ids, kind))
                size, value = size + more, near
        if documents:
            yield packed_shard(keys, documents, shard)

    return fill


def packed(docs: DataFrame, vocabulary: Vocabulary, window: int = 2048, text: str = "text", key: str = "doc_id", near: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Shards hold rows of one value of the column ``near``. The driver sees one count for each token of the vocabulary.
    """

    kind = vocabulary.kind()

    def tokenised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"].astype("Int64"), "near": batch["near"], "bytes": batch["bytes"], "ids": [vocabulary.ids(t).astype(kind).tobytes() for t in batch["text"]]})

    value = F.coalesce(F.col(near).cast("string"), F.lit("")) if near else F.lit("")
    whole = F.coalesce(text, F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("key"), value.alias("near"), (F.octet_length(whole) + ROW_BYTES).cast("long").alias("bytes"), whole.alias("text"))
    tokens = written(rows.mapInPandas(tokenised, "key long, near string, bytes long, ids binary"), "tokens")
    counts = tokens.select("ids").mapInPandas(_counts(kind), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    terms = _terms(F.col("ids"), _draws(counts.toPandas()), kind)
    drawn = written(tokens.select("key", "near", "bytes", F.xxhash64("key", "ids").alias("salt"), "ids", terms.alias("t")), "drawn")
    order = ["near", F.col("t.first"), F.col("t.second"), "salt"]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = drawn.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return dealt.select("key", "near", "bytes", "ids").mapInPandas(_filled(window, shard_bytes, kind), PIECES).withColumnRenamed("key", key)
