"""Byte-level BPE encoding and decoding of texts of any length, long ones in overlapping chunks.

A text longer than ``chunk`` is dealt out in chunks that overlap. Each is pre-tokenised on its own, from its
first character on. Pre-tokenising looks only ahead, so once two neighbours share a boundary in their overlap
they agree from there on: the text is cut at the first such boundary, and the pieces between cuts are encoded in
parallel. A boundary counts only where a pre-token ends that does not touch the chunk's end (it might go on) and
does not end in white space (whose split depends on what follows). A text of which some overlap has no common
boundary, such as one word longer than it, is encoded whole.

Defined results: a null text counts as empty; an empty text has no ids; null and repeated ids are kept as they
stand; equal long texts are encoded once; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType
from pyspark.sql.window import Window

from quarry.llm.tokens import encoder, encoding

#: Code points of a chunk without its overlap, and of the overlap.
CHUNK, OVERLAP = 1 << 15, 1 << 9


def encoded(text: str, ranks: str, pattern: str) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers."""
    return encoder(ranks, pattern).ids(text).tobytes()


def decoded(ids: bytes, ranks: str, pattern: str) -> bytes:
    return encoding(ranks, pattern).decode_bytes(np.frombuffer(ids, "<u4").tolist())


def boundaries(piece: str, start: int, last: bool, chunk: int, overlap: int, pattern: regex.Pattern) -> tuple[list[int], list[int]]:
    """Positions in the text at which the chunk from ``start`` on may be cut, in the overlaps before and behind it."""
    ends = np.fromiter((m.end() for m in pattern.finditer(piece)), np.int64)
    head = [start, *(start + ends[ends < overlap]).tolist()]
    if last:
        return head, []
    tail = [int(e) for e in ends[(ends >= chunk) & (ends < len(piece))] if not piece[e - 1].isspace()]
    return head, [start + e for e in tail]


def _pieces(long: DataFrame, ranks: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Columns ``sha``, ``k`` and ``ids`` for the pieces of each text (``sha``, ``text``) that could be cut."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sha, text in zip(batch["sha"], batch["text"], strict=True):
                starts = range(0, len(text), chunk)
                yield pd.DataFrame({"sha": sha, "k": range(len(starts)), "n": len(starts), "piece": [text[s : s + chunk + overlap] for s in starts]})

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = regex.compile(pattern)
        for batch in batches:
            found = [
                boundaries(p, k * chunk, k == n - 1, chunk, overlap, compiled)
                for k, n, p in zip(batch["k"], batch["n"], batch["piece"], strict=True)
            ]
            yield pd.DataFrame({"sha": batch["sha"], "k": batch["k"], "n": batch["n"], "head": [h for h, _ in found], "tail": [t for _, t in found]})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [
                p[a - k * chunk : None if b < 0 else b - k * chunk]
                for p, k, a, b in zip(batch["piece"], batch["k"], batch["begin"], batch["end"], strict=True)
            ]
            yield pd.DataFrame({"sha": batch["sha"], "k": batch["k"], "ids": [encoded(t, ranks, pattern) for t in texts]})

    dealt = long.mapInPandas(deal, "sha string, k int, n int, piece string")
    dealt = dealt.groupBy("sha", "k").agg(F.first("n").alias("n"), F.first("piece").alias("piece"))  # deals out the work too
    seen = dealt.mapInPandas(look, "sha string, k int, n int, head array<long>, tail array<long>")
    by_text = Window.partitionBy("sha").orderBy("k")
    cuts = (
        seen.withColumn("common", F.array_min(F.array_intersect("head", F.lag("tail").over(by_text))))
        .withColumn("begin", F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(F.col("common")))
        .withColumn("end", F.when(F.col("k") == F.col("n") - 1, F.lit(-1).cast("long")).otherwise(F.lead("begin").over(by_text)))
        .withColumn("whole", F.min(F.col("begin").isNotNull() & F.col("end").isNotNull()).over(Window.partitionBy("sha")))
        .where("whole")
        .select("sha", "k", "begin", "end")
    )
    return dealt.join(cuts, ["sha", "k"]).select("sha", "k", "piece", "begin", "end").mapInPandas(encode, "sha string, k int, ids binary")


def encoded_column(text: Column, ranks: str, pattern: str) -> Column:
    @F.pandas_udf(BinaryType())
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else encoded(t, ranks, pattern) for t in batch], dtype=object)

    return encode(text)


def decoded_column(ids: Column, ranks: str, pattern: str) -> Column:
    """The bytes that an ``ids`` column of 32-bit integers stands for."""

    @F.pandas_udf(BinaryType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if i is None else decoded(i, ranks, pattern) for i in batch], dtype=object)

    return decode(ids)


def _concatenated(parts: Column) -> Column:
    @F.pandas_udf(BinaryType())
    def concatenate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([b"".join(p["ids"] for p in sorted(x, key=lambda p: p["k"])) for x in batch], dtype=object)

    return concatenate(parts)


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", key: str = "doc_id", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``docs``: the id and ``ids``, little-endian unsigned 32-bit integers in a binary."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk).select("key", encoded_column(F.col("text"), ranks, pattern).alias("ids"))
    long = rows.where(F.length("text") > chunk).withColumn("sha", F.sha2("text", 256))
    pieces = _pieces(long.select("sha", "text"), ranks, pattern, chunk, overlap)
    stitched = pieces.groupBy("sha").agg(F.collect_list(F.struct("k", "ids")).alias("parts")).select("sha", _concatenated(F.col("parts")).alias("ids"))
    joined = long.join(stitched, "sha", "left")
    rest = encoded_column(F.when(F.col("ids").isNull(), F.col("text")), ranks, pattern)
    return short.union(joined.select("key", F.coalesce("ids", rest))).withColumnRenamed("key", key)


def digests(docs: DataFrame, ranks: str, pattern: str, **more: object) -> DataFrame:
    """The id, ``n_tokens``, and SHA-256 of the ids and of the bytes they decode to."""
    key = str(more.get("key", "doc_id"))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(decoded(i, ranks, pattern)).hexdigest()) for i in batch]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(docs, ranks, pattern, **more).select(key, digest("ids").alias("d")).select(key, "d.*")
