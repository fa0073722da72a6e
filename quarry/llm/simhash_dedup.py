"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Every bit position gets a nonzero code of ``radius + 1`` bits. For each nonzero pattern of that many bits one
table is built, whose mask keeps the positions where code and pattern have odd parity. The codes of ``radius``
positions span a subspace that some pattern is orthogonal to, so two fingerprints that differ in at most
``radius`` bits agree on all of that pattern's mask: every such pair collides in some table, none is missed.

Defined results: null text counts as empty; an empty text has fingerprint zero, which links like any other;
repeated rows and repeated ids are kept as rows of their own; a null id gets a component like any other, named by
the smallest id that is not null (null if there is none); an empty table gives an empty result; further
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quarry.llm.components import connected_components
from quarry.llm.shared import checkpointed, joined_by_key

BITS = 64
#: Buckets of more distinct fingerprints than this are linked by balls around shared points, not by pairs.
LARGE_BUCKET = 4096
#: Shingles whose bits are counted at once, for bounded memory.
BLOCK = 1 << 15


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The bits that over half of ``n`` hashes have, as a signed 64-bit integer."""
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint of one text, as a signed 64-bit integer."""
    tokens = (text or "").encode().lower().split()  # bytes: only A-Z change, only the six ASCII blanks part words
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles: list[bytes] = [b" ".join(tokens)]
    else:
        shingles = list(map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)))
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, len(shingles), BLOCK):
        part = shingles[start : start + BLOCK]
        ones += bits_set(np.fromiter((digest(s, 42) for s in part), np.uint64, len(part)))
    return majority(ones, len(shingles))


def fingerprint_column(text: Column, words: int) -> Column:
    @F.pandas_udf(LongType())
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t, words) for t in batch], dtype="int64")

    return prints(text)


def covering_masks(radius: int) -> list[int]:
    """Masks (signed) of the covering family, each of half of the bits at least.

    Up to radius 5 the nonzero codes go round the positions. For 6 the codes are those of the Reed-Muller code of
    length 64: codes with the top bit set, under which every pattern has odd parity at 32 positions or at all.
    """
    if not 1 <= radius <= 6:
        raise ValueError("masks are selective for a radius from 1 to 6 only")
    patterns = range(1, 2 ** (radius + 1))
    codes = [1 + i % len(patterns) if radius < 6 else BITS | i for i in range(BITS)]
    masks = [sum(1 << i for i in range(BITS) if (codes[i] & p).bit_count() % 2) for p in patterns]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _near_points(mask: int, radius: int) -> list[tuple[int, int]]:
    """What to xor to reach all points in a bucket of this mask at up to ceil(radius / 2), with the distance."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    flips = [(sum(1 << i for i in c), n) for n in range((radius + 1) // 2 + 1) for c in combinations(free, n)]
    return [(x - (1 << 64) if x >> 63 else x, n) for x, n in flips]


def _links_in_large(live: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Links among the members of large buckets, linear in the members.

    Two members within ``radius`` have a point that is within ``radius // 2`` of one and within the rest of the
    other. All members within ``radius // 2`` of a point lie within ``radius`` of all within the rest, so each is
    linked with the smallest of the former: same components as all pairs, and each a true link.
    """
    spark = live.sparkSession
    rows = [(t, x, n) for t, m in enumerate(masks) for x, n in _near_points(m, radius)]
    flips = spark.createDataFrame(rows, "t int, flip long, far int").groupBy("t").agg(
        F.collect_list(F.struct("flip", "far")).alias("flips")
    )
    points = (
        live.select("t", "fp").join(F.broadcast(flips), "t")  # one row for each table: fixed by the radius
        .select("fp", F.explode("flips").alias("f"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("f.flip")).alias("point"), "f.far")
    )
    centres = (
        points.groupBy("point")
        .agg(F.min(F.when(F.col("far") <= radius // 2, F.col("fp"))).alias("to"), F.max("fp").alias("most"), F.min("fp").alias("least"))
        .where("to is not null and most > least")
    )
    return points.join(centres, "point").where("fp <> to").select(F.col("fp").alias("a"), F.col("to").alias("b")).distinct()


def _neighbours(radius: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """From rows ``t``, ``key``, ``fp`` in order to the links between rows that follow each other in one bucket."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = np.zeros((3, 0), np.int64)
        for batch in batches:
            t, key, fp = np.concatenate([before, batch[["t", "key", "fp"]].to_numpy(np.int64).T], axis=1)
            near = (t[1:] == t[:-1]) & (key[1:] == key[:-1]) & (np.bitwise_count((fp[1:] ^ fp[:-1]).view(np.uint64)) <= radius)
            yield pd.DataFrame({"a": fp[1:][near], "b": fp[:-1][near]})
            before = np.array([[t[-1]], [key[-1]], [fp[-1]]]) if len(fp) else before

    return link


def fingerprint_links(fingerprints: DataFrame, radius: int = 3, large: int = LARGE_BUCKET) -> DataFrame:
    """Links ``a``, ``b`` within ``radius`` bits that connect whatever all such pairs connect; ``fp`` is distinct.

    First neighbours in each bucket's order are linked, which joins most of a group of near copies by as many
    links as it has members. Then pairs are looked for only in buckets whose members are not all connected yet,
    and only between members that are not. Rows are dealt by ranges of bucket and fingerprint, and buckets are measured in
    partial aggregates, so that a bucket of any size fills no single task.
    """
    masks = covering_masks(radius)
    partitions = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def keyed(rows: DataFrame) -> DataFrame:
        spread = rows.repartition(partitions, "fp")  # few bytes make many rows
        return spread.select("*", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("t", "key"))

    order = ["t", "key", "fp"]
    ordered = keyed(fingerprints.select("fp")).select(*order).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    first = checkpointed(ordered.mapInPandas(_neighbours(radius), "a long, b long").distinct())

    roots = connected_components(first, "a", "b").withColumnRenamed("node", "fp")
    rooted = checkpointed(fingerprints.select("fp").join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))
    buckets = keyed(rooted).groupBy("t", "key").agg(F.count("*").alias("members"), F.min("root").alias("least"), F.max("root").alias("most"))
    open_buckets = checkpointed(buckets.where("least < most").select("t", "key", "members"))  # few are left
    live = checkpointed(joined_by_key(keyed(rooted), open_buckets, ["t", "key"], rooted.count(), "members").select("t", "key", "fp", "members", "root"))
    small = live.where(F.col("members") <= large)
    x, y = small.alias("x"), small.alias("y")
    pairs = x.join(
        y,
        (F.col("x.t") == F.col("y.t")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (F.col("x.root") != F.col("y.root"))
        & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius),
    ).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    links = first.union(pairs)
    if live.where(F.col("members") > large).isEmpty():
        return links
    return links.union(_links_in_large(live.where(F.col("members") > large), masks, radius))


def _labelled(rows: DataFrame, radius: int) -> DataFrame:
    """``rows`` (``id``, ``fp``) with ``root``, the least fingerprint of the component, and ``component_id``, the least id."""
    classes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(fingerprint_links(classes.select("fp"), radius), "a", "b")
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = checkpointed(rooted)
    named = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    answers = joined_by_key(rooted, named, ["root"], rooted.count()).select("fp", "root", "component_id")
    sizes = rows.groupBy("fp").agg(F.count("*").alias("copies"))
    return joined_by_key(rows, answers.join(sizes, "fp"), ["fp"], rows.count(), "copies")


def simhash_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of ``docs``: the id, ``fingerprint`` (16 hex digits) and ``component_id``."""
    rows = checkpointed(docs.select(F.col(key).alias("id"), fingerprint_column(F.col(text), words).alias("fp")))
    return _labelled(rows, radius).select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, radius: int = 6) -> DataFrame:
    """``docs`` without near copies: of each component one row stays, that with the smallest id (a null id comes last)."""
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("id"), F.xxhash64(text).alias("mark"))
    prints = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("mark"), fingerprint_column(F.col(text), words).alias("fp"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "fp", "mark")).alias("first")
    kept = checkpointed(_labelled(checkpointed(prints), radius).groupBy("root").agg(first).select("first.id", "first.mark"))
    m, k = marked.alias("m"), kept.alias("k")
    same = (F.col("m.mark") == F.col("k.mark")) & F.col("m.id").eqNullSafe(F.col("k.id"))
    return m.join(k, same, "left_semi").dropDuplicates(["id", "mark"]).select("row.*")
