"""Near copies by Jaccard similarity of word shingles: SimHash fingerprints propose pairs, the texts decide.

Each text gets a SimHash fingerprint of its distinct shingles, which goes to the covering tables of ``simhash_dedup``: all
pairs within ``RADIUS`` bits meet in a bucket, none is missed. Fingerprints of near copies may lie further apart (some 10
bits at a similarity of 0.8, 7 at 0.9); for these each text also gets ``BANDS * ROWS`` minima over its shingles, and two
texts meet in a bucket too if all minima of a band agree. A pair of 0.8 meets in some band with probability 0.9994, one of
0.9 practically always. No pair is linked before the shingles of both texts were compared. Texts of equal shingle sets form one
class; those of so few shingles that no other set can be near go to no bucket.

First neighbours in each bucket's order are compared, a number of pairs linear in the texts: one of each text's
neighbours, then those that this leaves unconnected. Of the buckets whose
members are not all connected, each text's rarest shingles among all texts of such buckets are taken, as many as a near
copy may lack and one more. Near copies share one of them; so a text whose rarest shingles no other one has can be
passed over, which are most of the outliers of large groups. The rest is compared with the most ordinary text of each
bucket, again linear in the texts, and at last, where members are still apart, with all members of other components
that share a rarest shingle; pairs whose maps of shingles show that they can't be near are passed over. Texts are dealt by ranges of bucket and name, and the ends of all ranges are put in order
once more, so that no neighbours are lost where a range ends; buckets are measured in partial aggregates, so that no
bucket fills a single task. Pairs meet the hashed shingles of both texts, made once for each text, inside the JVM; a text
with very many pairs stands in several parts.

Defined results: null text counts as empty; texts without words form one class; a text of fewer words than a shingle
is one shingle; repeated rows and null ids are kept as rows of their own until one of each group is chosen; an
empty table gives an empty result; further columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import connected_components
from quarry.llm.shared import HOT_KEYS, checkpointed
from quarry.llm.simhash_dedup import BITS, bits_set, covering_masks, majority

#: Bits by which fingerprints may differ and yet are sure to meet in a table.
RADIUS = 6
BANDS, ROWS = 40, 8
#: Least similarity of near copies, in tenths, so that no rounding decides.
TENTHS = 8
#: Bits of a text's map of shingles, for an exact bound on what two texts have in common.
MAP = 2048
#: Shingles hashed at once, for bounded memory.
BLOCK = 256
#: Counters of shingles, a fixed number of one byte each; parts into which the texts of a bucket are dealt.
COUNTERS, PARTS = 1 << 20, 16
FULL = 255

_RANDOM = np.random.default_rng(42)
_FACTOR = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SUMMAND = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2)


def shingles(text: str | None, words: int) -> set[bytes]:
    tokens = (text or "").encode().lower().split()  # bytes: only A-Z change, only the six ASCII blanks part words
    if len(tokens) < words:
        return {b" ".join(tokens)} if tokens else set()
    return set(map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)))


def sketch(text: str | None, words: int) -> tuple[bytes, int, int, list[int], list[int]]:
    """A name of the shingle set, its size, its fingerprint, a map with a bit set for each shingle (several may share one), and the keys of the bands."""
    found = shingles(text, words)
    hashes = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))
    name = xxhash.xxh3_128_digest(hashes.tobytes())
    if not found:
        return name, 0, 0, [0] * (MAP // 64), []
    ones = np.zeros(BITS, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), BLOCK):
        part = hashes[start : start + BLOCK]
        ones += bits_set(part)
        np.minimum(least, (part[:, None] * _FACTOR + _SUMMAND).min(0), out=least)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), seed=t) for t, band in enumerate(least.reshape(BANDS, ROWS))]
    bits = np.packbits(np.bincount((hashes % np.uint64(MAP)).astype(np.int64), minlength=MAP) > 0).view(np.int64).tolist()
    return name, len(found), majority(ones, len(found)), bits, np.array(keys, np.uint64).view(np.int64).tolist()


def _sketch_column(text: Column, words: int) -> Column:
    @F.pandas_udf("name binary, n long, fp long, bits array<long>, keys array<long>")
    def sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([sketch(t, words) for t in batch], columns=["name", "n", "fp", "bits", "keys"])

    return sketches(text)


def _classes(rows: DataFrame, words: int) -> DataFrame:
    """One row for each set of shingles of ``rows`` (``who``, ``text``): a number ``node``, the least of ``who`` and the sketch; checkpointed."""
    sketched = rows.select("who", _sketch_column(F.col("text"), words).alias("s")).select("who", "s.*")
    first = F.min(F.struct(F.col("who.id").isNull(), "who")).alias("first")
    classes = sketched.groupBy("name").agg(first, *(F.any_value(c).alias(c) for c in ("n", "fp", "bits", "keys"))).drop("name")
    return checkpointed(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("who", F.col("first.who")).drop("first"))


def _keyed(classes: DataFrame, *more: str) -> DataFrame:
    """``node``, ``n``, ``more`` and each ``key``: buckets of the fingerprint's covering tables, and of the bands."""
    tables = F.transform(F.array(*map(F.lit, covering_masks(RADIUS))), lambda mask: F.xxhash64(mask, F.col("fp").bitwiseAND(mask)))
    others = classes.where(10 * F.col("n") >= TENTHS * (F.col("n") + 1))  # a set that is near to another of its size has more
    return others.select("node", "n", *more, F.explode(F.concat(tables, "keys")).alias("key"))


def _with_set(pairs: DataFrame, end: str, sets: DataFrame, total: int) -> DataFrame:
    """``pairs`` with the set of ``end``; the sets of nodes that many of the ``total`` pairs have stand in ``PARTS`` parts."""
    hot = pairs.groupBy(end).agg(F.count("*").alias("pairs")).where(F.col("pairs") * HOT_KEYS > total).select(F.col(end).alias("node"), F.lit(True).alias("hot"))
    marked = F.broadcast(hot)  # fewer than ``HOT_KEYS`` names
    other = "b" if end == "a" else "a"
    dealt = pairs.join(marked, pairs[end] == marked["node"], "left").withColumn("part", F.when(F.col("hot"), F.pmod(F.hash(other), F.lit(PARTS))).otherwise(0)).drop("node", "hot")
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    copies = sets.join(marked, "node", "left").select(F.col("node").alias(end), F.col("grams").alias(f"grams_{end}"), F.explode(parts).alias("part"))
    return dealt.join(copies, [end, "part"]).drop("part")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``pairs`` (``a``, ``b``) those whose sets (``node``, ``grams``: the hashes of its shingles) are near copies."""
    pairs = checkpointed(pairs)
    total = pairs.count()
    both = _with_set(_with_set(pairs, "a", sets, total), "b", sets, total)
    counted = both.select("a", "b", F.size(F.array_intersect("grams_a", "grams_b")).alias("common"), (F.size("grams_a") + F.size("grams_b")).alias("n"))
    return checkpointed(counted.where(10 * F.col("common") >= TENTHS * (F.col("n") - F.col("common"))).select("a", "b"))


def _alike_in_size(a: Column, b: Column) -> Column:
    return 10 * F.least(a, b) >= TENTHS * F.greatest(a, b)


_ORDER = ["key", "n", "node"]


def _may_be_near(a: str, b: str) -> Column:
    """Whether two texts (prefixes of ``n`` and ``bits``) can have as many shingles in common as near copies have.

    Each bit that only one of the maps has stands for a shingle at least that the other text lacks: an exact bound.
    """
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    alone = lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))
    lacks = lambda x, y: F.aggregate(F.zip_with(f"{x}bits", f"{y}bits", alone), F.lit(0), lambda n, c: n + c)
    return (10 + TENTHS) * F.least(n - lacks(a, b), m - lacks(b, a)) >= TENTHS * (n + m)


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows ``key``, ``n``, ``node`` in order to the pairs that follow each other in one bucket, and the first and the last row, without ``b``."""
    first = last = None
    for batch in batches:
        if not len(batch):
            continue
        first = batch[:1] if first is None else first
        both = batch if last is None else pd.concat([last, batch], ignore_index=True)
        same = both["key"].to_numpy()[1:] == both["key"].to_numpy()[:-1]
        a, b = both[:-1][same], both[1:][same]
        alike = 10 * a["n"].to_numpy() >= TENTHS * b["n"].to_numpy()
        yield pd.DataFrame({"a": a["node"].to_numpy(), "b": b["node"].to_numpy(), "alike": alike, "key": a["key"].to_numpy(), "n": a["n"].to_numpy()})
        last = both[-1:]
    if last is not None:
        ends = pd.concat([first, last], ignore_index=True).drop_duplicates(["key", "node"])
        yield pd.DataFrame({"a": ends["node"], "b": None, "alike": False, "key": ends["key"], "n": ends["n"]})


def _met(keyed: DataFrame) -> DataFrame:
    """``a``, ``b``, ``alike``: every member of a bucket with the next one of the bucket, whatever ranges they were dealt to; checkpointed."""
    partitions = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.select(*_ORDER).repartitionByRange(partitions, *_ORDER).sortWithinPartitions(*_ORDER)
    name = keyed.schema["node"].dataType.simpleString()
    met = f"a {name}, b {name}, alike boolean, key long, n long"
    found = checkpointed(ordered.mapInPandas(_neighbours, met))
    ends = found.where("b is null").select("key", "n", F.col("a").alias("node"))  # two rows a range: few, so one task orders them
    across = ends.coalesce(1).sortWithinPartitions(*_ORDER).mapInPandas(_neighbours, met)
    return checkpointed(found.union(across).where("b is not null").select("a", "b", "alike").distinct())


def _with_bucket(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows`` joined with ``buckets``, one for each ``key``; a bucket's rows are dealt over parts, each with its copy of the bucket."""
    copies = buckets.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("part", F.pmod(F.hash("node"), F.lit(PARTS))).join(copies, ["key", "part"]).drop("part")


def _rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the ``root`` to which ``links`` connect ``node``; checkpointed."""
    roots = connected_components(links, "a", "b")
    return checkpointed(rows.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))


def _apart(keyed: DataFrame) -> DataFrame:
    """The rows of ``keyed`` (``node``, ``key``, ``root``) in buckets that have several roots; checkpointed."""
    buckets = keyed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    return checkpointed(_with_bucket(keyed, buckets.where("least < most").select("key")))


def _grams(text: str | None, words: int) -> np.ndarray:
    found = shingles(text, words)
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))


def _rarest(sets: DataFrame) -> DataFrame:
    """``node``, ``rare``, ``own``: of the ``n // 5 + 1`` rarest shingles of a node those that another may have, and how many it has alone.

    A near copy has at least four fifths of a node's shingles, so that two near copies share one of ``rare`` of both: the
    rarest shingle that they have in common. Nodes without any are left out. Shingles are counted over ``sets`` (``node``,
    ``grams``) in a fixed number of counters: those that share one look more common than they are, so that what
    stands alone in its counter is alone indeed. A counter stops at ``FULL``; any order that all texts share will do.
    In very large tables the counters fill up, and fewer nodes are left out.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for grams in batch["grams"]:
                np.add.at(n, (grams.view(np.uint64) % COUNTERS).astype(np.int64), 1)
        used = np.flatnonzero(n)
        yield pd.DataFrame({"slot": used, "n": n[used]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"slots": [batch["slot"].to_numpy(np.int32).tobytes()], "counts": [batch["n"].to_numpy(np.uint8).tobytes()]})

    counted = sets.select("grams").mapInPandas(count, "slot int, n long").groupBy("slot").agg(F.least(F.sum("n"), F.lit(FULL)).alias("n"))
    df = np.zeros(COUNTERS, np.uint8)
    for row in counted.mapInPandas(pack, "slots binary, counts binary").collect():  # five bytes a counter
        df[np.frombuffer(row["slots"], np.int32)] = np.frombuffer(row["counts"], np.uint8)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for node, signed in zip(batch["node"], batch["grams"], strict=True):
                grams = signed.view(np.uint64)
                seen = df[(grams % COUNTERS).astype(np.int64)]
                own, most = int((seen <= 1).sum()), len(grams) * (10 - TENTHS) // 10 + 1
                if most > own:
                    rows.append((node, own, grams[np.lexsort([grams, seen])][own:most].view(np.int64)))
            yield pd.DataFrame(rows, columns=["node", "own", "rare"])

    return checkpointed(sets.select("node", "grams").mapInPandas(choose, "node long, own int, rare array<long>"))


def _share_a_rarest() -> Column:
    """Whether ``x`` and ``y`` may have as many shingles in common as near copies of their sizes: one of each's rarest is.

    Of ``least`` common ones, the rarest is among the ``n - least + 1`` rarest of either; the first ``own`` of these none else has.
    """
    n = F.col("x.n") + F.col("y.n")
    least = F.ceil(n * TENTHS / (10 + TENTHS) - 1e-6)
    x, y = (F.slice(f"{t}.rare", F.lit(1), F.greatest(F.col(f"{t}.n") - least + 1 - F.col(f"{t}.own"), F.lit(0)).cast("int")) for t in "xy")
    return F.arrays_overlap(x, y)


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """``node`` and ``grams``, the different hashes of its shingles, from ``node`` and ``text``; checkpointed."""

    @F.pandas_udf("array<long>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_grams(t, words).view(np.int64) for t in batch], index=batch.index, dtype=object)

    return checkpointed(texts.select("node", hashed("text").alias("grams")))


def _links(classes: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """Links ``a``, ``b`` of near copies that connect what all pairs of near copies with a common bucket connect."""
    met = _met(_keyed(classes))
    nodes = checkpointed(met.select("a").union(met.select("b")).toDF("node").distinct())
    meeting = checkpointed(classes.join(nodes, "node"))
    sets = _sets(rows.join(meeting.select("node", "who"), "who").dropDuplicates(["who"]), words)
    alike = met.where("alike").select("a", "b")
    links = _confirmed(alike.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets)  # one pair for each text first
    roots = connected_components(links, "a", "b")
    ends = [roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
    rest = alike.join(ends[0], "a", "left").join(ends[1], "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    links = checkpointed(links.union(_confirmed(rest, sets)))

    live = _apart(_keyed(_rooted(meeting.select("node", "n", "fp", "keys"), links), "root"))
    live = live.join(_rarest(live.select("node").distinct().join(sets, "node")), "node")
    live = checkpointed(live.join(meeting.select("node", "bits"), "node"))
    ordinary = live.groupBy("key").agg(F.min(F.struct("own", "node", "n", "root", "bits")).alias("o"))
    beside = _with_bucket(live, ordinary).where("root <> o.root").where(_may_be_near("", "o."))
    pairs = beside.where(_alike_in_size(F.col("n"), F.col("o.n"))).select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b")).distinct()
    links = checkpointed(links.union(_confirmed(pairs, sets)))

    live = _apart(_rooted(live, links))
    x, y = live.alias("x"), live.alias("y")
    rest = x.join(
        y,
        (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
        & _alike_in_size(F.col("x.n"), F.col("y.n")) & _share_a_rarest() & _may_be_near("x.", "y."),
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    return links.union(_confirmed(rest, sets))


def without_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5) -> DataFrame:
    """``docs`` less near copies: of each component one row stays, that with the smallest id (a null id comes last)."""
    who = F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("mark")).alias("who")
    rows = docs.select(who, F.col(text).alias("text"))
    classes = _classes(rows, words)
    roots = connected_components(_links(classes, rows, words), "a", "b")
    rooted = classes.select("node", "who").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "who")
    kept = checkpointed(rooted.groupBy("root").agg(F.min(F.struct(F.col("who.id").isNull(), "who")).alias("first")).select("first.who"))
    return docs.select(F.struct(*docs.columns).alias("row"), who).join(kept, "who", "left_semi").dropDuplicates(["who"]).select("row.*")
