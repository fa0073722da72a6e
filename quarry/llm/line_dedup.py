"""Removal of multi-line chunks that repeat across documents, in DataFrame functions alone.

A text is cut after a line where a hash over the last ``window`` line hashes falls in a fixed class, so that the
cuts follow the content: lines put in before a shared passage don't shift the cuts inside it. Chunks of two
lines or more are counted by hash over all documents. Before any is removed the bytes of all chunks of equal hash
are compared; where they differ, chunks are told apart by their text. Of equal chunks the first stays (by id,
then hash of the text, then position), all others go.

``shortened``, which has no SQL, makes whole chunks: a cut right after a cut is passed over, as are those after the first
line and before the last, so that every chunk has two lines at least and nothing of an exact copy stays; a text of
one line takes part if it has ``LONG_LINE`` words.

Texts are shuffled only to be compared, for documents with a repeated hash, and to be cut; chunks travel as
hashes. Frequent chunks meet in partial aggregates, and their first occurrence reaches the others by broadcast.

Defined results: a null text stays null and an empty one empty, with nothing removed; rows with equal id and
text are treated as one (all keep or all lose a chunk); null ids count as first; other columns are kept, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import checkpointed, joined_by_key

#: Line hashes under a cut's hash; last hex digits after which a text is cut: a chunk has about three lines.
WINDOW = 2
CUTS = "01234"
#: Words from which a text of one line counts as a chunk, in whole chunks.
LONG_LINE = 50


def _chunks(text: Column, window: int, whole: bool) -> Column:
    """The chunks of a text as an array of arrays of lines; if ``whole``, of two lines at least where there are two."""
    lines = F.split(text, "\n")
    hashed = F.transform(lines, lambda line: F.md5(line.cast("binary")))
    of = F.struct(lines.alias("lines"), hashed.alias("hashes"))

    def ends(s: Column) -> Column:
        n = F.size(s["lines"])

        def cut(i: Column) -> Column:
            rolled = F.md5(F.array_join(F.slice(s["hashes"], F.greatest(i - window + 1, F.lit(1)), F.least(i, F.lit(window))), "").cast("binary"))
            return F.substring(rolled, -1, 1).isin(*CUTS)

        places = F.sequence(F.lit(1), n)
        if not whole:
            return F.filter(places, lambda i: (i == n) | cut(i))
        signs = F.transform(places, lambda i: F.when((i > 1) & (i < n - 1) & cut(i), "c").otherwise("-"))
        apart = F.split(F.regexp_replace(F.array_join(signs, ""), "cc", "c-"), "")  # of cuts in a row each other one
        return F.transform(F.array(apart), lambda a: F.filter(places, lambda i: (i == n) | (F.get(a, i - 1) == "c")))[0]

    def cuts(s: Column) -> Column:
        at = F.array(F.struct(s["lines"].alias("lines"), ends(s).alias("ends")))
        return F.transform(at, lambda a: F.transform(a["ends"], lambda e, k: _lines(a, e, k)))[0]

    return F.transform(F.array(of), cuts)[0]


def _lines(a: Column, end: Column, k: Column) -> Column:
    begin = F.when(k == 0, F.lit(0)).otherwise(F.get(a["ends"], k - 1))
    return F.slice(a["lines"], begin + 1, end - begin)


def _joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def _dropped(rows: DataFrame, window: int, whole: bool) -> DataFrame:
    """Columns ``id``, ``mark`` and ``gone``: for each document that loses chunks, their numbers in order.

    ``rows`` has ``id``, ``text`` and ``mark`` (a hash of the text; with the id it names a row).
    """
    place = F.struct("id", "mark", "k")
    texts = rows.where("text is not null")
    every = texts.select("id", "mark", F.posexplode(_chunks(F.col("text"), window, whole)).alias("k", "lines"))
    taking = (F.size("lines") > 1) | (F.size(F.split(F.get("lines", F.lit(0)), r"\s+")) >= LONG_LINE) if whole else F.size("lines") > 1
    slim = checkpointed(every.where(taking).select("id", "mark", "k", F.xxhash64("lines").alias("hash")).distinct())
    groups = checkpointed(slim.groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"))
    again = checkpointed(joined_by_key(slim, groups, ["hash"], slim.count()).select("id", "mark", "k", "hash", (place == F.col("first")).alias("stays")))

    wanted = again.groupBy("id", "mark").agg(F.collect_list(F.struct("k", "hash")).alias("wanted"))  # a document's own
    t, w = texts.alias("t"), wanted.alias("w")
    compared = (
        t.join(w, F.col("t.id").eqNullSafe(F.col("w.id")) & (F.col("t.mark") == F.col("w.mark")))
        .select("t.id", "t.mark", "w.wanted", _chunks(F.col("t.text"), window, whole).alias("chunks"))
        .select("id", "mark", F.explode("wanted").alias("c"), "chunks")
        .select("id", "mark", "c.k", "c.hash", _joined(F.get("chunks", F.col("c.k"))).alias("text"))
    )
    differ = checkpointed(
        compared.groupBy("hash").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("hash")
    )  # equal hash, other bytes
    gone = again.where(~F.col("stays")).join(differ, "hash", "left_anti").select("id", "mark", "k")
    if not differ.isEmpty():
        apart = checkpointed(compared.join(differ, "hash", "left_semi"))
        first = apart.groupBy("hash", "text").agg(F.min(place).alias("first"))
        gone = gone.union(apart.join(first, ["hash", "text"]).where(place != F.col("first")).select("id", "mark", "k"))
    return gone.groupBy("id", "mark").agg(F.array_sort(F.collect_set("k")).alias("gone"))


_COUNTED = ("n_lines", "n_removed_lines", "n_removed_chunks")


def _cut(docs: DataFrame, text: str, key: str, window: int, whole: bool) -> DataFrame:
    """Each row of ``docs`` as ``row``, what is ``left`` of its text, and the counts."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    dropped = _dropped(rows.select("id", "text", "mark"), window, whole).alias("d")
    r = rows.alias("r")
    joined = r.join(dropped, F.col("r.id").eqNullSafe(F.col("d.id")) & (F.col("r.mark") == F.col("d.mark")), "left")
    chunks = F.when(F.col("gone").isNotNull(), _chunks(F.col("text"), window, whole))
    return joined.select("row", "text", "gone", chunks.alias("chunks")).select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text"))
        .otherwise(_joined(F.flatten(F.filter("chunks", lambda _, k: ~F.array_contains("gone", k)))))
        .alias("left"),
        F.coalesce(F.length("text") - F.length(F.translate("text", "\n", "")) + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.expr("aggregate(gone, 0L, (s, k) -> s + size(chunks[k]))"), F.lit(0)).cast("long").alias("n_removed_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed_chunks"),
    )


def _fields(docs: DataFrame, text: str) -> list[Column]:
    return [F.col("left").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns]


def without_repeated_chunks(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``text`` cut, and ``n_lines``, ``n_removed_lines`` and ``n_removed_chunks`` (long), which replace columns of these names."""
    counts = ("n_lines", "n_removed_lines", "n_removed_chunks")
    return _cut(docs, text, key, window, whole=False).select(*(f for f, c in zip(_fields(docs, text), docs.columns, strict=True) if c not in counts), *counts)


def shortened(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``text`` less its repeated whole chunks, less the rows of whose text nothing is left; the columns are those of ``docs``."""
    return _cut(docs, text, key, window, whole=True).where("left is null or left <> '' or n_removed_lines = 0").select(*_fields(docs, text))
