"""From page lines to markdown, and from markdown to chunks, with windows within a document and one fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.config import Settings
from quarry.functions import text as T

DEFAULT = Settings()


def body_font(lines: DataFrame) -> DataFrame:
    """``doc_id`` and ``body_size``: the size with the most characters, of equal ones the smallest."""
    sizes = lines.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("chars"))
    return sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("chars", -F.col("size"))).alias("body_size"))


def repeated_lines(lines: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """``doc_id``, ``text``, ``n``: short lines on at least a share of a document's pages; a text in two sizes counts twice."""
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    short = lines.where((F.length("text") > 0) & (F.length("text") <= s.repeated_max_len))
    counted = short.groupBy("doc_id", "text").agg(F.countDistinct("page", "size").alias("n")).join(pages, "doc_id")
    least = F.greatest(F.lit(s.repeated_floor), F.floor(F.col("pages") * s.repeated_ratio))
    return counted.where(F.col("n") >= least).select("doc_id", "text", "n")


def markdown(lines: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """``doc_id`` and ``md`` from ``doc_id``, ``page``, ``line_no``, ``text``, ``size``: headings by size, paragraphs from lines."""
    lines = lines.withColumn("text", T.clean(F.col("text")))
    kept = lines.where(~T.is_noise(F.col("text"))).join(repeated_lines(lines, s), ["doc_id", "text"], "left_anti").join(body_font(lines), "doc_id")
    short = F.length("text") <= s.heading_max_len
    level = F.when(short & (F.col("size") >= F.col("body_size") + s.h2_delta), 2).when(short & (F.col("size") >= F.col("body_size") + s.h3_delta), 3)
    marked = (F.col("level").isNull()) & F.col("text").rlike(T.LEADING_MARK)
    kept = kept.withColumn("level", level).withColumn("marked", marked)
    kept = kept.withColumn("text", F.when(F.col("marked"), F.regexp_replace("text", T.LEADING_MARK, "")).otherwise(F.col("text")))
    kept = kept.withColumn("ends", F.col("level").isNotNull() | F.col("text").rlike(T.SENTENCE_END))
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    breaks = F.col("level").isNotNull() | F.col("marked") | F.coalesce(F.lag("ends").over(order), F.lit(True))
    kept = kept.withColumn("block", F.sum(breaks.cast("int")).over(order))
    blocks = kept.groupBy("doc_id", "block").agg(
        F.max("level").alias("level"), F.array_sort(F.collect_list(F.struct("page", "line_no", "text"))).alias("parts")
    )
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
    head = F.when(F.col("level") == 2, "## ").when(F.col("level") == 3, "### ").otherwise("")
    blocks = blocks.select("doc_id", "block", F.concat(head, joined).alias("text")).where(T.strip(F.col("text")) != "")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda b: b["text"]), "\n\n")
    return blocks.groupBy("doc_id").agg(F.regexp_replace(whole, r"\n{3,}", "\n\n").alias("md"))


def sections(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``section``, ``title``, ``body`` from ``doc_id``, ``md``; blank bodies vanish, a new H2 clears the H3."""
    lines = docs.select("doc_id", F.posexplode(F.split("md", "\n")).alias("n", "line"))
    heading = r"^(#{2,3})\s+(.*)$"
    lines = lines.withColumn("level", F.length(F.regexp_extract("line", heading, 1)))
    name = F.when(F.col("level") > 0, T.strip(F.regexp_extract("line", heading, 2)))
    order = Window.partitionBy("doc_id").orderBy("n")
    lines = lines.withColumns(
        {
            "name": name,
            "section": F.sum((F.col("level") > 0).cast("int")).over(order),
            "part": F.sum((F.col("level") == 2).cast("int")).over(order),
        }
    )
    in_part = Window.partitionBy("doc_id", "part").orderBy("n")
    lines = lines.withColumns(
        {
            "h2": F.last(F.when(F.col("level") == 2, F.col("name")), ignorenulls=True).over(order),
            "h3": F.last(F.when(F.col("level") == 3, F.col("name")), ignorenulls=True).over(in_part),
        }
    )
    titled = lambda c: F.when(F.col(c) != "", F.col(c))
    lines = lines.withColumn("title", F.concat_ws(" > ", titled("h2"), titled("h3")))
    texts = F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("n", "line"))))
    body = T.strip(F.array_join(F.transform(texts, lambda x: x["line"]), "\n"))
    found = lines.groupBy("doc_id", "section").agg(F.first("title").alias("title"), body.alias("body"))
    return found.where("body <> ''")


def pieces(body: Column, longest: int) -> Column:
    """Paragraphs, those longer than ``longest`` as sentences."""
    paragraphs = F.filter(F.transform(F.split(body, r"\n{2,}"), T.strip), lambda p: p != "")
    cut = F.transform(paragraphs, lambda p: F.when(F.length(p) > longest, F.split(p, r"(?<=[.!?…])\s+")).otherwise(F.array(p)))
    return F.filter(F.flatten(cut), lambda p: p != "")


def split_long(body: Column, s: Settings = DEFAULT) -> Column:
    """An array of texts: pieces are added up to the target, each text begins with the last characters of the one before."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, piece: Column) -> Column:
        full = (state["open"] != "") & (F.length(state["open"]) + F.length(piece) + 1 > s.chunk_target)
        tail = F.when(F.length(state["open"]) > s.chunk_overlap, F.substring(state["open"], -s.chunk_overlap, s.chunk_overlap)).otherwise(state["open"])
        before = F.when(full, tail).otherwise(state["open"])
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"),
            T.strip(F.concat(before, F.lit(" "), piece)).alias("open"),
        )

    def finish(state: Column) -> Column:
        return F.when(state["open"] != "", F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])

    return F.aggregate(pieces(body, s.chunk_max), start, add, finish)


def merged(parts: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Chunks from ``doc_id``, ``title``, ``body`` and the order ``seq``: short ones join the one before if the title is the same."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    begins = ~((F.length("body") < s.min_chunk) & F.coalesce(F.col("title") == F.lag("title").over(order), F.lit(False)))
    islands = parts.withColumn("island", F.sum(begins.cast("int")).over(order))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "body"))), lambda x: x["body"])
    joined = islands.groupBy("doc_id", "island").agg(F.first("title").alias("title"), F.array_join(texts, " ").alias("body"))
    numbered = joined.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("island")) - 1)
    name = F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.format_string("%04d", "seq"))
    return numbered.select("doc_id", name.alias("chunk_id"), "seq", "title", "body")


def chunks(docs: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """``doc_id``, ``chunk_id``, ``seq``, ``title``, ``body`` from ``doc_id``, ``md``."""
    cut = sections(docs).select("doc_id", "section", "title", F.posexplode(split_long(F.col("body"), s)).alias("n", "body"))
    long = cut.where(F.length("body") >= s.drop_shorter_than)
    return merged(long.select("doc_id", F.struct("section", "n").alias("seq"), "title", "body"), s)


def with_toc(found: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds ``is_toc``, 0 or 1."""
    flag = T.is_toc(F.col("seq"), F.col("title"), F.col("body"), s.front_seq, s.toc_line_ratio)
    return found.withColumn("is_toc", flag.cast("int"))
