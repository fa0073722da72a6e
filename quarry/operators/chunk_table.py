"""Whole documents to numbered chunks by one table function: each document is one pass from its first line to its last.

The column functions of ``chunking`` do the same with windows and a fold; here the state of a document is a few
variables, so that a document of any length takes linear time, and rows leave as Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import Settings

DEFAULT = Settings()
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_HEADING = re.compile(r"(#{2,3})[ \t\x0b\x0c\r]+(.*)", re.DOTALL)
_GAP = re.compile(r"\n{2,}")
_SENTENCE = re.compile(r"(?<=[.!?…])[ \t\n\x0b\x0c\r]+")


def _sections(md: str) -> Iterator[tuple[str, str]]:
    """Titles (``part > subpart``) with what stands below them, blank bodies left out."""
    names, below = ["", ""], []
    for line in [*md.split("\n"), None]:
        heading = _HEADING.fullmatch(line) if line is not None else None
        if heading or line is None:
            if body := "\n".join(below).strip(_BLANKS):
                yield " > ".join(filter(None, names)), body
            below = []
            if heading:
                depth = len(heading[1]) - 2
                names[depth:] = [heading[2].strip(_BLANKS), ""][: 2 - depth]
        else:
            below.append(line)


def _filled(body: str, s: Settings) -> Iterator[str]:
    """Texts of a body's pieces, each up to the target; every text after the first begins with the end of the one before."""
    paragraphs = filter(None, (p.strip(_BLANKS) for p in _GAP.split(body)))
    text = ""
    for paragraph in paragraphs:
        for piece in _SENTENCE.split(paragraph) if len(paragraph) > s.chunk_max else (paragraph,):
            if not piece:
                continue
            if text and len(text) + 1 + len(piece) > s.chunk_target:
                yield text
                text = text[max(0, len(text) - s.chunk_overlap) :]
            text = f"{text} {piece}".strip(_BLANKS)  # never longer than a target and a piece
    if text:
        yield text


def document_chunks(md: str | None, s: Settings = DEFAULT) -> Iterator[tuple[int, str, str]]:
    """Number, title and body of each chunk: too short texts dropped, then short ones joined to the one before under the same title."""
    seq, title, held = 0, "", []
    for name, body in _sections(md or ""):
        for text in _filled(body, s):
            if len(text) < s.drop_shorter_than:
                continue
            if held and name == title and len(text) < s.min_chunk:
                held.append(text)
                continue
            if held:
                yield seq, title, " ".join(held)
                seq += 1
            title, held = name, [text]
    if held:
        yield seq, title, " ".join(held)


def _function(s: Settings):
    @F.udtf(returnType="seq int, title string, body string", useArrow=True)
    class ChunkDocument:
        def eval(self, md: str) -> Iterator[tuple[int, str, str]]:
            yield from document_chunks(md, s)

    return ChunkDocument


def chunk_table(docs: DataFrame, s: Settings = DEFAULT, name: str = "chunk_document") -> DataFrame:
    """``doc_id``, ``chunk_id``, ``seq``, ``title``, ``body`` from ``doc_id``, ``md``, by the table function ``name``, which SQL may use as well.

    Null and blank documents have no chunks; documents of the same id are numbered each for itself.
    """
    spark = docs.sparkSession
    spark.udtf.register(name, _function(s))
    rows = spark.sql(f"SELECT d.doc_id, c.* FROM {{docs}} d, LATERAL {name}(d.md) c", docs=docs.select("doc_id", "md"))
    number = F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.format_string("%04d", "seq"))
    return rows.select("doc_id", number.alias("chunk_id"), "seq", "title", "body")
