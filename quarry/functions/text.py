"""Column functions on text: tokens, cleaning, headings, sentences, citations, n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN = r"[\p{L}\p{N}]+"

# What cleaning replaces (bullets by a dash, no-break space, zero-width space).
REPLACED = (("", "- "), ("", "- "), ("", "- "), ("•", "- "), ("∙", "- "), (" ", " "), ("​", ""))
# Lines that are page furniture; a publisher's running heads are a further parameter.
FURNITURE = (r"^\s*\d{1,3}\s*$", r"^\s*Ⅰ?\s*20\d\d년\s*\d{1,2}월호\s*Ⅰ?\s*$", r"(?i)^\s*CONTENTS\s*$", r"^\s*[･·∙\-–—|]\s*$")
# Marks that begin a paragraph; ends of sentences; marks around words.
LEADING_MARK = r"^\s*(n|£|◇|□|■)\s+"
SENTENCE_END = r"(?:[.!?…]|다\.|음\.|함\.|임\.|[」』”)])\s*$"
WORD_MARKS = "()[]{}<>‘’“”\"'·,.…:;/|~!?"


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def nfc(text: Column) -> Column:
    """Unicode normal form C, which no built-in function gives."""

    @F.pandas_udf(StringType())
    def normal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return normal(text)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order, repeats kept; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _marks() -> tuple[str, str]:
    """Lower-case Latin, Greek and Cyrillic letters with marks, and the letters that are left without them; from Unicode's decompositions."""
    pairs = []
    for letter in map(chr, [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]):
        first, *marks = unicodedata.normalize("NFD", letter)
        if marks and all(unicodedata.combining(m) for m in marks) and letter == letter.lower():
            pairs.append((letter, first))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def unmarked(text: Column) -> Column:
    """Lower case without diacritics, composed or combining: ``Éclair`` as ``eclair``; stays inside the JVM."""
    return F.regexp_replace(F.translate(F.lower(text), *_marks()), r"\p{M}+", "")


def folded_tokens(text: Column) -> Column:
    """``tokens`` without diacritics."""
    return tokens(unmarked(text))


def tokens_with_words(words: Sequence[str], before: Callable[[Column], Column] = F.lower) -> Callable[[Column], Column]:
    """An analyser that keeps each of ``words``, which may hold blanks and marks, as one token where it stands alone; the longest wins.

    ``before`` prepares words and texts alike. The words go into one pattern: for lists of a user's size, not for vocabularies.
    """
    spark = SparkSession.active()
    prepared = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(before(F.col("w"))).collect()] if words else []
    listed = sorted({w for w in prepared if w.strip()}, key=lambda w: (-len(w), w))
    alone = r"(?<![\p{L}\p{N}])(?:" + "|".join(r"\Q" + w.replace(r"\E", r"\E\\E\Q") + r"\E" for w in listed) + r")(?![\p{L}\p{N}])|" if listed else ""
    return lambda text: F.regexp_extract_all(before(F.coalesce(text, F.lit(""))), F.lit(alone + TOKEN), F.lit(0))


#: Takes a text, gives its tokens.
Tokenizer = Callable[[str], Sequence[str]]


def tokens_by(load: Callable[[], Tokenizer]) -> Callable[[Column], Column]:
    """An analyser around a tokenizer of one's own, such as a morphological one; ``load`` is called once in each task. Texts come in NFC."""

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = None
        for batch in batches:
            tokenizer = tokenizer or load()
            yield pd.Series([[str(t) for t in tokenizer(unicodedata.normalize("NFC", x))] if x else [] for x in batch], index=batch.index, dtype=object)

    return found


def fts_query(text: Column, op: str = "OR") -> Column:
    """Quoted tokens joined by ``op``; null if there are none."""
    quoted = F.transform(tokens(text), lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.when(F.size(quoted) > 0, F.array_join(quoted, f" {op} "))


def ts_query(text: Column, op: str = "|") -> Column:
    """Tokens quoted by apostrophes, a dot inside a number kept, joined by ``op``; empty if there are none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{N}+(?:\.\p{N}+)+|" + TOKEN), F.lit(0))
    return F.array_join(F.transform(words, lambda t: F.concat(F.lit("'"), t, F.lit("'"))), f" {op} ")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often a lambda inside ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


class Remembered(dict):
    """What a function gives, by argument; everything is forgotten where it would be more than ``most``."""

    def __init__(self, make: Callable, most: int = 1 << 17) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: object) -> object:
        if len(self) >= self.most:
            self.clear()
        found = self[key] = self.make(key)
        return found


def listed(values: Iterable[str]) -> str:
    """Strings as a list of SQL literals: one expression where thousands would be made and sent one by one."""
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) or "null"


def grams(text: Column, n: int) -> Column:
    """All substrings of ``n`` characters, in order; none if the text is null or shorter."""
    whole = F.coalesce(text, F.lit(""))

    def windows(chars: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(chars) - n + 1)
        every = F.transform(at, lambda i: F.array_join(F.slice(chars, i, F.lit(n)), ""))
        return F.when(F.size(chars) >= n, every).otherwise(F.array().cast("array<string>"))

    # a pattern that looks ahead at each place is quick, but would part characters of two code units
    wide = whole.rlike(r"[\x{10000}-\x{10FFFF}]")
    return F.when(wide, let(F.filter(F.split(whole, ""), lambda c: c != ""), windows)).otherwise(F.regexp_extract_all(whole, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def occurrences(text: Column, word: Column) -> Column:
    """How often ``word`` occurs, overlapping occurrences included: an empty match at each place it starts."""
    quoted = F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    return F.when(F.length(word) > 0, F.regexp_count(text, F.concat(F.lit(r"(?=\Q"), quoted, F.lit(r"\E)")))).otherwise(0)


def search_words(query: Column, least: int) -> Column:
    """Words of at least ``least`` characters; failing these the whole query if that long; else none."""
    whole = strip(query)
    words = F.filter(F.split(whole, r"(?U)\s+"), lambda w: F.length(w) >= least)
    alone = F.when(F.length(whole) >= least, F.array(whole)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(words) > 0, words).otherwise(alone)


def clean(text: Column) -> Column:
    for old, new in REPLACED:
        text = F.replace(text, F.lit(old), F.lit(new))
    return strip(F.regexp_replace(text, r"[ \t]+", " "))


def is_noise(line: Column, furniture: tuple[str, ...] = FURNITURE) -> Column:
    """Page furniture, or at most two characters (none, too) without two letters side by side."""
    noise = (F.length(line) <= 2) & ~line.rlike("[가-힣A-Za-z]{2}")
    for pattern in furniture:
        noise = noise | line.rlike(pattern)
    return noise


def sentences(text: Column) -> Column:
    return F.split(strip(text), r"(?<=[.!?])\s+")


def citations(text: Column) -> Column:
    """Cited ids: letters, digits and underscores, ``#`` and exactly four digits, in brackets."""
    return F.regexp_extract_all(text, F.lit(r"\[([A-Za-z0-9_]+#\d{4})\]"), F.lit(1))


def year_month(stem: Column) -> Column:
    """``YYYY-MM`` from six digits at the end of a file stem, else empty."""
    found = F.regexp_extract(stem, r"(\d{4})(\d{2})$", 0)
    return F.when(found != "", F.concat(F.substring(found, 1, 4), F.lit("-"), F.substring(found, 5, 2))).otherwise("")


def title_tail(title: Column) -> Column:
    return F.regexp_replace(title, r"^.*>\s*", "")


def is_toc(seq: Column, title: Column, body: Column, front: int = 8, ratio: float = 0.6) -> Column:
    """Whether a front chunk looks like a table of contents: page numbers end its title or most of its lines."""
    tail = strip(F.element_at(F.split(title, ">"), -1))
    lines = F.filter(F.split(body, "\n"), lambda x: strip(x) != "")
    numbered = F.filter(lines, lambda x: strip(x).rlike(r"\s\d{1,3}$"))
    most = F.when(F.size(lines) > 0, F.size(numbered) / F.size(lines) >= ratio).otherwise(False)
    return F.coalesce((seq < front) & (tail.rlike(r"\s\d{1,3}$") | most), F.lit(False))
