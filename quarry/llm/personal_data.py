"""Personal data: exact base patterns, and further spans by weak supervision.

Base spans (email, ip, card, phone) come from fixed patterns and always stay. Wider patterns propose further
spans; names are proposed after a title, after a word such as `name:`, and where capitalised words begin with a first name of
the gazetteer. Six labelers, none of which reads what another reads, vote on each: the value's format, a harmless format
(words, paths, dates, uuids), a gazetteer (names, issuers, known prefixes and placeholders), harmless words before it,
telling words before it, and its mix of characters. That a value is hexadecimal is no vote, as a digest and a
key look alike. Expectation-maximisation over the counts of vote patterns, which Spark gathers from every
document, estimates each labeler's reliability by kind and each span's probability. With these probabilities as soft
labels a logistic classifier over a span's votes and shape is trained, and adds the spans it gives at least one half. So that
it judges votes that no document shows, every possible pattern of votes is among its examples with a small weight, in the
mean shape of what was seen: a corpus in which all proposals are secrets then can't teach that the shape alone tells. For the
same reason the share of private spans is held between bounds (``SHARES``).

What reaches the driver are counts by kind, votes and shape, whose number is fixed by the buckets below.

Defined results: a null text counts as empty; an empty text has no spans; null and repeated ids are kept as they
stand; an empty table gives an empty result and a model that goes by the labelers' assumed reliability;
positions are code points, ends exclusive; of proposed spans that overlap the first, then the kind named first, then the
longest stays; further columns are kept by ``redacted`` and not read otherwise.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Span = tuple[int, int, str]  # start, end, kind
BASE = ("email", "ip", "card", "phone")
ADDED = ("name", "national_id", "bank_account", "secret")
ORDER = {kind: i for i, kind in enumerate(BASE + ADDED)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# What the wider patterns, gazetteers and context labelers look for.
_TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
FIRST_NAMES = frozenset(
    """adam alex alice alicia amelie amy ana andrea andrew angela anna anne antonio barbara ben bernd birgit brian camille carla carlos carmen
    caroline catherine charles charlotte chloe christian christine claire claudia daniel david diego dieter elena eliot elizabeth ella emily
    emma eric eva felix fernando francisco frank gabriel george gerhard hannah hans heike helen henry hugo ines irene isabel jack jacques
    james jan jane javier jean jennifer joan john jonas jorge jose joseph juan jules julia julie jürgen karin karl kate katharina kevin klaus
    laura lea lena leon linda lisa louis lucas lucia luis lukas manuel marc marco maria marie mark marta martin mary matthew max michael miguel
    monika nancy nathalie nicolas nina olivia oscar pablo paul pedro peter philippe pierre rafael raquel rebecca richard robert rosa ruth sabine
    sandra sarah sebastian sergio silvia simon sofia sophie stefan stephen susan sylvie teresa thomas tim ursula valentina victor walter werner
    william wolfgang yves zoe""".split()
)
#: Countries with international account numbers, and their lengths.
_ISSUERS = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}
_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "eyJ")
_PLACEHOLDERS = ("example", "sample", "placeholder", "changeme", "redacted", "xxxx", "0000", "123456", "your_", "your-", "dummy", "lorem")
_VOID_IDS = frozenset(("078-05-1120", "219-09-9999", "123-45-6789", "111-11-1111"))
_KEY_WORDS = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "access_key", "private_key", "bearer", "passwort", "contraseña")
_HARMLESS = frozenset(
    """sha sha1 sha256 md5 crc checksum digest hash fingerprint commit revision isbn issn doi version uuid guid build http https order invoice
    part serial sku ticket model reference ref item case""".split()
)
_NEAR = {
    "name": frozenset(("contact", "name", "signed", "author", "by", "kontakt", "nombre", "nom", "patient", "dear", *map(str.lower, _TITLES))),
    "national_id": frozenset(("ssn", "social", "security", "id", "tax")),
    "bank_account": frozenset(("iban", "account", "konto", "bank", "cuenta", "compte")),
}
_KEY = re.compile(r"(?<![a-z])(?:" + "|".join(_KEY_WORDS) + ")")
_WIDE = {
    "name": re.compile(r"\b(?:" + "|".join(_TITLES) + r")\b\.? ([A-ZÀ-Þ][\w'-]+(?: [A-ZÀ-Þ][\w'-]+){0,2})"),
    "national_id": re.compile(r"(?<![\w-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])"),
    "bank_account": re.compile(r"\b([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b"),
    "secret": re.compile(r"(?<![\w+/=-])([A-Za-z0-9_+/-]{12,})(?![\w+/-])"),
}
_ASSIGNED = re.compile(r"(?i)(?:" + "|".join(_KEY_WORDS) + r")\w{0,10}\s{0,3}[=:]\s{0,3}[\"']?([^\s\"',;]{6,})")
_CAPITALISED = re.compile(r"(?<![\w'-])[A-ZÀ-Þ][\w'-]+(?: [A-ZÀ-Þ][\w'-]+)+")
_NAMED = re.compile(r"(?i:\b(?:name|nombre|nom|kontakt|contact|patient|author)\b) ?[:=] ?([A-ZÀ-Þ][\w'-]+(?: [A-ZÀ-Þ][\w'-]+){1,2})")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_SEPARATOR = re.compile(r"[/_+-]+")
#: A word, a date or number, or a letter with a number, as between the separators of a path.
_PIECE = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]+|[A-Za-z]?[0-9]{1,8}")
_NATIONAL = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}")
#: Code points before a span that the context labelers read.
_BEFORE = 32


def _luhn(digits: list[int]) -> bool:
    doubled = (2 * d - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits)))
    return sum(doubled) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Every match holds one @, so matches are found from it: the name reaches back, the domain forward."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end(), "email"
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _addresses(text: str) -> Iterator[Span]:
    """Each four parts of a run of dotted numbers; a run is read once, however long."""
    for run in _DOTTED.finditer(text):
        if text.count(".", run.start(), run.end()) >= 3:
            parts = list(_PART.finditer(text, run.start(), run.end()))
            for four in (parts[i : i + 4] for i in range(0, len(parts) - 3, 4)):
                if all(len(part := p[0].lstrip("0")) <= 3 and int(part or "0") <= 255 for p in four):
                    yield four[0].start(), four[-1].end(), "ip"


def base_spans(text: str) -> list[Span]:
    spans = list(_emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return spans
    spans += _addresses(text)
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = [int(c) for c in m[0] if c.isdigit()] if m.end() - m.start() <= 37 else []
            if 12 <= len(digits) <= 19 and _luhn(digits):
                spans.append((m.start(), m.end(), "card"))
    if "+" in text:
        spans += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(spans, key=lambda s: (s[0], ORDER[s[2]]))


def _iban(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _known_names(text: str, names: frozenset[str]) -> Iterator[Span]:
    """Of each run of capitalised words: a first name of the gazetteer with the one or two words after it."""
    for run in _CAPITALISED.finditer(text):
        start, words = run.start(), run[0].split(" ")
        i = 0
        while i < len(words):
            some = words[i : i + 3] if words[i].lower() in names else words[i : i + 1]
            long = sum(map(len, some)) + len(some) - 1
            if len(some) > 1:
                yield start, start + long, "name"
            start, i = start + long + 1, i + len(some)


def wide_spans(text: str, base: list[Span], names: frozenset[str] = FIRST_NAMES) -> list[Span]:
    """Proposed spans that touch no base span and not each other; the kinds' order decides between them."""
    found: list[Span] = list(_known_names(text, names))
    digits = bool(_DIGIT.search(text))
    for kind, pattern in _WIDE.items():
        if kind == "name" or digits:
            found += [(m.start(1), m.end(1), kind) for m in pattern.finditer(text) if kind != "secret" or _DIGIT.search(m[1]) and not m[1].isdigit()]
    if "=" in text or ":" in text:
        found += [(m.start(1), m.end(1), "name") for m in _NAMED.finditer(text)]
        found += [(m.start(1), m.end(1), "secret") for m in _ASSIGNED.finditer(text)]
    if not found:
        return []
    taken = sorted((s, e) for s, e, _ in base)
    free: list[Span] = []
    at = 0
    for span in sorted(set(found), key=lambda s: (s[0], ORDER[s[2]], -s[1])):
        while at < len(taken) and taken[at][1] <= span[0]:
            at += 1
        if (at == len(taken) or taken[at][0] >= span[1]) and (not free or free[-1][1] <= span[0]):
            free.append(span)
    return free


def _form(kind: str, value: str) -> int:
    if kind == "bank_account":
        return 1 if _iban(value) else -1
    if kind == "national_id":
        return 1 if _NATIONAL.fullmatch(value) else -1
    return 0


def _plain(kind: str, value: str) -> bool:
    """A single word, a uuid, or at least three words, numbers and dates between separators, as in a path."""
    if kind == "name":
        return False
    if value.isalpha() or _UUID.fullmatch(value):
        return True
    pieces = _SEPARATOR.split(value) if kind == "secret" else ()
    return len(pieces) >= 3 and all(map(_PIECE.fullmatch, pieces))


def _listed(kind: str, value: str, names: frozenset[str]) -> int:
    if kind == "name":
        return 1 if any(w in names for w in value.lower().split()) else 0
    if kind == "national_id":
        return -1 if value in _VOID_IDS else 0
    if kind == "bank_account":
        return 1 if _ISSUERS.get(value[:2]) == len(value.replace(" ", "")) else -1
    return 1 if value.startswith(_PREFIXES) else -1 if any(w in value.lower() for w in _PLACEHOLDERS) else 0


def votes(text: str, span: Span, names: frozenset[str] = FIRST_NAMES) -> tuple[int, ...]:
    """1 for private, -1 for not, 0 for no opinion: format, harmless format, gazetteer, harmless words, telling words, mix."""
    start, end, kind = span
    value, before = text[start:end], text[max(0, start - _BEFORE) : start].lower()
    if start > _BEFORE:
        before = re.sub(r"^\w+", "", before)  # the rest of a word that begins further ahead
    words = set(re.findall(r"[^\W_]+", before))
    plain = -1 if _plain(kind, value) or before.endswith(("://", "www.")) else 0
    harmless = -1 if words & _HARMLESS else 0
    near = 1 if (_KEY.search(before) if kind == "secret" else words & _NEAR[kind]) else 0
    mixed = 1 if kind == "secret" and sum(c.isdigit() for c in value) >= 2 and len(set(value)) >= 8 else 0
    return _form(kind, value), plain, _listed(kind, value, names), harmless, near, mixed


#: The votes that each labeler may cast, and all patterns of them.
_CAST = ((-1, 0, 1), (-1, 0), (-1, 0, 1), (-1, 0), (0, 1), (0, 1))
_PATTERNS = tuple(product(*_CAST))
_LABELERS = len(_CAST)


def shape(text: str, span: Span) -> tuple[int, ...]:
    """Buckets of length, share of digits, of capitals, of other signs, and of distinct characters."""
    value = text[span[0] : span[1]]
    n = len(value)
    shares = (sum(map(str.isdigit, value)), sum(map(str.isupper, value)), n - sum(map(str.isalnum, value)), len(set(value)))
    return (min(4, n // 10), *(min(3, 4 * s // n) for s in shares))


_SIZES = (5, 4, 4, 4, 4)
_OF_KIND = 1 + 3 * _LABELERS


def _features(kind: str, ballot: tuple[int, ...], buckets: tuple[int, ...] = ()) -> np.ndarray:
    """A constant and the votes, by kind, then the shape's buckets (none for a pattern of votes by itself)."""
    x = np.zeros(_OF_KIND * len(ADDED) + sum(_SIZES))
    at = _OF_KIND * ADDED.index(kind)
    x[at] = 1
    for i, vote in enumerate(ballot):
        x[at + 1 + 3 * i + vote + 1] = 1
    at = _OF_KIND * len(ADDED)
    for b, size in zip(buckets, _SIZES, strict=False):
        x[at + b] = 1
        at += size
    return x


@dataclass
class SpanModel:
    """Reliabilities P(vote | class), by kind, labeler, class and vote + 1; priors by kind; the classifier's weights; the names it knows."""

    reliability: np.ndarray
    prior: dict[str, float]
    weights: np.ndarray
    names: frozenset[str] = FIRST_NAMES
    _known: dict[tuple, float] = field(default_factory=dict, repr=False, compare=False)  # as many as there are buckets, at most

    def probability(self, kind: str, ballot: tuple[int, ...], buckets: tuple[int, ...]) -> float:
        cell = (kind, ballot, buckets)
        if cell not in self._known:
            self._known[cell] = 1 / (1 + math.exp(-float(np.clip(self.weights @ _features(*cell), -30, 30))))
        return self._known[cell]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        return [s for s in wide_spans(text, base, self.names) if self.probability(s[2], votes(text, s, self.names), shape(text, s)) >= 0.5]

    def spans(self, text: str) -> list[Span]:
        base = base_spans(text)
        return sorted(base + self.added(text, base), key=lambda s: (s[0], ORDER[s[2]]))


def _assumed() -> np.ndarray:
    """P(-1, 0, 1) by kind, labeler and class (not private, private), before anything is seen."""
    by_labeler = [
        ((0.3, 0.6, 0.1), (0.05, 0.55, 0.4)), ((0.3, 0.69, 0.01), (0.02, 0.97, 0.01)), ((0.3, 0.6, 0.1), (0.05, 0.55, 0.4)),
        ((0.3, 0.69, 0.01), (0.01, 0.98, 0.01)), ((0.01, 0.89, 0.1), (0.01, 0.49, 0.5)), ((0.01, 0.69, 0.3), (0.01, 0.29, 0.7)),
    ]
    shares = np.tile(by_labeler, (len(ADDED), 1, 1, 1))
    for kind in ("national_id", "bank_account"):  # rules that a true number can't break
        shares[ADDED.index(kind), 0] = ((0.5, 0.3, 0.2), (0.01, 0.2, 0.79))
    silent = [(ADDED.index("name"), 0), (ADDED.index("secret"), 0), *((k, 5) for k, kind in enumerate(ADDED) if kind != "secret")]  # no such labeler for the kind
    for k, i in silent:
        shares[k, i] = (0.01, 0.98, 0.01)
    return shares


#: The labelers' reliability at the start, which counts as if seen on so many spans of each class.
ASSUMED, AS_MANY = _assumed(), 20
#: Bounds on the share of private spans of a kind, whose pull would otherwise outweigh all labelers in a one-sided corpus.
SHARES = (0.1, 0.9)
#: Pull of the classifier's weights to zero: of constants and votes, and of shapes.
RIDGE = (0.01, 1.0)
#: Weight of each pattern of votes among the classifier's examples, and of all seen spans of a kind, at most.
PATTERN_WEIGHT, SEEN_WEIGHT = 0.5, 1000.0


def _posterior(reliability: np.ndarray, share: np.ndarray, kinds: np.ndarray, ballots: np.ndarray) -> np.ndarray:
    """P(private) for each row of a kind's number and ballots + 1."""
    logs = np.log(reliability)[kinds, np.arange(_LABELERS)[:, None], :, ballots.T].sum(axis=0)
    odds = logs[:, 1] - logs[:, 0] + np.log(share[kinds] / (1 - share[kinds]))
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def maximise(kinds: np.ndarray, ballots: np.ndarray, count: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Reliabilities and shares by kind from counts of vote patterns (ballots are votes + 1), by expectation-maximisation."""
    reliability = ASSUMED.copy()
    share = np.full(len(ADDED), 0.5)
    for _ in range(rounds if len(kinds) else 0):
        private = _posterior(reliability, share, kinds, ballots)
        for k in range(len(ADDED)):
            of = kinds == k
            for y, p in enumerate((1 - private[of], private[of])):
                for i in range(_LABELERS):
                    seen = np.bincount(ballots[of, i], count[of] * p, 3) + AS_MANY * ASSUMED[k, i, y]
                    reliability[k, i, y] = seen / seen.sum()
        total = np.bincount(kinds, count, len(ADDED))
        share = (np.bincount(kinds, count * private, len(ADDED)) + 1) / (total + 2)
    return reliability, share


def estimate(cells: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], names: frozenset[str] = FIRST_NAMES) -> SpanModel:
    """A model from counts of (kind, votes, shape): expectation-maximisation, then the classifier on its labels."""
    kinds = np.array([ADDED.index(k) for k, *_ in cells], int)
    ballots = np.array([v for _, v, *_ in cells], int).reshape(-1, _LABELERS) + 1
    count = np.array([c[3] for c in cells], float)
    reliability, share = maximise(kinds, ballots, count)
    share = np.clip(share, *SHARES)

    every = [(k, v) for k in ADDED for v in _PATTERNS]
    x = np.array([_features(k, v, b) for k, v, b, _ in cells] + [_features(k, v) for k, v in every])
    for k in set(kinds.tolist()):  # patterns in the mean shape of their kind
        at = len(cells) + np.flatnonzero([ADDED.index(kind) == k for kind, _ in every])
        x[at, _OF_KIND * len(ADDED) :] = np.average(x[: len(cells), _OF_KIND * len(ADDED) :][kinds == k], axis=0, weights=count[kinds == k])
    kinds = np.append(kinds, [ADDED.index(k) for k, _ in every])
    private = _posterior(reliability, share, kinds, np.concatenate([ballots, np.array([v for _, v in every]) + 1]))
    of_kind = np.bincount(kinds[: len(cells)], count, len(ADDED))
    count = count * np.minimum(1, SEEN_WEIGHT / np.maximum(1, of_kind))[kinds[: len(cells)]]  # alike at every size of corpus
    count = np.append(count, np.full(len(every), PATTERN_WEIGHT))
    weights = np.zeros(x.shape[1])
    ridge = np.repeat(RIDGE, (_OF_KIND * len(ADDED), sum(_SIZES)))
    for _ in range(30):  # Newton steps of a logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (count * (private - p)) - ridge * weights
        curve = (x * (count * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        weights = weights + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return SpanModel(reliability, dict(zip(ADDED, share.tolist(), strict=True)), weights, names)


def learn(docs: DataFrame, text: str = "text", names: frozenset[str] = FIRST_NAMES) -> SpanModel:
    """A model from the counts of all documents; ``names`` is the gazetteer of first names, in lower case."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells: dict[tuple, int] = {}
        for batch in batches:
            for t in batch["text"]:
                for span in wide_spans(t, base_spans(t), names):
                    cell = (span[2], votes(t, span, names), shape(t, span))
                    cells[cell] = cells.get(cell, 0) + 1
        yield pd.DataFrame([(k, list(v), list(s), n) for (k, v, s), n in cells.items()], columns=["kind", "votes", "shape", "n"])

    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    counts = rows.mapInPandas(count, "kind string, votes array<int>, shape array<int>, n long").groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n"))
    return estimate(sorted((r.kind, tuple(r.votes), tuple(r["shape"]), r.n) for r in counts.collect()), names)


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def found(text: Column, model: SpanModel) -> Column:
    """A struct for a text column: the counts of base spans, ``base`` and ``spans`` as text."""

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base string, spans string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch:
                base = base_spans(t or "")
                every = sorted(base + model.added(t or "", base), key=lambda s: (s[0], ORDER[s[2]]))
                rows.append((*(sum(s[2] == k for s in base) for k in BASE), as_text(base), as_text(every)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    return find(text)


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    out, done = [], 0
    for start, end, kind in spans:
        if start >= done:
            out += [text[done:start], f"<{kind}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in ``text``; null stays null, other columns stay as they are."""

    @F.pandas_udf(StringType())
    def replace(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else redact(t, model.spans(t)) for t in batch], dtype=object)

    return docs.withColumn(text, replace(F.col(text)))
