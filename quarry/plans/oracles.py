"""The catalogue's queries as SQL for an independent engine."""

from __future__ import annotations

import re
import unicodedata

from quarry.functions.text import FURNITURE, LEADING_MARK, REPLACED, SENTENCE_END, WORD_MARKS
from quarry.plans.tables import AND_QUERIES, PHRASE_QUERIES, QUERIES, USER_WORDS, WORD_QUERIES

P = r"'[\p{L}\p{N}]+'"


def asked(rows: list[tuple[int, str]]) -> str:
    return "q(query_id, query) AS (VALUES " + ", ".join(f"({i}::bigint, '{t}')" for i, t in rows) + ")"


Q = asked(QUERIES)
BENCH = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
CHUNKS = """chunks AS (SELECT doc_id AS chunk_id, split_part(text, chr(10), 1) AS title,
    CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS body, lang, source FROM documents)"""


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {P})"


def literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


POSTINGS = f"""toks AS (SELECT chunk_id, unnest({tokens("title")}) AS term, 1 AS t, 0 AS b FROM chunks
    UNION ALL SELECT chunk_id, unnest({tokens("body")}), 0, 1 FROM chunks),
postings AS (SELECT term, chunk_id, sum(t)::bigint AS tf_title, sum(b)::bigint AS tf_body FROM toks GROUP BY ALL),
lens AS (SELECT chunk_id, (len({tokens("title")}) + len({tokens("body")}))::bigint AS len FROM chunks),
stats AS (SELECT count(*) AS n, avg(len) AS avgdl FROM lens),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"""
TERMS = f"terms AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens('query')}) AS term FROM q) GROUP BY ALL)"


def idf(n: str = "n", df: str = "df") -> str:
    raw = f"ln(({n} - {df} + 0.5)::double / ({df} + 0.5)::double)"
    return f"CASE WHEN {raw} <= 0 THEN 1e-6::double ELSE {raw} END"


def bm25(tf: str, length: str) -> str:
    return f"({idf()}) * ({tf}) * 2.2::double / (({tf}) + 1.2::double * (0.25::double + 0.75::double * {length} / avgdl))"


def kw_scores(name: str = "kw_scores", title: float = 3.0) -> str:
    tf = f"({title}::double * tf_title + tf_body)"
    return f"""{name} AS (SELECT query_id, chunk_id, round(sum(times * {bm25(tf, "len")}), 9) AS score, count(*) AS matched
    FROM postings JOIN df USING (term) JOIN terms USING (term) JOIN lens USING (chunk_id), stats GROUP BY ALL)"""


def best(source: str, k: int, by: str = "query_id") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, chunk_id) AS rk FROM {source} QUALIFY rk <= {k}"


def shown(source: str, more: str = "") -> str:
    return f"SELECT query_id, {more} chunk_id, round(score, 6) AS score, rk FROM {source}"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


KW = (Q, CHUNKS, POSTINGS, TERMS, kw_scores())
DENSITY = """density AS (SELECT query_id, chunk_id, round((sum(tf_title) * 1.0::double + sum(tf_body) * 0.4::double) / (1 + ln(any_value(len)::double)), 9) AS score
    FROM postings JOIN terms USING (term) JOIN lens USING (chunk_id) GROUP BY ALL)"""
PLACED = f"""listed AS (SELECT chunk_id, {tokens("title")} AS tt, {tokens("body")} AS bt FROM chunks),
placed AS (SELECT chunk_id, len(tt) AS n_title, len(tt) + len(bt) AS size, unnest(tt) AS term, generate_subscripts(tt, 1) - 1 AS pos FROM listed
    UNION ALL SELECT chunk_id, len(tt), len(tt) + len(bt), unnest(bt), generate_subscripts(bt, 1) + len(tt) FROM listed)"""
COVERS = """occ AS (SELECT query_id, chunk_id, size, term, pos, CASE WHEN pos < n_title THEN 1.0::double ELSE 2.5::double END AS inverse FROM placed JOIN terms USING (term)),
lasts AS (SELECT r.query_id, r.chunk_id, r.size, r.pos, o.term, max(o.pos) AS last FROM occ r JOIN occ o ON r.query_id = o.query_id AND r.chunk_id = o.chunk_id AND o.pos <= r.pos GROUP BY ALL),
ends AS (SELECT query_id, chunk_id, size, pos, min(last) AS first, count(*) AS have FROM lasts GROUP BY ALL),
covers AS (SELECT e.* FROM ends e WHERE have = (SELECT count(*) FROM terms t WHERE t.query_id = e.query_id)
    QUALIFY first IS DISTINCT FROM lag(first) OVER (PARTITION BY query_id, chunk_id ORDER BY pos)),
weighed AS (SELECT c.query_id, c.chunk_id, c.size, c.pos, count(*) / sum(o.inverse) / (1 + (c.pos - c.first + 1 - count(*))) AS w
    FROM covers c JOIN occ o ON o.query_id = c.query_id AND o.chunk_id = c.chunk_id AND o.pos BETWEEN c.first AND c.pos GROUP BY c.query_id, c.chunk_id, c.size, c.pos, c.first),
cover_scores AS (SELECT query_id, chunk_id, round(sum(w) / (1 + ln(any_value(size)::double)), 9) AS score FROM weighed GROUP BY ALL)"""
PHRASES = rf"""phrases AS (SELECT query_id, phrase, count(*) AS times FROM (SELECT query_id, {tokens("part")} AS phrase
    FROM (SELECT query_id, unnest(regexp_extract_all(query, '"[^"]*"|[^\s"]+')) AS part FROM q)) WHERE len(phrase) > 0 GROUP BY ALL),
phrase_words AS (SELECT phrase, unnest(phrase) AS term, generate_subscripts(phrase, 1) - 1 AS nth FROM (SELECT DISTINCT phrase FROM phrases)),
starts AS (SELECT phrase, chunk_id, n_title, size, pos - nth AS start FROM phrase_words JOIN placed USING (term) GROUP BY ALL HAVING count(*) = len(phrase)),
tfs AS (SELECT phrase, chunk_id, size, count(*) FILTER (start < n_title) AS tf_title, count(*) FILTER (start > n_title) AS tf_body FROM starts GROUP BY ALL),
dfs AS (SELECT phrase, count(*) AS df FROM tfs GROUP BY phrase),
pstats AS (SELECT count(*) AS n, avg(len(tt) + len(bt)) AS avgdl FROM listed),
phrase_scores AS (SELECT query_id, chunk_id, round(sum(times * {bm25("(3.0::double * tf_title + tf_body)", "size")}), 9) AS score
    FROM tfs JOIN dfs USING (phrase) JOIN phrases USING (phrase), pstats GROUP BY ALL)"""


def word_tokens(x: str) -> str:
    """Letters and digits without marks, but a user's words as single tokens: pieces that follow each other are joined, the longest words first."""
    bare = sorted({"".join(c for c in unicodedata.normalize("NFD", w.lower()) if not unicodedata.combining(c)) for w in USER_WORDS}, key=lambda w: (-len(w), w))
    pieces = rf"chr(1) || array_to_string(regexp_extract_all(strip_accents(lower({x})), '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+'), chr(1)) || chr(1)"
    for w in bare:
        parts = [p for p in re.split(r"([^\W_]+)", w) if p]
        if len(parts) > 1:
            old, new = (" || ".join(f"{s} || {literal(p)}" for p in parts) for s in ("chr(1)", "chr(2)"))
            pieces = f"replace({pieces}, {old} || chr(1), chr(1) || {new} || chr(1))"
    kept = rf"list_filter(string_split({pieces}, chr(1)), lambda p: regexp_matches(p, '[\p{{L}}\p{{N}}]'))"
    return f"list_transform({kept}, lambda p: replace(p, chr(2), ''))"


VECTORS = "vectors AS (SELECT vec_id AS chunk_id, embedding::double[] AS e, label FROM embeddings), vq AS (SELECT chunk_id AS query_id, e AS v, label FROM vectors WHERE chunk_id % 50 = 0)"
COS = "knn AS (SELECT query_id, chunk_id, round(list_cosine_similarity(v, e), 9) AS score, vectors.label FROM vq, vectors)"
L2 = "knn AS (SELECT query_id, chunk_id, round(0.0::double - list_distance(v, e), 9) AS score FROM vq, vectors)"
WORDS = r"""words AS (SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '\s+'), lambda w: length(w) >= 3)) AS word FROM q)"""
FALLBACK = f"""{WORDS},
hits AS (SELECT word, chunk_id, greatest(length(body) - 2, 0) AS len, ((length(body) - length(replace(lower(body), word, ''))) // length(word)) AS tf
    FROM (SELECT DISTINCT word FROM words) JOIN chunks ON contains(lower(body), word)),
fstats AS (SELECT count(*) AS n, avg(greatest(length(body) - 2, 0)) AS avgdl FROM chunks),
fdf AS (SELECT word, count(*) AS df FROM hits GROUP BY word),
wscores AS (SELECT word, chunk_id, round({bm25("tf::double", "len")}, 9) AS score FROM hits JOIN fdf USING (word), fstats),
wbest AS ({best("wscores", 30, "word")}),
fb_scores AS (SELECT query_id, chunk_id, round(sum(1.0::double / (10 + rk)), 9) AS score FROM words JOIN wbest USING (word) GROUP BY ALL)"""
#: The same where words may overlap themselves: each place is tried for words that begin as they end.
OVERLAPPING = FALLBACK.replace(
    FALLBACK[FALLBACK.index("hits AS"):FALLBACK.index("fstats AS")],
    """met AS (SELECT word, chunk_id, lower(body) AS body, len(list_filter(range(1, length(word)), lambda k: left(word, k) = right(word, k))) > 0 AS bordered
    FROM (SELECT DISTINCT word FROM words) JOIN chunks ON contains(lower(body), word)),
places AS (SELECT word, chunk_id, count(*) AS tf FROM (SELECT word, chunk_id, body, unnest(range(1, length(body) - length(word) + 2)) AS i FROM met WHERE bordered) WHERE substr(body, i, length(word)) = word GROUP BY ALL),
hits AS (SELECT word, chunk_id, greatest(length(body) - 2, 0) AS len, coalesce(tf, (length(body) - length(replace(body, word, ''))) // length(word)) AS tf FROM met LEFT JOIN places USING (word, chunk_id)),
""",
)
QV = "qv AS (SELECT query_id, e AS v FROM q JOIN vectors ON chunk_id = query_id * 50)"
LISTS = with_(
    *KW, FALLBACK, VECTORS, QV,
    "sem AS (SELECT query_id, chunk_id, round(list_cosine_similarity(v, e), 9) AS score FROM qv, vectors)",
    f"""lists AS (SELECT query_id, 'keyword' AS src, chunk_id, score, rk FROM ({best("kw_scores", 30)}) WHERE query_id IN (FROM (SELECT query_id FROM qv))
    UNION ALL SELECT query_id, 'semantic', chunk_id, score, rk FROM ({best("sem", 30)})
    UNION ALL SELECT query_id, 'fallback', chunk_id, score, rk FROM ({best("fb_scores", 30)}) WHERE query_id IN (FROM (SELECT query_id FROM qv)))""",
)


def rrf(weights: str, k: int, top: int, source: str = "lists", by: str = "") -> str:
    group = f"query_id{', ' + by if by else ''}"
    return f"""fused AS (SELECT {group}, chunk_id, round(sum({weights} / ({k} + rk)), 9) AS rrf, string_agg(src || '#' || rk, ', ' ORDER BY rk, src) AS hits
    FROM {source} GROUP BY {group}, chunk_id),
top AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY rrf DESC, chunk_id) AS rk FROM fused QUALIFY rk <= {top})"""


USUAL = "(CASE src WHEN 'fallback' THEN 0.5 ELSE 1.0 END)::double"
GOLD = """gold_all AS (SELECT query_id, chunk_id FROM q JOIN chunks ON contains(lower(body), lower(query))),
gold AS (SELECT * FROM gold_all WHERE query_id IN (SELECT query_id FROM gold_all GROUP BY 1 HAVING count(*) BETWEEN 1 AND 60))"""


def metrics(lists: str, queries: str, by: str = "") -> str:
    """Means of hits, recall and reciprocal rank over ``queries`` crossed with ``by``."""
    group = f"{by}, " if by else ""
    cross = f"(SELECT DISTINCT query_id FROM {queries}) CROSS JOIN (SELECT DISTINCT {by} FROM {lists})" if by else f"(SELECT DISTINCT query_id FROM {queries})"
    using = f"(query_id{', ' + by if by else ''})"
    counts = ", ".join(f"count(*) FILTER (rk <= {k}) AS n{k}" for k in (1, 3, 5, 10))
    hit = ", ".join(f"round(avg((coalesce(n{k}, 0) > 0)::int), 6) AS hit_{k}" for k in (1, 3, 5, 10))
    recall = ", ".join(f"round(avg(coalesce(n{k}::double / golds, 0)), 6) AS recall_{k}" for k in (1, 3, 5, 10))
    return f"""sizes AS (SELECT query_id, count(*) AS golds FROM gold GROUP BY 1),
right_ones AS (SELECT query_id, {group} min(rk) AS best, {counts} FROM {lists} JOIN gold USING (query_id, chunk_id) GROUP BY ALL)
SELECT {group} count(*) AS n_queries, {hit}, {recall}, round(avg(coalesce(1.0::double / best, 0)), 6) AS mrr
FROM {cross} LEFT JOIN right_ones USING {using} LEFT JOIN sizes USING (query_id) {"GROUP BY " + by if by else ""}"""


LOG = """log AS (SELECT event_id AS id, ts, event_type AS mode, value AS latency_ms, user_id % 10 AS n_results, (user_id % 7 = 0)::int AS invalid,
    (event_type = 'error')::int AS refused, CASE WHEN event_type <> 'view' THEN least(1.0::double, abs(value) / 100) END AS coverage FROM events)"""
LINES = """lines AS (SELECT source AS doc_id, doc_id AS page, unnest(string_split(text, chr(10))) AS text,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
sized AS (SELECT *, 10.0::double + length(text) % 4 AS size FROM lines)"""


def cleaned(x: str) -> str:
    for old, new in REPLACED:
        x = f"replace({x}, {literal(old)}, {literal(new)})"
    return rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


NOISE = "(length(text) <= 2 AND NOT regexp_matches(text, '[가-힣A-Za-z]{2}')) OR " + " OR ".join(f"regexp_matches(text, {literal(p)})" for p in FURNITURE)
PIECES = rf"""docs AS (SELECT doc_id, {trimmed("text")} AS body FROM documents),
pieces AS (SELECT doc_id, list_filter(flatten(list_transform(list_filter(list_transform(regexp_split_to_array(body, '\n{{2,}}'), lambda p: {trimmed("p")}), lambda p: p <> ''),
    lambda p: CASE WHEN length(p) > 1600 THEN string_split(regexp_replace(p, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)) ELSE [p] END)), lambda p: p <> '') AS ps FROM docs),
folded AS (SELECT doc_id, list_reduce(list_transform(ps, lambda p: {{'done': []::varchar[], 'open': p}}), lambda s, x:
    CASE WHEN s.open <> '' AND length(s.open) + length(x.open) + 1 > 900
    THEN {{'done': list_append(s.done, s.open), 'open': {trimmed("right(s.open, 150) || ' ' || x.open")}}}
    ELSE {{'done': s.done, 'open': {trimmed("s.open || ' ' || x.open")}}} END) AS f FROM pieces WHERE len(ps) > 0),
split AS (SELECT doc_id, unnest(list_append(f.done, f.open)) AS chunk, generate_subscripts(list_append(f.done, f.open), 1) - 1 AS n FROM folded)"""
BLOCKS = f"""ranked AS ({best("kw_scores", 8)}),
blocks AS (SELECT query_id, chunk_id, rk, '[' || chunk_id || ']' || chr(10) || ' ' || source || chr(10) || title || chr(10) || body || chr(10) AS block
    FROM ranked JOIN chunks USING (chunk_id)),
running AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rk ROWS UNBOUNDED PRECEDING)::bigint AS used FROM blocks)"""
ANSWERS = r"""answers AS (SELECT conv_id, turn, text || ' [c' || conv_id || '#' || printf('%04d', turn) || ']. [c' || conv_id || '#' || printf('%04d', turn) || '] [x]' AS answer,
    ['c' || conv_id || '#0001', 'c' || conv_id || '#0002', 'c' || conv_id || '#0003'] AS allowed FROM conversations),
parts AS (SELECT *, list_sort(list_distinct(regexp_extract_all(answer, '\[([A-Za-z0-9_]+#\d{4})\]', 1))) AS cited,
    list_filter(string_split(regexp_replace(regexp_replace(answer, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda p: trim(p) <> '') AS ps FROM answers),
report AS (SELECT conv_id, turn, cited, list_sort(list_filter(cited, lambda c: NOT list_contains(allowed, c))) AS invalid,
    list_sort(list_filter(allowed, lambda c: NOT list_contains(cited, c))) AS unused,
    len(list_filter(ps, lambda p: NOT regexp_matches(p, '\[[A-Za-z0-9_]+#\d{4}\]')))::bigint AS uncited_sentences, len(ps) AS n FROM parts),
verdicts AS (SELECT *, round_even(1 - uncited_sentences::double / greatest(1, n), 2) AS coverage, len(cited) > 0 AND len(invalid) = 0 AS ok FROM report),
gated AS (SELECT *, CASE WHEN len(invalid) > 0 THEN 'reject' WHEN coverage < 0.8 THEN 'retry' ELSE 'pass' END AS gate FROM verdicts)"""
MINED = rf"""words AS (SELECT doc_id, trim(raw, {literal(WORD_MARKS)}) AS word FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS raw FROM documents)),
each_word AS (SELECT doc_id, word, count(*) AS n, regexp_extract_all(lower(word), '\p{{L}}+|\p{{N}}+') AS pieces FROM words
    WHERE length(word) >= 3 AND regexp_matches(word, '^[가-힣A-Za-z]') GROUP BY ALL),
piece_docs AS (SELECT DISTINCT doc_id, unnest(pieces) AS piece FROM each_word),
kept AS (SELECT word, sum(n)::bigint AS n, count(*) AS docs, any_value(pieces) AS pieces FROM each_word WHERE len(pieces) >= 2 GROUP BY word HAVING sum(n) >= 3),
own AS (SELECT word, unnest(list_distinct(pieces)) AS piece FROM kept),
cand_docs AS (SELECT word, doc_id FROM each_word WHERE word IN (SELECT word FROM kept)),
collide AS (SELECT own.word, piece, list_position(pieces, piece) AS nth,
    (SELECT count(*) FROM piece_docs p WHERE p.piece = own.piece AND NOT EXISTS (FROM cand_docs c WHERE c.word = own.word AND c.doc_id = p.doc_id)) AS collide
    FROM own JOIN kept USING (word)),
mined AS (SELECT word, any_value(n) AS n, any_value(docs) AS docs, max(collide) AS collide, arg_max(piece, {{'c': collide, 'n': -nth}}) AS worst
    FROM collide JOIN kept USING (word) GROUP BY word)"""
TENTHS = "list_sort(list({0}))[count(*) // 10 + 1] AS p10, list_sort(list({0}))[count(*) * 9 // 10 + 1] AS p90"
PERCENTILES = "list_sort(list({0}))[count(*) // 2 + 1] AS p50, list_sort(list({0}))[least(count(*) - 1, floor(count(*) * 0.95))::bigint + 1] AS p95"
PRICED = "ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber"
_TAIL = r"regexp_replace(title || ' > ' || source || ' ' || chunk_id, '^.*>', '')"

SECTIONS = (
    r"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)""",
    r"""marked AS (SELECT *, length(regexp_extract(line, '^(#{2,3})\s+(.*)$', 1)) AS level, trim(regexp_extract(line, '^(#{2,3})\s+(.*)$', 2)) AS name FROM lines)""",
    "numbered AS (SELECT *, sum((level > 0)::int) OVER d AS section, sum((level = 2)::int) OVER d AS part FROM marked WINDOW d AS (PARTITION BY doc_id ORDER BY n))",
    """titled AS (SELECT *, last_value(CASE WHEN level = 2 THEN name END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS h2,
    last_value(CASE WHEN level = 3 THEN name END IGNORE NULLS) OVER (PARTITION BY doc_id, part ORDER BY n) AS h3 FROM numbered)""",
    rf"""found AS (SELECT doc_id, section::bigint AS section, any_value(concat_ws(' > ', nullif(h2, ''), nullif(h3, ''))) AS title,
    {trimmed("coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (level = 0), '')")} AS body FROM titled GROUP BY doc_id, section)""",
)
_PIECES = rf"""pieces AS (SELECT doc_id, section, title, list_filter(flatten(list_transform(list_filter(list_transform(regexp_split_to_array(body, '\n{{2,}}'), lambda p: {trimmed("p")}), lambda p: p <> ''),
    lambda p: CASE WHEN length(p) > 1600 THEN string_split(regexp_replace(p, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)) ELSE [p] END)), lambda p: p <> '') AS ps FROM found WHERE body <> ''),
"""
CHUNKED = (
    *SECTIONS,
    _PIECES + PIECES[PIECES.index("folded AS"):].replace("doc_id, list_reduce", "doc_id, section, title, list_reduce").replace("SELECT doc_id, unnest", "SELECT doc_id, section, title, unnest"),
    """begun AS (SELECT *, NOT (length(chunk) < 120 AND coalesce(title = lag(title) OVER d, false)) AS begins FROM split WHERE length(chunk) >= 40 WINDOW d AS (PARTITION BY doc_id ORDER BY section, n))""",
    "islands AS (SELECT *, sum(begins::int) OVER (PARTITION BY doc_id ORDER BY section, n) AS island FROM begun)",
    "merged AS (SELECT doc_id, island, arg_min(title, (section, n)) AS title, string_agg(chunk, ' ' ORDER BY section, n) AS body FROM islands GROUP BY doc_id, island)",
    "numbered_chunks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS seq FROM merged)",
)
MARKDOWN = (
    """page_lines AS (SELECT doc_id, i // 8 AS page, i % 8 AS line_no, text, 10.0::double + length(text) % 4 AS size
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents))""",
    f"cl AS (SELECT doc_id, page, line_no, size, {cleaned('text')} AS text FROM page_lines)",
    "fonts AS (SELECT doc_id, arg_max(size, (chars, -size)) AS body_size FROM (SELECT doc_id, size, sum(length(text)) AS chars FROM cl GROUP BY ALL) GROUP BY doc_id)",
    """repeats AS (SELECT doc_id, text FROM (SELECT doc_id, text, count(DISTINCT (page, size)) AS n FROM cl WHERE length(text) BETWEEN 1 AND 40 GROUP BY ALL)
    JOIN (SELECT doc_id, count(DISTINCT page) AS pages FROM cl GROUP BY 1) USING (doc_id) WHERE n >= greatest(3, floor(pages * 0.4::double)))""",
    f"""leveled AS (SELECT cl.*, CASE WHEN length(text) <= 70 AND size >= body_size + 2.5 THEN 2 WHEN length(text) <= 70 AND size >= body_size + 1.0 THEN 3 END AS level
    FROM cl JOIN fonts USING (doc_id) WHERE NOT ({NOISE}) AND NOT EXISTS (FROM repeats r WHERE r.doc_id = cl.doc_id AND r.text = cl.text))""",
    f"stripped AS (SELECT * REPLACE (CASE WHEN marked THEN regexp_replace(text, {literal(LEADING_MARK)}, '') ELSE text END AS text) FROM (SELECT *, level IS NULL AND regexp_matches(text, {literal(LEADING_MARK)}) AS marked FROM leveled))",
    f"ended AS (SELECT *, level IS NOT NULL OR regexp_matches(text, {literal(SENTENCE_END)}) AS ends FROM stripped)",
    "broken AS (SELECT *, level IS NOT NULL OR marked OR coalesce(lag(ends) OVER (PARTITION BY doc_id ORDER BY page, line_no), true) AS breaks FROM ended)",
    "in_blocks AS (SELECT *, sum(breaks::int) OVER (PARTITION BY doc_id ORDER BY page, line_no) AS block FROM broken)",
    "md_blocks AS (SELECT doc_id, block, CASE max(level) WHEN 2 THEN '## ' WHEN 3 THEN '### ' ELSE '' END || string_agg(text, ' ' ORDER BY page, line_no) AS text FROM in_blocks GROUP BY ALL)",
    rf"mds AS (SELECT doc_id, regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY block), '\n{{3,}}', chr(10) || chr(10), 'g') AS md FROM md_blocks WHERE {trimmed('text')} <> '' GROUP BY doc_id)",
)


def hashed_words(name: str, rows: str, key: str, text: str) -> str:
    """Vectors of hashed words as rows of slot and value, rounded to floats as a stored vector is."""
    return f"""{name}_counts AS (SELECT {key}, ('0x' || left(md5(t), 2))::int % 64 AS slot, count(*) AS c FROM (SELECT {key}, unnest({tokens(text)}) AS t FROM {rows}) GROUP BY ALL),
{name} AS (SELECT {key}, slot, (c / sqrt(sum(c * c) OVER (PARTITION BY {key})::double))::float::double AS x FROM {name}_counts),
{name}_norms AS (SELECT {key}, sqrt(sum(x * x)) AS norm FROM {name} GROUP BY {key})"""


TEXT_VECTORS = f"""{hashed_words("cv", "chunks", "chunk_id", "title || chr(10) || body")},
{hashed_words("qv", "q", "query_id", "query")},
text_sem AS (SELECT query_id, cn.chunk_id, round(coalesce(sum(qv.x * cv.x), 0) / any_value(qn.norm) / any_value(cn.norm), 9) AS score
    FROM qv_norms qn CROSS JOIN cv_norms cn JOIN qv USING (query_id) LEFT JOIN cv ON cv.chunk_id = cn.chunk_id AND cv.slot = qv.slot GROUP BY query_id, cn.chunk_id)"""
THREE = f"""lists AS (SELECT query_id, 'keyword' AS src, chunk_id, rk FROM ({best("kw_scores", 30)})
    UNION ALL SELECT query_id, 'semantic', chunk_id, rk FROM ({best("text_sem", 30)})
    UNION ALL SELECT query_id, 'fallback', chunk_id, rk FROM ({best("fb_scores", 30)}))"""
COMBOS = """combos(combo) AS (VALUES ('keyword'), ('semantic'), ('fallback'), ('keyword+semantic'), ('keyword+fallback'), ('semantic+fallback'), ('keyword+semantic+fallback')),
in_combo AS (SELECT combo, lists.* FROM combos JOIN lists ON list_contains(string_split(combo, '+'), src))"""
TERM_ITEMS = """chosen_terms AS (SELECT term FROM df WHERE df BETWEEN 3 AND 40 AND length(term) >= 6 ORDER BY md5(term), term LIMIT 20),
items AS (SELECT 'term:' || term AS query_id, 'term' AS kind, term AS query, term AS correct FROM chosen_terms
    UNION ALL SELECT 'typo:' || term, 'typo', left(term, m - 1) || CASE WHEN term[m] = term[m + 1] THEN term[m] ELSE term[m + 1] || term[m] END || substr(term, m + 2), term
    FROM (SELECT term, length(term) // 2 AS m FROM chosen_terms))"""
LINE_CHUNKS = """chunks AS (SELECT doc_id || '#' || printf('%04d', n) AS chunk_id, '' AS title, body FROM
    (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents) WHERE body <> '')"""
FUZZY = rf"""retrieved AS (SELECT query_id, rk, regexp_replace(body, '[^ -~]', '?', 'g') AS b FROM ({best("kw_scores", 10)}) JOIN chunks USING (chunk_id)),
refs AS (SELECT query_id, generate_subscripts(string_split(query, chr(10)), 1) AS ref, regexp_replace(unnest(string_split(query, chr(10))), '[^ -~]', '?', 'g') AS a FROM q),
alike AS (SELECT query_id, ref, rk FROM refs JOIN retrieved USING (query_id) WHERE greatest(length(a), length(b)) > 0
    AND levenshtein(a, b) <= floor(greatest(length(a), length(b)) * 0.5::double + 1e-9)),
precisions AS (SELECT query_id, avg(at_rank) AS precision FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rk)::double / rk AS at_rank FROM (SELECT DISTINCT query_id, rk FROM alike)) GROUP BY query_id)"""
_TOC = "chunks AS (SELECT *, (chunk_id % 9 = 0)::int AS is_toc FROM plain_chunks)"
TOC_CHUNKS = CHUNKS.replace("chunks AS", "plain_chunks AS", 1) + ", " + _TOC
REQUESTS = f"""raw AS (SELECT item_id AS query_id, trim(CASE WHEN item_id % 17 = 0 THEN '  ' ELSE array_to_string(string_split(text, ' ')[1:6], ' ') END, chr(32) || chr(9) || chr(10) || chr(13)) AS query,
    CASE item_id % 5 WHEN 0 THEN 'keyword' WHEN 1 THEN 'semantic' WHEN 2 THEN 'fallback' ELSE 'hybrid' END AS mode,
    CASE item_id % 7 WHEN 2 THEN 5 WHEN 3 THEN 20 WHEN 4 THEN 3 WHEN 5 THEN 12 WHEN 6 THEN 1 ELSE 8 END AS top_n,
    CASE item_id % 4 WHEN 1 THEN ['en'] WHEN 2 THEN ['fr', 'xx'] WHEN 3 THEN ['none'] END AS facets, item_id % 3 <> 2 AS exclude_toc FROM benchmark),
q AS (SELECT query_id, query FROM raw WHERE query <> '')"""
TOOL = f"""pairs AS (SELECT query_id, level, chunk_id FROM raw, (VALUES (0), (1)) l(level), chunks WHERE query <> '' AND (level = 1 OR facets IS NULL OR list_contains(facets, lang)) AND NOT (exclude_toc AND is_toc = 1)),
by_word AS (SELECT query_id, level, nth, chunk_id, score FROM (SELECT query_id, word, row_number() OVER () AS nth FROM words) JOIN wscores USING (word) JOIN pairs USING (query_id, chunk_id)),
fb_level AS (SELECT query_id, level, chunk_id, round(sum(1.0::double / (10 + rk)), 9) AS score FROM ({best("by_word", 30, "query_id, level, nth")}) GROUP BY ALL),
kw_level AS (SELECT s.query_id, level, chunk_id, score FROM kw_scores s JOIN pairs USING (query_id, chunk_id)),
sem_level AS (SELECT s.query_id, level, chunk_id, score FROM text_sem s JOIN pairs USING (query_id, chunk_id)),
lists AS (SELECT query_id, level, 'keyword' AS src, chunk_id, rk FROM ({best("kw_level", 30, "query_id, level")})
    UNION ALL SELECT query_id, level, 'semantic', chunk_id, rk FROM ({best("sem_level", 30, "query_id, level")})
    UNION ALL SELECT query_id, level, 'fallback', chunk_id, rk FROM ({best("fb_level", 30, "query_id, level")})),
{rrf(USUAL, 60, 20, "lists", "level")},
answers AS (SELECT query_id, level, chunk_id, l.rk FROM lists l JOIN raw USING (query_id) WHERE src = mode AND l.rk <= top_n
    UNION ALL SELECT query_id, level, chunk_id, t.rk FROM top t JOIN raw USING (query_id) WHERE mode = 'hybrid' AND t.rk <= top_n),
level_of AS (SELECT query_id, min(level) AS level FROM answers JOIN raw USING (query_id) WHERE level = 0 OR facets IS NOT NULL GROUP BY query_id),
chosen AS (SELECT answers.* FROM answers JOIN level_of USING (query_id, level)),
tool_blocks AS (SELECT query_id, chunk_id, rk, '[' || chunk_id || ']' || chr(10) || ' ' || source || chr(10) || title || chr(10) || body || chr(10) AS block FROM chosen JOIN chunks USING (chunk_id)),
tool_running AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rk ROWS UNBOUNDED PRECEDING)::bigint AS used FROM tool_blocks),
tool_served AS (SELECT query_id, string_agg(chunk_id::varchar, ',' ORDER BY rk) AS served, string_agg(block, chr(10) || '---' || chr(10) ORDER BY rk) AS context, max(used) AS used FROM tool_running WHERE used <= 2500 GROUP BY query_id)"""

ORACLES = {
    "tokenize_terms": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)",
    "query_strings": rf"""SELECT item_id, array_to_string(list_transform({tokens("text")}, lambda t: '"' || t || '"'), ' OR ') AS fts_or,
        array_to_string(list_transform({tokens("text")}, lambda t: '"' || t || '"'), ' AND ') AS fts_and,
        array_to_string(list_transform(regexp_extract_all(lower(text), '\p{{N}}+(?:\.\p{{N}}+)+|[\p{{L}}\p{{N}}]+'), lambda t: chr(39) || t || chr(39)), ' | ') AS ts_or FROM benchmark""",
    "doc_term_postings": with_(CHUNKS, POSTINGS) + "SELECT term, chunk_id, tf_title, tf_body FROM postings",
    "term_df_idf": with_(CHUNKS, POSTINGS) + f"SELECT term, df, round({idf()}, 6) AS idf FROM df, stats",
    "doc_len_stats": with_(CHUNKS, POSTINGS) + "SELECT count(*) AS n, round(avg(len), 6) AS avgdl, min(len) AS least, max(len) AS most FROM lens",
    "trigram_index": with_(CHUNKS) + """SELECT gram, count(*) AS df FROM (SELECT chunk_id, unnest(list_distinct(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))) AS gram
        FROM (SELECT chunk_id, regexp_extract_all(lower(body), '(?s).') AS c FROM chunks)) GROUP BY gram""",
    "kw_bm25_top30": with_(BENCH, CHUNKS, POSTINGS, TERMS, kw_scores()) + shown(f"({best('kw_scores', 30)})"),
    "kw_bm25_and_match": with_(*KW) + shown(f"({best('(SELECT * FROM kw_scores s WHERE matched = (SELECT count(*) FROM terms t WHERE t.query_id = s.query_id))', 30)})"),
    "kw_bm25_lang_filter": with_(*KW) + shown(f"""({best("(SELECT * FROM kw_scores WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE lang IN ('fr', 'de')))", 30)})"""),
    "kw_title_body_weighted": with_(*KW, kw_scores("plain_scores", 1.0)) + "SELECT query_id, chunk_id, round(k.score, 6) AS weighted, round(p.score, 6) AS plain FROM kw_scores k JOIN plain_scores p USING (query_id, chunk_id)",
    "kw_cover_density_or": with_(Q, CHUNKS, POSTINGS, TERMS, DENSITY) + shown(f"({best('density', 30)})"),
    "kw_cover_density_and": with_(asked(AND_QUERIES), CHUNKS, PLACED, TERMS, COVERS) + shown(f"({best('cover_scores', 30)})"),
    "kw_phrase_match": with_(asked(PHRASE_QUERIES), CHUNKS, PLACED, PHRASES) + shown(f"({best('phrase_scores', 30)})"),
    "kw_user_words_folded": with_(asked(WORD_QUERIES), CHUNKS, POSTINGS.replace(tokens("title"), word_tokens("title")).replace(tokens("body"), word_tokens("body")),
        TERMS.replace(tokens("query"), word_tokens("query")), kw_scores()) + shown(f"({best('kw_scores', 30)})"),
    "knn_l2_top30": with_(VECTORS, L2) + shown(f"({best('knn', 30)})"),
    "knn_cosine_top30": with_(VECTORS, COS) + shown(f"({best('knn', 30)})"),
    "knn_cells_top30": with_(VECTORS, COS) + shown(f"({best('knn', 30)})"),
    "knn_filtered_pre": with_(VECTORS, COS) + shown(f"({best('(SELECT * FROM knn WHERE label = 3)', 30)})"),
    "knn_overfetch_postfilter": with_(VECTORS, COS, f"pool AS (SELECT query_id, chunk_id, score FROM ({best('knn', 240)}) WHERE label = 3)") + shown(f"({best('pool', 30)})"),
    "vector_norms": with_(VECTORS) + "SELECT chunk_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(list_dot_product(e, e), 6) AS square FROM vectors",
    "fallback_word_rr": with_(Q, CHUNKS, FALLBACK) + shown(f"({best('fb_scores', 30)})"),
    "fallback_bigram_similarity": with_(Q, CHUNKS, r"words AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(query, '\s+'), lambda w: length(w) >= 3)) AS word FROM q)",
        "hits AS (SELECT word, chunk_id, body FROM (SELECT DISTINCT word FROM words) JOIN chunks ON contains(body, word) QUALIFY row_number() OVER (PARTITION BY word ORDER BY chunk_id) <= 300)",
        "chars AS (SELECT word, chunk_id, regexp_extract_all(' ' || lower(word) || ' ', '(?s).') AS a, regexp_extract_all(' ' || lower(body) || ' ', '(?s).') AS b FROM hits)",
        "sets AS (SELECT word, chunk_id, list_distinct(list_transform(range(1, len(a)), lambda i: a[i] || a[i + 1])) AS a, list_distinct(list_transform(range(1, len(b)), lambda i: b[i] || b[i + 1])) AS b FROM chars)",
        "alike AS (SELECT word, chunk_id, round(len(list_intersect(a, b))::double / greatest(len(a), len(b)), 9) AS alike FROM sets)",
        "scores AS (SELECT query_id, chunk_id, max(alike) AS score FROM words JOIN alike USING (word) GROUP BY ALL)") + shown(f"({best('scores', 30)})"),
    "lateral_contains_topk": with_(Q, CHUNKS, r"words AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(query, '\s+'), lambda w: length(w) >= 3)) AS word FROM q)")
        + "SELECT word, chunk_id, row_number() OVER (PARTITION BY word ORDER BY chunk_id) AS rk FROM words JOIN chunks ON contains(body, word) QUALIFY rk <= 20",
    "rrf_hybrid_top10": LISTS.rstrip() + ",\n" + rrf(USUAL, 60, 10) + "SELECT query_id, chunk_id, round(rrf, 6) AS rrf, hits, rk, title, lang FROM top JOIN chunks USING (chunk_id)",
    "rrf_weighted": LISTS.rstrip() + ",\n" + rrf("(CASE src WHEN 'keyword' THEN 0.2 WHEN 'semantic' THEN 0.0 ELSE 2.0 END)::double", 10, 15) + "SELECT query_id, chunk_id, round(rrf, 6) AS rrf, hits, rk FROM top",
    "ablation_combos": LISTS.rstrip() + """,
combos(combo) AS (VALUES ('keyword'), ('semantic'), ('fallback'), ('keyword+semantic'), ('keyword+fallback'), ('semantic+fallback'), ('keyword+semantic+fallback')),
in_combo AS (SELECT combo, lists.* FROM combos JOIN lists ON list_contains(string_split(combo, '+'), src)),
""" + rrf(USUAL, 60, 10, "in_combo", "combo") + "SELECT query_id, combo, chunk_id, round(rrf, 6) AS rrf, hits, rk FROM top",
    "batch_search_modes": LISTS.rstrip() + ",\n" + rrf(USUAL, 60, 10) + """SELECT query_id, src AS mode, src AS hits, chunk_id, round(score, 6) AS score, rk FROM lists WHERE rk <= 10
        UNION ALL SELECT query_id, 'hybrid', hits, chunk_id, round(rrf, 6), rk FROM top""",
    "compare_by_lang_topn": with_(*KW) + shown(f"({best('(SELECT s.*, lang FROM kw_scores s JOIN chunks USING (chunk_id))', 5, 'query_id, lang')})", "lang,"),
    "relaxed_filter_search": with_(*KW, "es AS (SELECT * FROM kw_scores WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE lang = 'es'))")
        + f"""SELECT query_id, 0 AS was_relaxed, chunk_id, round(score, 6) AS score, rk FROM ({best("es", 10)})
        UNION ALL SELECT query_id, 1, chunk_id, round(score, 6), rk FROM ({best("kw_scores", 10)}) WHERE query_id NOT IN (SELECT query_id FROM es)""",
    "mode_agreement": LISTS.rstrip() + ",\n" + rrf(USUAL, 60, 10) + """SELECT l.query_id, src, count(*) AS n, count(*) FILTER (chunk_id IN (SELECT chunk_id FROM top t WHERE t.query_id = l.query_id)) AS overlap_hybrid,
        (SELECT count(*) FROM top t WHERE t.query_id = l.query_id AND NOT EXISTS (FROM lists m WHERE m.query_id = t.query_id AND m.chunk_id = t.chunk_id AND m.rk <= 10)) AS lifted
        FROM lists l WHERE rk <= 10 GROUP BY l.query_id, src""",
    "facet_counts": "SELECT lang, source, count(*) AS n, sum(n_chars)::bigint AS n_chars FROM documents GROUP BY ALL",
    "gold_by_substring": with_(BENCH, CHUNKS, GOLD) + "SELECT query_id, chunk_id FROM gold",
    "eval_hit_recall_mrr": with_(BENCH, CHUNKS, POSTINGS, TERMS, kw_scores(), DENSITY, GOLD,
        f"lists AS (SELECT query_id, chunk_id, rk, 'bm25' AS mode FROM ({best('kw_scores', 10)}) UNION ALL SELECT query_id, chunk_id, rk, 'density' FROM ({best('density', 10)}))").rstrip() + ",\n" + metrics("lists", "q", "mode"),
    "eval_by_label": with_(VECTORS, COS, "gold AS (SELECT query_id, chunk_id FROM vq JOIN vectors USING (label))", f"lists AS ({best('knn', 10)})").rstrip() + ",\n" + metrics("lists", "vq"),
    "variant_overlap": with_(BENCH, CHUNKS, POSTINGS, TERMS, kw_scores(), DENSITY, f"a AS ({best('kw_scores', 10)})", f"b AS ({best('density', 10)})")
        + "SELECT query_id, count(*) AS n_a, count(b.chunk_id) AS shared FROM a LEFT JOIN b USING (query_id, chunk_id) GROUP BY query_id",
    "context_quality": with_(BENCH, CHUNKS, POSTINGS, TERMS, kw_scores(), GOLD, f"a AS ({best('kw_scores', 10)})",
        "hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rk)::double / rk AS p FROM a JOIN gold USING (query_id, chunk_id))",
        "sizes AS (SELECT query_id, count(*) AS golds FROM gold GROUP BY 1)")
        + "SELECT query_id, round(count(p)::double / any_value(golds), 6) AS recall, round(coalesce(avg(p), 0), 6) AS precision FROM sizes LEFT JOIN hits USING (query_id) GROUP BY query_id",
    "ablation_metrics": with_(BENCH, CHUNKS, POSTINGS, TERMS, kw_scores(), OVERLAPPING, TEXT_VECTORS, GOLD, THREE, COMBOS,
        rrf(USUAL, 60, 10, "in_combo", "combo"), "m AS (WITH " + metrics("top", "q", "combo") + ")")
        + "SELECT *, round(mrr - (SELECT mrr FROM m WHERE combo = 'keyword+semantic+fallback'), 6) AS delta_mrr FROM m",
    "term_typo_items": with_(CHUNKS, POSTINGS, TERM_ITEMS) + "SELECT query_id, kind, query, correct FROM items",
    "term_typo_metrics": with_(CHUNKS, POSTINGS, TERM_ITEMS, "q AS (SELECT query_id, query FROM items)", TERMS, kw_scores(), OVERLAPPING, TEXT_VECTORS,
        GOLD.replace("FROM q JOIN", "FROM (SELECT query_id, correct AS query FROM items) JOIN"),
        THREE.replace("30)", "10)").replace("rk <= 30", "rk <= 10"),
        "kinds AS (SELECT i.kind, i.query_id, l.src AS mode, l.chunk_id, l.rk FROM items i JOIN lists l USING (query_id))",
        "sizes AS (SELECT query_id, count(*) AS golds FROM gold GROUP BY 1)",
        "judged AS (SELECT kind, m.mode, i.query_id, any_value(golds) AS golds, min(rk) FILTER (g.chunk_id IS NOT NULL) AS best, "
        + ", ".join(f"count(*) FILTER (g.chunk_id IS NOT NULL AND rk <= {k}) AS n{k}" for k in (1, 3, 5, 10))
        + " FROM items i CROSS JOIN (SELECT DISTINCT src AS mode FROM lists) m LEFT JOIN lists l ON l.query_id = i.query_id AND l.src = m.mode LEFT JOIN gold g ON g.query_id = l.query_id AND g.chunk_id = l.chunk_id LEFT JOIN sizes z ON z.query_id = i.query_id GROUP BY ALL)")
        + "SELECT kind, mode, count(*) AS n_queries, " + ", ".join(f"round(avg((n{k} > 0)::int), 6) AS hit_{k}, round(avg(coalesce(n{k}::double / golds, 0)), 6) AS recall_{k}" for k in (1, 3, 5, 10))
        + ", round(avg(coalesce(1.0::double / best, 0)), 6) AS mrr FROM judged GROUP BY kind, mode",
    "context_quality_fuzzy": with_(BENCH, LINE_CHUNKS, POSTINGS, TERMS, kw_scores(), FUZZY)
        + """SELECT r.query_id, round(count(DISTINCT a.ref)::double / any_value(n), 6) AS recall, round(coalesce(any_value(precision), 0), 6) AS precision
        FROM (SELECT query_id, count(*) AS n FROM refs GROUP BY 1) r LEFT JOIN alike a USING (query_id) LEFT JOIN precisions p USING (query_id) GROUP BY r.query_id""",
    "tool_search": with_(REQUESTS, TOC_CHUNKS, POSTINGS, TERMS, kw_scores(), OVERLAPPING, TEXT_VECTORS, TOOL)
        + """SELECT raw.query_id, CASE WHEN query = '' THEN 'empty query' WHEN l.level IS NULL THEN 'no results' ELSE 'ok' END AS status, coalesce(l.level = 1, false) AS was_relaxed,
        coalesce(served, '') AS served, coalesce(used, 0) AS used, md5(coalesce(context, '')) AS context_md5 FROM raw LEFT JOIN level_of l USING (query_id) LEFT JOIN tool_served USING (query_id)""",
    "kw_exclude_toc": with_(Q, TOC_CHUNKS, POSTINGS, TERMS, kw_scores()) + shown(f"({best('(SELECT * FROM kw_scores WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE is_toc = 0))', 30)})"),
    "semantic_by_text": with_(Q, CHUNKS, TEXT_VECTORS) + shown(f"({best('text_sem', 10)})"),
    "chunk_documents": with_(*CHUNKED) + "SELECT doc_id, doc_id || '#' || printf('%04d', seq) AS chunk_id, seq, title, md5(body) AS body_md5 FROM numbered_chunks",
    "markdown_from_lines": with_(*MARKDOWN) + "SELECT doc_id, length(md) AS chars, md5(md) AS md_md5 FROM mds",
    "topic_collect_sums": with_(*KW, BLOCKS, "chosen AS (SELECT * FROM blocks WHERE rk <= 5 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY query_id) = 1)")
        + "SELECT query_id, count(*) AS n_blocks, coalesce(sum(length(block)), 0)::bigint AS cost FROM chosen GROUP BY ROLLUP (query_id)",
    "log_append": with_(LOG) + "SELECT mode, count(*) AS n, round(avg(refused), 6) AS refused_share, count(*) FILTER (invalid > 0) AS n_invalid, round(avg(coverage), 6) AS mean_coverage FROM log GROUP BY mode",
    "metrics_by_kind": with_(BENCH, CHUNKS, POSTINGS, TERMS, kw_scores(), GOLD, f"a AS ({best('kw_scores', 10)})",
        "rr AS (SELECT q.query_id, coalesce(1.0::double / min(rk) FILTER (gold.chunk_id IS NOT NULL), 0) AS rr FROM q LEFT JOIN a USING (query_id) LEFT JOIN gold ON gold.query_id = a.query_id AND gold.chunk_id = a.chunk_id GROUP BY q.query_id)")
        + "SELECT 'bm25' AS mode, round(avg(rr) FILTER (query_id % 2 = 0), 6) AS auto, round(avg(rr) FILTER (query_id % 2 <> 0), 6) AS manual FROM rr",
    "table_stats": "SELECT count(*) AS n_rows, sum(strlen(text))::bigint AS bytes, count(DISTINCT (lang, source)) AS facets FROM documents",
    "make_auto_items": with_(CHUNKS, r"""tails AS (SELECT chunk_id, regexp_replace(title, '^.*>\s*', '') AS tail, md5(chunk_id::varchar) AS o FROM chunks
        WHERE length(body) > 300 AND title <> '' AND length(title) > 6)""", "firsts AS (SELECT tail, min(o) AS o, arg_min(chunk_id, o) AS gold FROM tails WHERE length(tail) >= 8 GROUP BY tail ORDER BY o LIMIT 30)")
        + "SELECT 'auto-' || printf('%02d', row_number() OVER (ORDER BY o)) AS id, tail AS query, gold FROM firsts",
    "latency_p50_p95": with_(LOG) + f"SELECT mode, count(*) AS n, {PERCENTILES.format('latency_ms')} FROM log GROUP BY mode",
    "section_headings": with_(*SECTIONS)
        + "SELECT doc_id, section, title, md5(body) AS body_md5 FROM found WHERE body <> ''",
    "chunk_split_long": with_(PIECES) + "SELECT doc_id, n, length(chunk) AS chars, md5(chunk) AS chunk_md5 FROM split",
    "chunk_merge_islands": with_("""parts AS (SELECT doc_id, lang AS title, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)""",
        "begun AS (SELECT *, NOT (length(body) < 120 AND coalesce(title = lag(title) OVER d, false)) AS begins FROM parts WHERE length(body) >= 40 WINDOW d AS (PARTITION BY doc_id ORDER BY n))",
        "islands AS (SELECT *, sum(begins::int) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM begun)",
        "merged AS (SELECT doc_id, island, arg_min(title, n) AS title, string_agg(body, ' ' ORDER BY n) AS body FROM islands GROUP BY doc_id, island)",
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS seq FROM merged)")
        + "SELECT doc_id, doc_id || '#' || printf('%04d', seq) AS chunk_id, seq, title, md5(body) AS body_md5 FROM numbered",
    "toc_flag": with_(CHUNKS, rf"""flags AS (SELECT chunk_id, chunk_id % 12 < 8 AS front, regexp_matches({trimmed(_TAIL)}, '\s\d{{1,3}}$') AS tail,
        list_filter(list_transform(string_split(body, chr(10)), lambda x: {trimmed("x")}), lambda x: x <> '') AS ls FROM chunks)""")
        + r"SELECT chunk_id, (front AND (tail OR (len(ls) > 0 AND len(list_filter(ls, lambda x: regexp_matches(x, '\s\d{1,3}$')))::double / greatest(len(ls), 1) >= 0.6)))::int AS is_toc FROM flags",
    "clean_text": f"SELECT doc_id, length({cleaned('text')}) AS chars, md5({cleaned('text')}) AS text_md5, md5({trimmed(chr(114) + 'egexp_replace(text, ' + literal(chr(92) + 's+') + ', ' + literal(' ') + ', ' + literal('g') + ')')}) AS collapsed_md5 FROM documents",
    "noise_lines": with_(LINES, f"cl AS (SELECT doc_id, {cleaned('text')} AS text FROM sized)")
        + f"SELECT doc_id, count(*) AS n, count(*) FILTER ({NOISE}) AS noise, count(*) FILTER (regexp_matches(text, {literal(SENTENCE_END)})) AS ends, count(*) FILTER (regexp_matches(text, {literal(LEADING_MARK)})) AS marked FROM cl GROUP BY doc_id",
    "repeated_lines": with_(LINES, "pages AS (SELECT doc_id, count(DISTINCT page) AS pages FROM sized GROUP BY 1)",
        "counted AS (SELECT doc_id, text, count(DISTINCT (page, size)) AS n FROM sized WHERE length(text) BETWEEN 1 AND 40 GROUP BY ALL)")
        + "SELECT doc_id, text, n FROM counted JOIN pages USING (doc_id) WHERE n >= greatest(3, floor(pages * 0.02::double))",
    "body_font_mode": with_(LINES) + "SELECT doc_id, arg_max(size, (chars, -size)) AS body_size FROM (SELECT doc_id, size, sum(length(text)) AS chars FROM sized GROUP BY ALL) GROUP BY doc_id",
    "chunk_length_distribution": f"SELECT source, count(*) AS n, {PERCENTILES.format('length(text)')}, {TENTHS.format('length(text)')}, min(length(text)) AS least, (sum(length(text)) // count(*))::bigint AS mean, max(length(text)) AS most FROM documents GROUP BY source",
    "context_budget_prefix": with_(*KW, BLOCKS) + "SELECT query_id, md5(string_agg(block, chr(10) || '---' || chr(10) ORDER BY rk)) AS context_md5, count(*) AS n_blocks, max(used) AS used FROM running WHERE used <= 6000 GROUP BY query_id",
    "budget_scan": with_(*KW, BLOCKS) + "SELECT query_id, budget::bigint AS budget, count(*) AS n_blocks, max(used) AS used FROM running JOIN (VALUES (1000), (2000), (3000), (6000)) b(budget) ON used <= budget GROUP BY ALL",
    "topic_collect_dedup": with_(*KW, f"ranked AS ({best('kw_scores', 8)})") + "SELECT query_id, chunk_id, round(score, 6) AS score, rk FROM ranked WHERE rk <= 5 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY query_id) = 1",
    "verify_citations": with_(ANSWERS) + "SELECT conv_id, turn, ok, array_to_string(cited, ',') AS cited, array_to_string(invalid, ',') AS invalid, array_to_string(unused, ',') AS unused, uncited_sentences, coverage, gate FROM gated",
    "citation_gate": with_(ANSWERS) + "SELECT gate, count(*) AS n, count(DISTINCT cited[1]) AS n_cited FROM gated GROUP BY gate",
    "miner_collisions": with_(MINED) + "SELECT word, n, docs, collide, worst FROM mined",
    "userdict_upsert": with_(MINED) + "SELECT coalesce(k.word, m.word) AS word, k.word IS NOT NULL AS accepted FROM (SELECT DISTINCT lower(lang) AS word FROM documents) k FULL JOIN mined m ON k.word = m.word",
    "log_kpis": with_(LOG) + "SELECT mode, count(*) AS n, round(avg(refused), 6) AS refused_share, count(*) FILTER (invalid > 0) AS n_invalid, round(avg(coverage), 6) AS mean_coverage FROM log GROUP BY mode",
    "poor_queries": with_(LOG) + "SELECT id, mode, n_results, refused FROM log WHERE n_results < 3 OR refused = 1",
    "latest_200": with_(LOG) + "SELECT id, mode, round(latency_ms, 6) AS latency_ms FROM log ORDER BY id DESC LIMIT 200",
    "scale_replicate": "SELECT i * 1000000000 + doc_id AS id, doc_id || '-' || i AS chunk_id, n_chars FROM documents, range(1, 6) r(i)",
    "rownumber_trap": f"SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER ({PRICED}) AS rk FROM lineitem QUALIFY rk <= 30",
    "rownumber_fixed": f"SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER ({PRICED}) AS rk FROM (FROM lineitem {PRICED} LIMIT 30)",
    "candidate_cap": f"SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER ({PRICED}) AS rk FROM (FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 2000) QUALIFY rk <= 30",
    "page_titles": rf"""SELECT page_id, {trimmed(r"regexp_replace(regexp_extract(html, '(?si)<title>(.*?)</title>', 1), '\s+', ' ', 'g')")} AS title, length(html) AS chars FROM pages""",
    "page_links_dedup": with_("""links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS i FROM pages)""",
        "firsts AS (SELECT page_id, href, min(i) AS i FROM links GROUP BY ALL)") + "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS n, href FROM firsts QUALIFY n < 15",
    "heading_counts": "SELECT source, sum(len(regexp_extract_all(text, '(?m)^## ')))::bigint AS h2, sum(len(regexp_extract_all(text, '(?m)^### ')))::bigint AS h3 FROM documents GROUP BY source",
    "dashboard_modes": "SELECT lang, count(*) AS n, count(quality) AS labelled, round(avg(quality), 6) AS good, round(avg(toxic), 6) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
}

ORACLES["best_mode"] = "SELECT mode, mrr FROM (" + ORACLES["eval_hit_recall_mrr"] + ") ORDER BY mrr DESC, mode LIMIT 1"
ORACLES["hits_of_results"] = (
    LISTS.rstrip() + ",\n" + rrf(USUAL, 60, 10)
    + "SELECT query_id, chunk_id, split_part(h, '#', 1) AS src, split_part(h, '#', 2)::bigint AS rk FROM (SELECT query_id, chunk_id, unnest(string_split(hits, ', ')) AS h FROM top)"
)
ORACLES["evalset_replace"] = """SELECT printf('manual-%03d', item_id) AS id, md5(text) AS query_md5, item_id::varchar AS gold, 'manual' AS kind FROM benchmark WHERE item_id % 3 <> 0
    UNION ALL SELECT id, md5(query), gold::varchar, 'auto' FROM (""" + ORACLES["make_auto_items"] + ")"
