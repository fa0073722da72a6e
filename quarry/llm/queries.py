"""The queries of this subpackage for the driver's contract, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import let
from quarry.llm import byte_bpe, language_id, personal_data, quality_classifier, quality_rules, toxicity
from quarry.llm.centroid_clusters import clusters
from quarry.llm.embedding_dedup import embedding_groups
from quarry.llm.line_dedup import CUTS, without_repeated_chunks
from quarry.llm.packing import Vocabulary, packed
from quarry.llm.shared import id_remainder, table
from quarry.llm.simhash_dedup import simhash_groups
from quarry.llm.url_rules import judged
from quarry.llm.word_runs import word_runs


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = id_remainder(F.col("doc_id"), 4)
    profiles = language_id.learn(docs.where(remainder != 2))
    answer = language_id.predicted(F.col("text"), profiles)
    return docs.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), answer.alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score"
    )


def fifty_thousand() -> Vocabulary:
    """The vocabulary of byte_bpe_50k.json, whose ranks the other file holds; its one special string keeps its id."""
    return Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), fifty_thousand(), near="lang")


#: Host, path and verdict of each rule.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judged(table(spark, sf_dir, "pages"), rules)


OP5_SQL = rf"""
WITH rules(h, p, v) AS (VALUES {", ".join(map(str, URL_RULES))}),
urls AS (
    SELECT page_id,
        coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
),
fits AS (
    SELECT u.host, u.path, max({{'n': length(h || p), 'm': length(h), 'rule': h || p, 'verdict': v}}) AS best
    FROM (SELECT DISTINCT host, path FROM urls) u JOIN rules ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)
    GROUP BY ALL
)
SELECT page_id, u.host, u.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON u.host = f.host AND u.path = f.path
"""


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = personal_data.found(F.col("text"), personal_data.learn(docs))
    return docs.select("doc_id", found.alias("f")).select(
        "doc_id", "f.n_email", "f.n_ip", "f.n_card", "f.n_phone", F.sha2("f.base", 256).alias("base_sha256"), "f.spans"
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeated_chunks(docs)


OP9_SQL = f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM documents WHERE text IS NOT NULL
),
hashed AS (
    SELECT *, md5(coalesce(lag(md5(line)) OVER d, '') || md5(line)) AS rolled, lead(i) OVER d IS NULL AS ends
    FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY i)
),
numbered AS (
    SELECT *, coalesce(sum((ends OR contains('{CUTS}', right(rolled, 1)))::int) OVER (PARTITION BY doc_id ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
    FROM hashed
),
chunks AS (
    SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM numbered GROUP BY ALL
),
judged AS (
    SELECT *, n > 1 AND row_number() OVER (PARTITION BY n > 1, chunk ORDER BY doc_id, k) > 1 AS gone FROM chunks
)
SELECT d.doc_id,
    CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT gone), '') END AS text,
    coalesce(sum(n), 0)::bigint AS n_lines,
    coalesce(sum(n) FILTER (gone), 0)::bigint AS n_removed_lines,
    count(*) FILTER (gone) AS n_removed_chunks
FROM documents d LEFT JOIN judged j ON d.doc_id = j.doc_id
GROUP BY d.doc_id, d.text
"""


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = id_remainder(F.col("doc_id"), 3)
    model = quality_classifier.learn(docs, table(spark, sf_dir, "labels").where(remainder != 1))
    score = quality_classifier.score(F.col("text"), model)
    return docs.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = id_remainder(F.col("doc_id"), 5)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(remainder != 0))
    score = toxicity.score(F.col("text"), model)
    return docs.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _op12_sql(size: int = 64, k: int = 8, rounds: int = 10) -> str:
    """Each round as two more tables: the nearest centroid of each vector, and the centroids moved."""
    nearest = """near_{0} AS MATERIALIZED (SELECT i, vec_id, arg_min(c.cluster, (d, c.cluster)) AS cluster, min(d) AS distance
        FROM (SELECT i, vec_id, c.cluster, list_sum(list_transform(list_zip(v, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint AS d FROM vectors, cent_{0} c) c GROUP BY i, vec_id)"""
    moved = """sums_{0} AS (SELECT cluster, pos, sum(x)::bigint AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM near_{0} JOIN vectors USING (i)) GROUP BY ALL),
    cent_{1} AS MATERIALIZED (SELECT cluster, coalesce(q, p) AS p FROM cent_{0} LEFT JOIN (
        SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS q FROM sums_{0} GROUP BY cluster) USING (cluster))"""
    parts = [
        f"""vectors AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
        f"""cent_0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::int AS cluster, v AS p
        FROM (SELECT sha256('3:' || coalesce(vec_id::varchar, '')) AS h, v FROM vectors ORDER BY h, v LIMIT {k}))""",
    ]
    for r in range(rounds):
        parts += [nearest.format(r), moved.format(r, r + 1)]
    parts.append(nearest.format(rounds))
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::bigint AS cluster_inertia, sum(distance) OVER ()::bigint AS inertia,
    sha256(array_to_string(p, ',')) AS centroid_sha256
FROM near_{rounds} JOIN cent_{rounds} USING (cluster)"""
    )


def with_periods(text: Column, key: Column) -> Column:
    """The words of every tenth text by hash of its id, from some place on repeated by a period; other texts as they are."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = ((h - h % 10) / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")  # doubles are exact at these sizes
        behind = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), behind), " ")).otherwise("")

    return F.when(h % 10 == 0, let(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), repeated)).otherwise(text)


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = word_runs(docs.select("doc_id", with_periods(F.col("text"), F.col("doc_id")).alias("text")))
    # the longest run, of equally long ones the first: runs come by start, then period
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), 1)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("b"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "b.start", "b.length", "b.period", F.floor(1000 * F.col("b.length") / F.col("b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_simhash_dedup, op2_embedding_dedup, op3_language_id, op4_packing, op5_url_rules, op6_personal_data, op7_quality_rules, op8_byte_bpe, op9_line_dedup, op10_quality_classifier, op11_toxicity, op12_centroid_clusters, op13_word_runs]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_rules": OP5_SQL, "op9_line_dedup": OP9_SQL, "op12_centroid_clusters": _op12_sql()}
