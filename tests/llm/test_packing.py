import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import packing as K
from quarry.llm.queries import fifty_thousand


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def verify(tokenizer, rows, pieces, window):
    """Every id in exactly one piece, sequences without gaps, and few of them short."""
    left = [(k, ids_of(tokenizer, t)) for k, t in rows]
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append(p)
    total = 0
    for (key, n), found in by_doc.items():
        same = [ids for k, ids in left if k == key and len(ids) == n]
        assert sum(p.length for p in found) == n * len(same)
        for p in found:
            assert any(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for ids in same)
        total += n * len(same)
    assert total == sum(len(ids) for _, ids in left)
    fills = defaultdict(list)
    for p in pieces:
        assert p.length > 0
        fills[p.sequence_id].append((p.offset, p.length))
    for parts in fills.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return sum(sum(n for _, n in parts) < window for parts in fills.values())


def test_ids_equal_the_tokenizers_library(tokenizer):
    vocabulary = fifty_thousand()
    texts = ["", "Hello  world's\n\n\t 42é日本\x1c\x85", "a <|endoftext|>b<|endoftext|>", "<|endoftext|>", "x" * 5000, " " * 300, "ß ​﻿ ﬁ 𝒳 👍🏽"]
    texts += [r for r in ("it's we'll 'tis I'D", "1234567 12.5e-7 ²³ Ⅷ", "\r\n\r\n a", "a b c")]
    for text in texts:
        assert vocabulary.ids(text).tolist() == ids_of(tokenizer, text).tolist()


def test_every_document_of_a_table(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = K.packed(docs, fifty_thousand(), near="lang", shard_bytes=100_000).collect()
    short = verify(tokenizer, [(r.doc_id, r.text) for r in docs.collect()], pieces, 2048)
    assert short <= len({p.sequence_id >> 28 for p in pieces})


def test_odd_rows(spark, tokenizer):
    rows = [(1, None), (2, ""), (None, "null id"), (3, "same"), (3, "same"), (4, "long words " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("near", F.lit(None).cast("string"))
    verify(tokenizer, rows, K.packed(df, fifty_thousand(), window=64).collect(), 64)
    verify(tokenizer, rows, K.packed(df, fifty_thousand(), window=64, near="near").collect(), 64)
    assert K.packed(df.limit(0), fifty_thousand()).count() == 0


def test_scores_are_bm25():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 30, rng.integers(3, 40)) for _ in range(25)]
    index = K.InvertedIndex(docs)
    mean = np.mean([len(d) for d in docs])
    df = {t: sum(t in d for d in docs) for t in range(30)}
    for seed in range(len(docs)):
        for j, d in enumerate(docs):
            want = 0.0
            for t in set(docs[seed].tolist()):
                tf, idf = int((d == t).sum()), np.log((25 - df[t] + 0.5) / (df[t] + 0.5))
                if tf and idf > 0 and df[t] > 1:
                    want += idf * tf * (K.K1 + 1) / (tf + K.K1 * (1 - K.B + K.B * len(d) / mean))
            assert abs(index.scores(seed)[j] - want) < 1e-9


def test_neighbours_of_the_seed_follow_it():
    topic = [np.array([100 + k] * 3 + [200 + k, 300 + k]) for k in (0, 1, 0, 1, 0, 1, 2, 3, 4, 5)]
    order = [d for d, start, *_ in K.pack(topic, 15) if start == 0]
    assert order[:3] == [0, 2, 4] and order[3:6] == [1, 3, 5]


def test_documents_that_share_rare_tokens_share_a_shard(spark):
    rng = np.random.default_rng(5)
    common = [f"word{i}" for i in range(200)]
    rare = [f"{''.join(rng.choice(list('bcdfghjklmnpqrstvwxz'), 12))}" for _ in range(400)]
    rows = [(i, " ".join([*rng.choice(common, 60), *rare[10 * (i % 40) : 10 * (i % 40) + 10]])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shards = defaultdict(set)
    for p in K.packed(df, fifty_thousand(), shard_bytes=10_000).collect():
        shards[p.sequence_id >> 28].add(p.doc_id)
    assert len(shards) > 15
    together = sum(i < j and i % 40 == j % 40 for s in shards.values() for i in s for j in s)
    assert together > 4 * 40 * 45 / len(shards)  # by hash one in as many as there are shards


def test_very_many_tiny_texts_fill_shards_of_bounded_rows(spark):
    rows = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit("")).otherwise(F.lit("word")).alias("text"))
    pieces = K.packed(rows, fifty_thousand()).toPandas()
    assert pieces["doc_id"].nunique() == 200_000
    assert pieces["length"].sum() == 200_000 + 66_666
    shards = pieces.groupby(pieces["sequence_id"] // (1 << K.WINDOW_BITS))["doc_id"].count()
    assert shards.max() <= K.SHARD_BYTES / K.ROW_BYTES + 1
    fills = pieces.groupby("sequence_id")["length"].sum()
    assert (fills < 2048).sum() <= len(shards) and fills.max() == 2048


def slow_pack(documents, window):
    """The order in which documents are taken, by plain scores and whole passes over the documents."""
    index, left, order, fill, seed = K.InvertedIndex(documents), list(range(len(documents))), [], 0, None
    while left:
        best = left[0]
        if fill:
            scores = index.scores(seed)
            best = max(left, key=lambda d: (scores[d], -d))
            best = best if scores[best] > 0 else left[0]
        left.remove(best)
        order.append(best)
        for _ in range(len(documents[best])):
            seed = seed if fill else best
            fill = (fill + 1) % window
    return order


def test_documents_are_taken_as_by_whole_passes():
    rng = np.random.default_rng(8)
    for _ in range(30):
        docs = [rng.integers(0, 60, rng.integers(1, 40)) for _ in range(50)]
        window = int(rng.integers(8, 90))
        assert [d for d, start, *_ in K.pack(docs, window) if start == 0] == slow_pack(docs, window)
