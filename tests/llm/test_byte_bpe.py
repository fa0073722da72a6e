import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import byte_bpe as B
from quarry.llm.tokens import encoding

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def texts():
    rng = random.Random(3)
    pieces = [" ", "  ", "\n\n\n", "'s", "a", "bc", "42", "é", "!!", " the", "日本", "\t \n", "'", "👍🏽"]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 400))) for _ in range(80)]
    return [*made, None, "", "x" * 1000, " " * 1000, "ab " * 500, "ab " * 500, "word" * 30 + " " * 90 + "end"]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (100, 40), (1 << 15, 1 << 9)])
def test_digests_equal_whole_encoding(spark, chunk, overlap):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"sha": F.lit(1), "ids": F.lit("clash")})
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.digests(docs, RANKS, PATTERN, chunk=chunk, overlap=overlap).collect()}
    whole = encoding(RANKS, PATTERN)
    for i, t in rows:
        ids = whole.encode_ordinary(t or "")
        assert found[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_round_trip_of_null_and_repeated_ids(spark):
    rows = [(None, "null id"), (3, "same"), (3, "same"), (4, "long one " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = B.encode(docs, RANKS, PATTERN)
    back = ids.select("doc_id", B.decoded_column(F.col("ids"), RANKS, PATTERN).cast("string").alias("text"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, docs.collect()))
    assert B.digests(docs.limit(0), RANKS, PATTERN).count() == 0
