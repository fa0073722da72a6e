import itertools
import re

import __spark_entry__
import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import personal_data
from quarry.llm import quality_classifier as C
from quarry.llm.shared import written
from tests.llm.test_line_dedup import whole_chunks
from tests.llm.test_packing import verify
from tests.llm.test_personal_data import slow_spans


def kept_by_quality(docs, labels):
    """The ids a model gives at least one half that is fitted here on every labelled document."""
    data = sorted((str(i), C.features(docs[i]), float(q > 0)) for i, q in labels if i in docs and q is not None)
    data.sort(key=lambda r: (r[0], r[2], r[1]))
    model = C.fit(np.array([x for _, x, _ in data]), np.array([y for *_, y in data]))
    return {i for i, t in docs.items() if model.probability(np.array([C.features(t)]))[0] >= 0.5}


def without_chunks(docs):
    """Texts less the chunks that an earlier document has, by a table of all chunks so far."""
    seen, out = {}, {}
    for i, text in sorted(docs.items()):
        every = whole_chunks(text)
        taking = [len(c) > 1 or len(c[0].split()) >= 50 for c in every]
        left = ["\n".join(c) for k, c in enumerate(every) if not taking[k] or seen.setdefault(tuple(c), (i, k)) == (i, k)]
        if left:
            out[i] = "\n".join(left)
    return out


def least_of_near_copies(docs):
    """The smallest id of each component of pairs with a Jaccard similarity of 0.8 or more, by all pairs."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for i, t in docs.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for i, w in words.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(docs), 2):
        common = len(sets[i] & sets[j])
        if 10 * common >= 8 * (len(sets[i]) + len(sets[j]) - common):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {find(i) for i in docs}


def test_stages_one_by_one(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf), name))
    raw, good, cut, single, private, pieces = out
    assert all(d.columns == docs.columns for d in out[:5])
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    raw, good, cut, single = ({r.doc_id: r.text for r in d.collect()} for d in (raw, good, cut, single))
    assert set(good) == kept_by_quality(raw, labels) and all(good[i] == raw[i] for i in good)
    assert not {i for i, q in labels if q == 1} & (set(raw) - set(good))
    assert cut == without_chunks(good)
    assert out[2].where(F.length("text") != F.col("n_chars")).count() == 0
    assert set(single) == least_of_near_copies(cut) and all(single[i] == cut[i] for i in single)
    single = out[3]
    assert private.count() == single.count()
    assert not any(slow_spans(r.text) for r in private.collect())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    verify(tokenizer, [(r.doc_id, r.text) for r in private.collect()], pieces.collect(), 2048)


def test_odd_documents_pass_every_stage(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some text here", None, "s", 14), (4, "mail a@b.co " * 40, "en", None, 480), (4, "mail a@b.co " * 40, "en", None, 480)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"n_lines": F.lit(1), "root": F.lit("x"), "fp": F.lit(2), "row": F.lit(3)})
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, frame, "/root/testdata/sf0.001")
            assert found.columns == frame.columns, name
            found.collect()
        corpus_pipeline.STAGES[-1][1](spark, frame, "/root/testdata/sf0.001").collect()


def test_every_operator_is_registered():
    names = set(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert personal_data.ORDER["email"] == 0
