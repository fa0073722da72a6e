import random

import numpy as np
import xxhash

from pyspark.sql import functions as F

from quarry.llm import near_copies as N


def slow_shingles(text, words=5):
    tokens = [w for w in __import__("re").split("[ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1


def least_of_each(rows):
    sets = {i: slow_shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in sets:
        for b in sets:
            if a < b and jaccard(sets[a], sets[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(i for i in sets if root[i] == i)


def changed(rng, words, n):
    """``words`` with n of them replaced, at places five apart at least."""
    out = list(words)
    for i in rng.sample(range(0, len(words), 5), n):
        out[i] = f"new{rng.getrandbits(40)}"
    return out


def text(rng, n):
    return [f"w{rng.getrandbits(30)}" for _ in range(n)]


def test_planted_near_copies_go_and_templated_pages_stay(spark):
    rng = random.Random(1)
    rows = []
    for g in range(40):  # similarity about 0.82 to the first
        base = text(rng, 400)
        rows += [(10 * g, base), (10 * g + 1, changed(rng, base, 8))]
    template = text(rng, 400)  # pairs at 0.6 to 0.75
    rows += [(1000 + i, changed(rng, template, 8)) for i in range(60)]
    rows = [(i, " ".join(w)) for i, w in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in N.without_near_copies(docs).collect())
    want = least_of_each(rows)
    assert got == want and len(want) == 40 + 60


def test_a_text_whose_neighbours_fail_finds_another_link(spark):
    rng = random.Random(2)
    base = text(rng, 500)
    rows = [(i, " ".join(changed(rng, base, rng.randint(3, 8)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in N.without_near_copies(docs).collect()) == least_of_each(rows)


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in N.without_near_copies(docs).collect()) == least_of_each(rows)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (5, "q w"), (5, "q w"), (None, "lone text of a null id"), (8, None), (9, ""), (7, "w " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"root": F.lit(0), "node": F.lit("x"), "key": F.lit(1)})
    kept = N.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 5), (False, 7), (False, 8), (True, 0)]
    assert N.without_near_copies(docs.limit(0)).count() == 0


def test_no_text_goes_without_a_near_copy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: slow_shingles(r.text) for r in docs.collect()}
    gone = set(sets) - {r.doc_id for r in N.without_near_copies(docs).collect()}
    assert gone and all(any(jaccard(sets[i], sets[j]) >= 0.8 for j in sets if j != i) for i in gone)


def test_a_large_family_takes_few_pairs_and_loses_no_link(spark, monkeypatch):
    """Variants of one text whose similarities lie around 0.8: many pairs are near, outliers are near to none."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(400):
        words = list(base)
        for at in rng.choice(150, rng.integers(0, 7), replace=False):
            words[at] = f"own{i}x{at}"
        texts.append(" ".join(words))
    pairs, real = [], N._confirmed

    def counted(found, *more):
        pairs.append(found.count())
        return real(found, *more)

    monkeypatch.setattr(N, "_confirmed", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in N.without_near_copies(docs).collect()}
    sets = [N.shingles(t, 5) for t in texts]
    root = list(range(400))
    for i in range(400):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 10 * common >= 8 * (len(sets[i]) + len(sets[j]) - common) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert got == set(root) and 20 < len(got) < 380
    assert sum(pairs) < 400 * 40


def test_number_of_partitions_changes_nothing(spark):
    """Pairs just above the threshold, which share few buckets, however the buckets are dealt to ranges."""
    rng = random.Random(7)
    rows = []
    for g in range(12):
        base = text(rng, 130)
        other = list(base)
        other[rng.randrange(5, 60)] = "one"
        other[rng.randrange(70, 125)] = "two"
        rows += [(10 * g, base), (10 * g + 1, other)]
    rows = [(i, " ".join(w)) for i, w in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = least_of_each(rows)
    assert 12 <= len(want) < 24
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 7, 64, 211):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert sorted(r.doc_id for r in N.without_near_copies(docs).collect()) == want, n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_neighbours_across_ranges(spark):
    rows = [(k, n, bytes([k, n])) for k in range(6) for n in range(1, 9)]
    keyed = spark.createDataFrame(rows, "key long, n long, node binary")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 5, 48, 100):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = sorted((bytes(r.a), bytes(r.b)) for r in N._met(keyed).collect())
            assert got == [(bytes([k, n]), bytes([k, n + 1])) for k in range(6) for n in range(1, 8)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def distance(a, b):
    """Bits in which the fingerprints of two texts differ, from all hashes of their shingles."""
    prints = []
    for t in (a, b):
        hashes = [xxhash.xxh64_intdigest(" ".join(s)) for s in slow_shingles(t)]
        prints.append(sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes)))
    return (prints[0] ^ prints[1]).bit_count()


def test_fingerprints_find_near_copies_that_share_no_band(spark):
    """Pairs of exactly 0.8 within six bits, of which no band of minima agrees."""
    rows = []
    for seed in (3595, 11277, 13717):
        rng = random.Random(seed)
        base = text(rng, 44)
        rows += [(2 * seed, " ".join(base)), (2 * seed + 1, " ".join(base + text(rng, 10)))]
    for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True):
        assert jaccard(slow_shingles(a), slow_shingles(b)) == 0.8 and distance(a, b) <= 6
        assert not set(N.sketch(a, 5)[-1]) & set(N.sketch(b, 5)[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in N.without_near_copies(docs).collect()) == [i for i, _ in rows[::2]]


def test_covering_tables_alone_miss_no_near_copies_within_the_radius(spark):
    rng = random.Random(9)
    rows = []
    for g in range(30):
        base = text(rng, 120)
        rows += [(10 * g + k, " ".join(changed(rng, base, k))) for k in range(4)]
    docs = spark.createDataFrame(rows, "id long, text string")
    who = F.struct("id", F.xxhash64("text").alias("mark")).alias("who")
    found = docs.select(who, "text")
    classes = N._classes(found, 5).withColumn("keys", F.array().cast("array<long>"))
    ids = {r.node: r.who.id for r in classes.collect()}
    links = [(ids[r.a], ids[r.b]) for r in N._links(classes, found, 5).collect()]
    texts, root = dict(rows), {i: i for i in ids.values()}
    assert len(root) == len(rows) and all(jaccard(slow_shingles(texts[a]), slow_shingles(texts[b])) >= 0.8 for a, b in links)
    for _ in rows:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    near = [(a, b) for g in range(30) for a in range(10 * g, 10 * g + 4) for b in range(a + 1, 10 * g + 4) if jaccard(slow_shingles(texts[a]), slow_shingles(texts[b])) >= 0.8]
    within = [(a, b) for a, b in near if distance(texts[a], texts[b]) <= 6]
    assert 20 < len(within) < len(near) and all(root[a] == root[b] for a, b in within)
