import random

import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import simhash_dedup as S
from quarry.llm.components import connected_components


def slow_fingerprint(text, words=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    tokens = [w for w in __import__("re").split("[ \t-\r]+", lower) if w]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, radius):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def near(rng, base, bits):
    for b in rng.sample(range(64), bits):
        base ^= 1 << b
    return base


def test_fingerprint_equals_brute_force():
    rng = random.Random(1)
    texts = ["", "  \n", "One", "one TWO", "É A\xa0b  c\x1cd\te\x0bf", "a b c " * 50]
    texts += [" ".join(rng.choice("aA bé0") * rng.randint(1, 3) for _ in range(rng.randint(0, 40))) for _ in range(100)]
    for words in (3, 5):
        for t in texts:
            assert S.fingerprint(t, words) & (1 << 64) - 1 == slow_fingerprint(t, words)
    assert S.fingerprint(None) == 0


def test_blocks_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(map(str, range(500)))
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "BLOCK", 7)
    assert S.fingerprint(text) == whole


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(2)
    for radius in (1, 2, 3, 6):
        masks = [m & (1 << 64) - 1 for m in S.covering_masks(radius)]
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(300):
            difference = near(rng, 0, rng.randint(1, radius))
            assert any(m & difference == 0 for m in masks)


def check_links(spark, values, radius, large):
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    links = S.fingerprint_links(df, radius, large)
    assert all((r.a ^ r.b & (1 << 64) - 1).bit_count() <= radius or ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= radius for r in links.collect())
    found = {r.node: r.root for r in connected_components(links, "a", "b").collect()}
    want = components(values, radius)
    groups = lambda m: sorted(sorted(v for v in values if m[v] == r) for r in set(m.values()))
    assert groups({v: found.get(signed(v), signed(v)) for v in values}) == groups(want)


def test_links_connect_what_all_pairs_connect(spark):
    rng = random.Random(3)
    values = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        values |= {near(rng, base, rng.randint(0, 4)) for _ in range(8)}
    check_links(spark, sorted(values), 3, S.LARGE_BUCKET)


def test_large_buckets_are_linked_exactly(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    values = sorted({near(rng, base, rng.randint(0, 3)) for _ in range(40)} | {rng.getrandbits(64) for _ in range(20)})
    check_links(spark, values, 3, 2)


def test_groups_of_odd_rows(spark):
    rows = [(1, "a b c d"), (2, "A B C D"), (3, None), (4, ""), (4, ""), (None, "x y z"), (None, None), (9, "x y z"), (7, "w " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("id", F.lit("clash"))
    found = sorted(((r.doc_id, r.component_id, r.fingerprint) for r in S.simhash_groups(df).collect()), key=repr)
    assert len(found) == len(rows)
    by_id = {(i, f): c for i, c, f in found}
    assert {c for (i, _), c in by_id.items() if i in (1, 2)} == {1}
    assert by_id[3, "0" * 16] == by_id[4, "0" * 16] == by_id[None, "0" * 16] == 3
    assert {c for (i, f), c in by_id.items() if f == by_id and i} == set()
    assert [c for i, c, f in found if i in (None, 9) and f != "0" * 16] == [9, 9]
    assert S.simhash_groups(df.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (5, "q w e r t y"), (5, "q w e r t y"), (None, "lone some text of null id"), (8, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit(0))
    kept = S.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 5), (False, 8), (True, 0)]
    assert S.keep_one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize("in_a_task", [1 << 18, 40])  # all links in one task; contracted in parts, then in rounds
def test_components_of_a_long_path_and_a_star(spark, in_a_task):
    path = [(i, i + 1) for i in range(1, 200)]
    star = [(1000, 1000 + i) for i in range(1, 100)]
    rows = [*path, *star, (5, 5), (None, 3), (2, 1), (2, 1), (1100, None), (-7, -9)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(rows, "a long, b long"), "a", "b", in_a_task=in_a_task).collect()}
    assert found == {i: 1 for i in range(1, 201)} | {1000 + i: 1000 for i in range(100)} | {-7: -9, -9: -9}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b", in_a_task=in_a_task).count() == 0


@pytest.mark.parametrize("in_a_task", [1 << 18, 60])
def test_components_of_random_links_between_binary_nodes(spark, in_a_task):
    rng = random.Random(5)
    name = lambda i: (i * 2654435761 % (1 << 32)).to_bytes(4, "big")  # noqa: E731  bytes above and below 0x80
    pairs = [(name(rng.randrange(300)), name(rng.randrange(300))) for _ in range(220)]
    root = {v: v for pair in pairs for v in pair}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    found = connected_components(spark.createDataFrame(pairs, "a binary, b binary"), "a", "b", in_a_task=in_a_task).collect()
    linked = {v for a, b in pairs if a != b for v in (a, b)}
    assert {bytes(r.node): bytes(r.root) for r in found} == {v: root[v] for v in linked} and len(found) == len(linked)
