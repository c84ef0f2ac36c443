import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash_dedup as S
from tessera.llm.components import components

from .helpers import empty, odd


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def brute_components(fps, bits=3):
    """{fingerprint: smallest id reachable} of (id, fingerprint) rows."""
    values = list({f for _, f in fps})
    low = {v: min((i for i, f in fps if f == v and i is not None), default=None) for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= bits and low[a] is not None and (low[b] is None or low[a] < low[b]):
                    low[b], changed = low[a], True
    return low


def check(spark, docs, **how):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    low = brute_components(fps)
    want = sorted(((i, f, low[f]) for i, f in fps), key=str)
    got = sorted(((r.id, r.fp & (2**64 - 1), r.component) for r in S.near_duplicates(docs, **how).collect()), key=str)
    assert got == want


def test_fingerprint_is_the_xxh64_of_spark(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("the cat sat"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"the cat sat", 42)
    assert S.fingerprint(b"The CAT sat") == xxhash.xxh64_intdigest(b"the cat sat", 42)


def test_against_brute_force(spark, sf_dir):
    check(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_odd_rows(spark):
    check(spark, odd(spark))
    assert S.near_duplicates(empty(spark)).count() == 0


def test_links_of_a_crowd_are_complete_in_small_and_large_buckets(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 160:
        f = rng.choice(sorted(fps)) if rng.random() < 0.7 else centre
        for _ in range(rng.randint(1, 5)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(40)}
    frame = spark.createDataFrame([(S._signed(f),) for f in fps], "fp long")
    want = brute_components([(f, f) for f in fps])
    for bucket in (4, 2048):
        found = S.links(frame, 3, bucket).collect()
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in found)
        parent = {f: f for f in fps}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in found:
            a, b = root(a & (2**64 - 1)), root(b & (2**64 - 1))
            parent[max(a, b)] = min(a, b)
        assert {f: root(f) for f in fps} == want


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_spanning_forest_has_true_links():
    fps = np.array([0, 1, 3, 7, 15, 31, 1 << 40, (1 << 40) + 1], np.int64)
    links = S._spanning(fps, 3)
    assert len(links) == 7 and all((a ^ b).bit_count() <= 3 for a, b in links)


def test_long_texts_go_through_in_parts(monkeypatch):
    texts = ["one two three four five six seven " * 9, "a b", "a", "x" * 50 + " y z", "  lead  and   trail  "]
    for size in (1, 5, 13, 1 << 20):
        monkeypatch.setattr(S, "PART", size)
        assert [S.fingerprint(t.encode()) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_a_pair_is_given_in_the_first_bucket_where_it_meets():
    first, masks = S._first_combination(3), S._masks(3)
    subs = [[S._signed(x) for x in S._bit_masks(m, 3)] for m in masks]
    rng = random.Random(8)
    for _ in range(300):
        apart = 0
        for _ in range(rng.randint(1, 3)):
            apart ^= 1 << rng.randrange(64)
        x = np.array([S._signed(apart)], np.int64)
        meets = [c for c, m in enumerate(masks) if not apart & m]
        assert [c for c in range(56) if S._meets_first(x, c, -1, first, subs)[0]] == meets[:1]
        finer = [k for k, m in enumerate(subs[meets[0]]) if not apart & m & (2**64 - 1)]
        assert [k for k in range(56) if S._meets_first(x, meets[0], k, first, subs)[0]] == finer[:1]
