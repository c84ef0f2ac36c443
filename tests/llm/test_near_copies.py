import random

import numpy as np
import pytest

from tessera.llm import near_copies as N
from tessera.llm import simhash_dedup as S

from .helpers import empty, odd


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def grams(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_groups(rows, meet=True):
    """[smallest id reachable] of (id, text) rows, by all pairs of texts that are alike and, unless told otherwise, meet in a band."""
    sets = [grams(t) for _, t in rows]
    keys = [words(t) for _, t in rows]
    bands = [set(enumerate(N.bands(N.shingles((t or "").encode())[1]))) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            near = bool(sets[i] and sets[j]) and (not meet or bool(bands[i] & bands[j])) and jaccard(sets[i], sets[j]) >= 0.8 - 1e-9
            if keys[i] == keys[j] or near:
                parent[root(i)] = root(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[root(i)] = min(k, low.get(root(i), k))
    return [low.get(root(i)) for i in range(len(rows))]


def edited(rng, own, vocabulary):
    """Copies of a text by kind of edit, of more and less strength."""
    n, edited.base = len(own), own
    for rate in (0.004, 0.01, 0.02, 0.03):
        copy = list(own)
        for i in rng.sample(range(n), max(1, round(rate * n))):
            copy[i] = rng.choice(vocabulary)
        yield "replaced", copy
    for share in (0.05, 0.1, 0.15):
        yield "cut", own[: round((1 - share) * n)]
        yield "appended", own + rng.choices(vocabulary, k=round(share * n))
        a, size = rng.randrange(max(1, round((1 - share) * n))), round(share * n)
        left = own[:a] + own[a + size :]
        b = rng.randrange(len(left) + 1)
        yield "moved", left[:b] + own[a : a + size] + left[b:]


@pytest.mark.parametrize("low,high", [(20, 60), (60, 600), (600, 4000)])
def test_planted_copies_are_found_whatever_the_edit(spark, low, high):
    """Recall of 0.9 at a similarity of 0.8 or more for replaced, cut, appended and moved words; nothing below is joined."""
    rng = random.Random(high)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, pairs = [], []
    for _ in range(40 if high < 4000 else 15):
        size = rng.randint(low, high)
        for kind, copy in edited(rng, rng.choices(vocabulary, k=size), vocabulary):
            own = [w for w in copy]
            fresh = dict(zip(vocabulary, rng.sample(vocabulary, len(vocabulary)), strict=True))  # each pair has words of its own order
            pairs.append((kind, len(rows), len(rows) + 1))
            rows += [(len(rows), None), (len(rows) + 1, " ".join(fresh[w] for w in own))]
            rows[-2] = (rows[-2][0], " ".join(fresh[w] for w in edited.base))
    sets = [grams(t) for _, t in rows]
    found = {r.id: r.component for r in N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in ("replaced", "cut", "appended", "moved"):
        hits = [found[a] == found[b] for k, a, b in pairs if k == kind and jaccard(sets[a], sets[b]) >= 0.8]
        print(low, high, kind, len(hits), np.mean(hits))
        assert (len(hits) > 20 or (low, kind) == (20, "moved")) and np.mean(hits) >= 0.9
    assert all(found[a] != found[b] for _, a, b in pairs if jaccard(sets[a], sets[b]) < 0.8)
    assert all(c in (i, i - 1) for i, c in found.items())


def test_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.id: r.component for r in N.near_copies(docs).collect()}
    assert [got[i] for i, _ in rows] == brute_groups(rows)
    assert {r.doc_id for r in N.keep_one(docs).collect()} == {i for i, c in got.items() if i == c}


def test_the_simhash_index_finds_what_no_band_does(spark):
    """Every text has bands of its own here; what meets is verified all the same, as is what meets by chance."""
    rng = random.Random(6)
    rows = []
    for i in range(60):
        own = [f"w{rng.randrange(9000)}" for _ in range(600)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own[:-1], "other"]))]
    found = [N.shingles(t.encode()) for _, t in rows]
    fps = [N.simhash(h) for _, h in found]
    fps[1], fps[2] = fps[0], fps[0]  # the next pair's by chance
    reps = [(bytearray(k), i, fps[i], [i * 10 + 1, i * 10 + 2]) for i, (k, _) in enumerate(found)]
    frame = spark.createDataFrame(reps, "key binary, rep long, fp long, bands array<long>")
    name = {k: i for i, (k, _) in enumerate(found)}
    how = {"id_col": "doc_id", "text_col": "text", "shingle": 5}
    got = {tuple(sorted((name[bytes(r.u)], name[bytes(r.v)]))) for r in N._edges(spark.createDataFrame(rows, "doc_id long, text string"), frame, 0.8, N.CROWD, how).collect()}
    near = {(i, i + 1) for i in range(0, 120, 2) if (fps[i] ^ fps[i + 1]).bit_count() <= N.BITS}
    assert got == near and 30 < len(near)


def test_simhash_is_the_majority_of_bits():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 255, 256, 1000):
        hashes = rng.integers(0, 2**64, n, dtype=np.uint64)
        want = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > n)
        assert N.simhash(hashes) % 2**64 == want


def test_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in odd(spark).collect()]
    got = sorted(((r.id, r.component) for r in N.near_copies(odd(spark)).collect()), key=str)
    assert got == sorted(((i, c) for (i, _), c in zip(rows, brute_groups(rows), strict=True)), key=str)
    assert N.near_copies(empty(spark)).count() == 0 and N.keep_one(empty(spark)).count() == 0


def test_keep_one_keeps_one_row_of_each_group_and_all_columns(spark):
    docs = odd(spark)
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, 5, 7, 8, None]  # 2 and 3 are empty like 1, 5 is there twice, 9 copies it
    rows = [(5, "one text of several words"), (5, "another text with other words in it"), (5, "One TEXT of several words"), (3, "another text with other words in it"), (None, "a b c"), (None, "d e f"), (None, "a b c")]
    found = N.keep_one(spark.createDataFrame([(*r, {"k": 1}) for r in rows], "doc_id long, text string, m map<string,int>")).collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == [(3, rows[1][1]), (5, "One TEXT of several words"), (None, "a b c"), (None, "d e f")]


def test_a_crowd_of_near_copies_in_chunks(spark):
    """One bucket of hundreds, dealt into chunks: the same groups as in one piece, and as by all pairs."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 600):
        copy = list(base)
        for _ in range(1 if i % 5 else 9):
            copy[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    chain = list(base)
    for i in range(600, 640):  # step by step away from the crowd
        for _ in range(4):
            chain[rng.randrange(300)] = f"y{i}"
        rows.append((i, " ".join(chain)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = dict(zip([i for i, _ in rows], brute_groups(rows), strict=True))
    for crowd in (40, 2048):
        assert {r.id: r.component for r in N.near_copies(frame, crowd=crowd).collect()} == want
    assert sorted(r.doc_id for r in N.keep_one(frame, crowd=40).collect()) == sorted(set(want.values()))


def test_forest_connects_what_all_pairs_connect():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sets = [np.unique(rng.integers(0, 40, rng.integers(1, 25)).astype(np.uint64)) for _ in range(rng.integers(1, 30))]
        limit = rng.choice([0.3, 0.5, 0.8])
        near = lambda a, b, sets=sets: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
        found = N.forest(sets, limit)
        assert len(found) < len(sets) and all(near(a, b) >= limit - 1e-9 for a, b in found)

        def groups(pairs, n=len(sets)):
            parent = list(range(n))

            def root(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in pairs:
                parent[max(root(a), root(b))] = min(root(a), root(b))
            return [root(i) for i in range(n)]

        assert groups(found) == groups([(a, b) for a in range(len(sets)) for b in range(a) if near(a, b) >= limit - 1e-9])


def test_signatures_in_parts_and_of_equal_words(monkeypatch):
    text = ("One two three four five six seven. " * 40 + "end of it").encode()
    key, own = N.shingles(text)
    again = N.shingles(text.lower().replace(b" ", b"\n\t "))
    assert again[0] == key == N.exact_key(text) and (again[1] == own).all() and len(own) == len(grams(text.decode()))
    monkeypatch.setattr(S, "PART", 23)
    assert N.shingles(text)[0] == key and (N.shingles(text)[1] == own).all()
    assert N.bands(N.shingles(b"")[1]) == [] and len(N.bands(N.shingles(b"a b")[1])) == N.BANDS
    assert N.shingles(b"a b")[0] != N.shingles(b"b a")[0]
