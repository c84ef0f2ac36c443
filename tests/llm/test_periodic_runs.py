import hashlib
import random
import time
import zlib

import numpy as np

from tessera.llm import periodic_runs as R
from tessera.llm.queries import op13_periodic_runs

from .helpers import empty, odd


def brute_runs(words, least=12):
    """All (start, length, period), period by period: maximal stretches whose smallest period it is."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((a, b, q) for (a, b), q in out.items())


def contract(doc_id, text):
    """The query's row, from the contract's words."""
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    listed = "".join(f"{a},{b},{q}\n" for a, b, q in runs)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_random_words_against_all_lags():
    rng = random.Random(3)
    for k in range(1500):
        kind, size = rng.choice((1, 2, 3, 50)), rng.choice((1, 2, 3, 7, 20))
        words = [rng.randrange(kind) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            at, period = rng.randrange(len(words) + 1), [rng.randrange(kind) for _ in range(rng.randrange(1, size + 2))]
            words[at:at] = (period * rng.randrange(1, 14))[: rng.randrange(1, 150)]
        assert R.find_runs(np.array(words, np.int32)) == brute_runs(words), (k, words)


def test_long_lags_are_found_through_equal_blocks(monkeypatch):
    rng = random.Random(5)
    for small in (2, 8, 64):
        monkeypatch.setattr(R, "SMALL", small)
        for _ in range(60):
            kind = rng.choice((1, 2, 4, 300))
            words = [rng.randrange(kind) for _ in range(rng.randrange(300))]
            for _ in range(rng.randrange(1, 4)):
                at, period = rng.randrange(len(words) + 1), [rng.randrange(kind) for _ in range(rng.randrange(1, 160))]
                words[at:at] = (period * 5)[: rng.randrange(2, 5 * len(period) + 1)]
            assert R.find_runs(np.array(words, np.int32)) == brute_runs(words)


def test_fibonacci_words_and_nested_repeats():
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    assert R.find_runs(np.array(b, np.int32)) == brute_runs(b)
    nested = (([1] * 40 + [2]) * 9 + [3]) * 3
    assert R.find_runs(np.array(nested, np.int32)) == brute_runs(nested)


def test_first_planes_do_not_decide():
    words = list(range(200)) + [i + 8 * (i % 3 == 0) for i in range(200)] * 2  # equal in the low bits only at the first seam
    assert R.find_runs(np.array(words, np.int32)) == brute_runs(words)


def test_long_texts_take_time_in_proportion():
    took = []
    for n in (100_000, 400_000):
        one = np.zeros(n, np.int32)
        turns = np.tile(np.arange(1000, dtype=np.int32), n // 1000)
        rare = np.random.default_rng(1).integers(0, 30_000, n).astype(np.int32)
        began = time.time()
        assert R.find_runs(one) == [(0, n, 1)]
        assert R.find_runs(turns) == [(0, n, 1000)]
        assert R.find_runs(rare) == []
        took.append(time.time() - began)
    assert took[1] < 12 * took[0] and took[1] < 20


def test_texts_are_numbered_in_parts(monkeypatch):
    text = " a bb  a\tccc\nbb a\u00a0b ".encode()
    whole = R.numbered(text)
    assert [whole[1][i] for i in whole[0]] == [b"a", b"bb", b"a", b"ccc", b"bb", "a\u00a0b".encode()] and len(whole[1]) == 4
    monkeypatch.setattr(R, "PART", 2)
    again = R.numbered(text)
    assert [again[1][i] for i in again[0]] == [whole[1][i] for i in whole[0]]


def test_query_against_brute_force(spark, sf_dir):
    got = op13_periodic_runs(spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert rows(got) == sorted((contract(r.doc_id, r.text) for r in docs), key=str)


def test_odd_rows(spark, tmp_path):
    docs = odd(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(op13_periodic_runs(spark, str(tmp_path)))
    short = [(r.doc_id, r.text) for r in docs.collect()]
    assert got == sorted((contract(i, t) if len(t or "") < 9999 else next(x for x in got if x[0] == i) for i, t in short), key=str)
    long = next(x for x in got if x[0] == 4)
    assert long[1:5] == (1, 0, 60_000, 1) and long[7] == hashlib.sha256(b"word").hexdigest()
    found = R.runs_of(docs)
    assert found.columns == ["id", "n_words", "runs", "collapsed"] and found.count() == docs.count()
    assert R.runs_of(empty(spark)).count() == 0
