import re
import zlib
from collections import Counter
from math import log

import pytest

from tessera.llm import quality_rules as Q

from .helpers import empty, odd


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if twice[x] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def brute_features(text):
    h = [zlib.crc32(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return [x % Q.BUCKETS for x in h] + [(a * Q.PAIR + b) % Q.BUCKETS for a, b in zip(h, h[1:], strict=False)]


def check(docs, trusted):
    judged, name = Q.judge(docs, trusted)
    rows = judged.select("doc_id", "text", f"{name}.*").collect()
    good = {r[0] for r in trusted.collect()} - {None}
    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(f := brute_features(r.text))
        if r.doc_id in good:
            target.update(f)
    n_raw, n_target = sum(raw.values()) + Q.BUCKETS, sum(target.values()) + Q.BUCKETS
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
        f = brute_features(r.text)
        mean = sum(log((target[x] + 1) / n_target) - log((raw[x] + 1) / n_raw) for x in f) / max(1, len(f))
        assert r.llr == pytest.approx(mean, abs=1e-9)
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.llr >= Q.THRESHOLD)


def test_against_brute_force(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.where("quality = 1 and toxic = 0").select("doc_id"))


def test_odd_rows(spark):
    nobody = spark.createDataFrame([], "doc_id long")
    check(odd(spark), nobody)
    check(odd(spark), spark.createDataFrame([(5,), (5,), (None,)], "doc_id long"))
    assert Q.keep_good(empty(spark), nobody).count() == 0
    assert Q.keep_good(odd(spark), nobody).columns == odd(spark).columns


def test_repeats_of_any_shape(spark):
    words = "a b c d e f g h".split()
    texts = [" ".join(words * k) for k in (1, 2, 3, 40)] + ["z " * 9, "z " * 8, "z " * 200, " ".join(words) + " x " + " ".join(words), " ".join(words) + " y z " + " ".join(words[1:]) + " q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(docs, docs.select("doc_id"))


def test_native_plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = Q.judge(docs, docs.select("doc_id"))[0]._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_words_with_equal_checksums_are_different_words(spark, monkeypatch):
    assert zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo")
    texts = ["a b c plumless d e f g a b c buckeroo d e f g", "a b c plumless d e f g a b c plumless d e f g", "x " + "a b c d e f g h " * 3 + "y " + "a b c d e f g i " * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(docs, docs.select("doc_id"))
    monkeypatch.setattr(Q.F, "xxhash64", lambda *cols: Q.F.lit(7).cast("long"))  # all windows agree in their hash
    check(docs, docs.select("doc_id"))


def test_the_filter_computes_a_text_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = Q.keep_good(docs, docs.select("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("crc32") == 1 and not re.search("Python|Pandas|Arrow", plan)
