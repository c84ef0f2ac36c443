import math

import numpy as np

from tessera.llm import attention_quality as A
from tessera.llm import queries

from .helpers import empty, odd


def test_held_out_accuracy(spark):
    found = queries.op2_attention_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = [r for r in found.join(labels, "doc_id").collect() if r.held_out]
    good, bad = [r.predicted for r in rows if r.quality == 1], [r.predicted for r in rows if r.quality == 0]
    assert len(rows) > 80 and np.mean(good) > 0.97 and np.mean(bad) < 0.15
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_attention_sums_to_one_and_finds_the_odd_passage():
    rng = np.random.default_rng(3)
    fine = lambda n: " ".join(rng.choice(["the", "and", "house", "tree", "runs", "over"], n))
    texts, y = [], []
    for i in range(120):
        junk = i % 2
        parts = [fine(50) for _ in range(3)] + ([" ".join(["$$$###"] * 50)] if junk else [fine(50)])
        texts.append(" ".join(parts).encode())
        y.append(1 - junk)
    m = A.Model(0.5).fit(*A.bags(texts), np.array(y, np.float32))
    score, attention = m.score(texts)
    assert ((score >= 0.5) == np.array(y)).mean() > 0.95
    assert all(abs(sum(a) - 1) < 1e-5 and len(a) == 4 for a in attention)


def small_model(rng):
    draw = lambda *s: rng.standard_normal(s) * 0.5
    return {"W": draw(A.WIDTH, 4), "b": draw(4), "V": draw(4, 3), "U": draw(4, 3), "w": draw(3, 1), "c": draw(4, 1), "d": draw(1)}


def looped_score(w, bag):
    """One bag's score and attention, passage by passage and number by number."""
    sums, hidden = [], []
    for x in bag:
        h = [math.tanh(sum(x[i] * w["W"][i, k] for i in range(len(x))) + w["b"][k]) for k in range(w["W"].shape[1])]
        dot = lambda m, g, h=h: sum(h[k] * m[k, g] for k in range(len(h)))
        hidden.append(h)
        sums.append(sum(w["w"][g, 0] * math.tanh(dot(w["V"], g)) / (1 + math.exp(-dot(w["U"], g))) for g in range(w["V"].shape[1])))
    e = [math.exp(s) for s in sums]
    attention = [x / sum(e) for x in e]
    pooled = [sum(a * h[k] for a, h in zip(attention, hidden, strict=True)) for k in range(len(hidden[0]))]
    return 1 / (1 + math.exp(-sum(z * c for z, c in zip(pooled, w["c"][:, 0], strict=True)) - w["d"][0])), attention


def test_forward_against_a_loop_and_gradient_by_differences():
    rng = np.random.default_rng(0)
    counts, y = np.array([2, 3, 1, 4]), np.array([0, 1, 1, 0], float)
    x, w = rng.standard_normal((int(counts.sum()), A.WIDTH)) * 0.3, small_model(rng)
    at, bag = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
    *_, a, _, p = A.Model._forward(w, x, at, bag)
    for i, rows in enumerate(np.split(x, at[1:])):
        score, attention = looped_score(w, rows)
        assert abs(p[i] - score) < 1e-9 and np.allclose(a[bag == i, 0], attention)

    def loss(weights):
        p = A.Model._forward(weights, x, at, bag)[5]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    found = A.Model._gradient(w, x, at, bag, y)
    for k, value in w.items():
        for place in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(6)]:
            moved = [{**w, k: value.copy()} for _ in range(2)]
            moved[0][k][place] += 1e-5
            moved[1][k][place] -= 1e-5
            assert abs((loss(moved[0]) - loss(moved[1])) / 2e-5 - found[k][place]) < 1e-6, k


def test_odd_rows(spark):
    labels = spark.createDataFrame([(4, 0, 0), (5, 1, 0), (9, 1, 0), (8, 0, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    for model in (A.train(odd(spark), labels), A.train(odd(spark), labels.where("quality = 1")), A.train(empty(spark), labels.limit(0))):
        rows = A.score(odd(spark), model).collect()
        assert len(rows) == 10 and all(0 <= r.score <= 1 and abs(sum(r.attention) - 1) < 1e-3 for r in rows)
        assert len({r.score for r in rows if r.id in (1, 2, 3)}) == 1 and len({r.score for r in rows if r.id in (5, 9)}) == 1
        assert A.score(empty(spark), model).count() == 0


def test_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(A, "PART", 100)
    x, counts = A.bags([b"word " * 1000, b"y" * 1000, b""])
    assert counts[0] == 50 and counts[2] == 1 and len(x) == counts.sum()
