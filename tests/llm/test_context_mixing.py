import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import context_mixing as C
from tessera.llm.queries import op12_context_mixing

from .helpers import empty, odd


def words_of(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def brute_base(rows):
    """{row number: (held_out, n_tokens, n_known, N, base)} from the contract's words."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    count = Counter()
    for (_, text), h in zip(rows, held, strict=True):
        if not h:
            count.update([*words_of(text), None])
    total, distinct = sum(count.values()), len(count)
    out = []
    for (_, text), h in zip(rows, held, strict=True):
        tokens = [*words_of(text), None]
        out.append((h, len(tokens), sum(count[t] > 0 for t in tokens), total, sum(math.log10((count[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens)))
    return out


def brute_score(text, model, known):
    """log10 of a text's probability, bit by bit, with dictionaries in place of slots and floats of 64 bits."""
    length, bits, nodes = model.code
    tokens = [*[w + b" " for w in words_of(text)], b"\n"]
    weights, cells, done, total = None, None, 0, 0.0
    last_pair, came, before = {}, 0, None
    for t in tokens:
        guess = last_pair.get(before)
        guess = guess if guess is not None and len(guess) <= C.FORETOLD_BYTES else None
        path = [(s, k) for s in (guess or b"") for k in range(length[s])]
        alive, at = guess is not None, 0
        for pos, s in enumerate(t):
            for k in range(length[s]):
                if done % C.STRETCH == 0:
                    weights, cells = model.weights.astype(float).copy(), model.cells.astype(float).copy()
                y = int(bits[s, k])
                x = []
                for j, order in enumerate(C.ORDERS):
                    context = t[:pos] if order < 0 else t[max(0, pos - order) : pos]
                    zeros, ones = known[j].get((context, int(nodes[s, k])), (0, 0))
                    x.append(float(C.logits(np.array([float(zeros)]), np.array([float(ones)]))[0]))
                x += [0.0] * (C.INPUTS - 2 - len(x))
                says = int(bits[path[at]]) if alive else None
                state = 1 + came if alive else 0
                x += [0.0 if says is None else C.FORETOLD * (2 * says - 1), C.UNIT]
                if done % C.STRETCH % C.TOGETHER == 0:
                    g, moved, kept = state * C.PLACES + min(pos, C.PLACES - 1), np.zeros(C.INPUTS), cells.copy()
                done += 1
                logit = max(-7.9, min(7.9, sum(a * b for a, b in zip(x, weights[g], strict=True))))
                p = 1 / (1 + math.exp(-logit))
                moved += np.array(x) * (y - p) * C.WEIGHT_STEP
                cell = state * C.CELLS + C.CELLS // 2 + math.floor(logit * 1.5)
                q = (p + kept[cell]) / 2
                cells[cell] = kept[cell] + (y - kept[cell]) * C.CELL_STEP
                if done % C.STRETCH % C.TOGETHER == 0:
                    weights[g] += moved
                total += math.log10(q if y else 1 - q)
                if alive:
                    alive = says == y
                    at += 1
        came = int(guess == t)
        last_pair[before], before = t, t
    return total


def contexts(counts, ends, code):
    """By predictor {(context, node): (zeros, ones)} of words that come so often."""
    length, bits, nodes = code
    out = [{} for _ in C.ORDERS]
    for w, n in [*[(w + b" ", n) for w, n in counts.items()], (b"\n", ends)]:
        for pos, s in enumerate(w):
            for j, order in enumerate(C.ORDERS):
                context = w[:pos] if order < 0 else w[max(0, pos - order) : pos]
                for k in range(length[s]):
                    key = (context, int(nodes[s, k]))
                    had = out[j].get(key, (0, 0))
                    out[j][key] = (had[0] + n * (1 - int(bits[s, k])), had[1] + n * int(bits[s, k]))
    return out


def model_of(texts):
    counts = Counter(w for t in texts for w in words_of(t))
    words, n = list(counts), np.array(list(counts.values()), np.int64)
    closed = [w + b" " for w in words]
    bytes_ = np.bincount(np.frombuffer(b"".join(closed), np.uint8), np.repeat(n, C.lengths(closed)), 256).astype(np.int64)
    bytes_[10] += len(texts)
    code = C.huffman(bytes_)
    counted = C.count_bits(closed, n, code) + C.count_bits([b"\n"], np.array([len(texts)]), code)
    weights, cells = C.start_weights()
    weights += np.random.default_rng(1).normal(0, 0.002, weights.shape).astype(np.float32)
    return C.Model(code, np.stack([C.logits(*c) for c in counted]), weights, cells, int(n.sum()) + len(texts), len(words) + 1, len(texts)), contexts(counts, len(texts), code)


def scores(texts, model):
    words, tokens, bounds = C._numbered([(t or "").encode() for t in texts])
    tokens, bounds = C._ended(tokens, bounds, np.ones(len(texts), bool), len(words))
    return C._scored(words, np.ones(len(words) + 1), tokens, bounds, model)["score"]


def test_code_is_a_prefix_code_of_all_bytes():
    for counts in (np.zeros(256, np.int64), np.arange(256) ** 3, np.where(np.arange(256) == 97, 10**6, 0)):
        length, bits, nodes = C.huffman(counts)
        assert sum(0.5 ** int(n) for n in length) == 1
        paths = {tuple(bits[s, : length[s]]) for s in range(256)}
        assert len(paths) == 256 and len(np.unique(nodes)) == 255
        for s in range(256):  # a node stands for the bits read up to it
            for k in range(length[s]):
                assert all(tuple(bits[o, :k]) == tuple(bits[s, :k]) for o in range(256) if length[o] > k and nodes[o, k] == nodes[s, k])


def test_scores_against_one_bit_after_another(monkeypatch):
    """Slots are many here, so that few contexts share one; a short stretch makes weights start anew often."""
    rng = random.Random(2)
    vocabulary = [b"the", b"of", b"an", b"and", b"hand", b"x" * 70, "déjà".encode(), b"q"]
    texts = [" ".join(rng.choice(vocabulary).decode() for _ in range(rng.randrange(60))) for _ in range(30)]
    texts += ["", None, "the of The of the of the OF the of an", "an " * 200, "unseen words 漢 here"]
    monkeypatch.setattr(C, "SLOTS", 1 << 22)
    model, known = model_of(texts[:-1])
    for stretch in (100, 2048):
        monkeypatch.setattr(C, "STRETCH", stretch)
        want = [brute_score(t, model, known) for t in texts]
        assert np.allclose(scores(texts, model), want, rtol=1e-4, atol=1e-3)


def test_a_text_is_scored_alike_in_any_company(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(("ab", "abc", "b", "cab", "zz")) for _ in range(rng.randrange(300))) for _ in range(40)]
    model, _ = model_of(texts)
    together = scores(texts, model)
    assert np.allclose([scores([t], model)[0] for t in texts], together, rtol=1e-6)
    monkeypatch.setattr(C, "SOME", 10)
    monkeypatch.setattr(C, "GROUP", 50)
    assert np.allclose(scores(texts, model), together, rtol=1e-6)


def test_bits_are_laid_out_some_at_a_time(monkeypatch):
    """Of one long text too, with the scores of all its bits laid out at once."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(("ab", "abc", "b" * 3000, "cab", "zz")) for _ in range(n)) for n in (400, 3, 0, 60)]
    model, _ = model_of(texts)
    want, had, mix_some = scores(texts, model), [], C._mix_some
    monkeypatch.setattr(C, "SIDE_BY_SIDE", 2)
    monkeypatch.setattr(C, "_mix_some", lambda inputs, *rest: had.append(len(inputs)) or mix_some(inputs, *rest))
    assert np.allclose(scores(texts, model), want, rtol=1e-6)
    assert max(had) <= 10 * C.STRETCH < 327_945 / 10  # all bits of the longest; words of 3,000 bytes are longer than that
    monkeypatch.setattr(C, "HELD", 1000)
    assert np.allclose(scores(texts, model), want, rtol=1e-6)


def test_words_are_spelled_and_counted_without_copies(monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(C, "SOME", 1 << 12)
    words = [f"{rng.randrange(10**9):x} ".encode() for _ in range(40_000)]
    code = C.huffman(np.ones(256, np.int64))
    tracemalloc.start()
    try:
        own = C.spelled(words, code, lambda k, slots, bit: bit)
        assert tracemalloc.get_traced_memory()[1] < 1.3 * (own.inputs.nbytes + own.bit.nbytes)
        out = np.zeros((len(C.ORDERS), 2, C.SLOTS))
        tracemalloc.reset_peak()
        had = tracemalloc.get_traced_memory()[0]
        C.count_bits(words, np.ones(len(words), np.int64), code, out)
        assert tracemalloc.get_traced_memory()[1] < had + out.nbytes / 8
    finally:
        tracemalloc.stop()
    assert (out == C.count_bits(words, np.ones(len(words), np.int64), code)).all() and out.sum() == len(C.ORDERS) * len(own.bit)


def test_probabilities_of_a_bit_add_up_to_one():
    """Of all words of one byte, any of which could follow, and of longer ones, no more than the whole is given out."""
    model, _ = model_of(["a b a c a b"] * 5)
    words = [bytes([i]) for i in range(256) if i not in b" \t\n\v\f\r"]
    closed = C._closed(words)
    own = C.spelled(closed, model.code, lambda k, slots, bit: model.tables[k][slots])
    n = len(closed)
    p = 10 ** C.bit_logs(own, closed, np.arange(n), np.arange(n + 1), model)
    assert 0.9 < p.sum() <= 1 + 1e-6


def test_contexts_reach_back_within_their_word_only():
    code = C.huffman(np.ones(256, np.int64))
    alone, behind = C.spell([b"word "], code)[3], C.spell([b"another ", b"word "], code)[3]
    for a, b in zip(alone, behind, strict=True):
        assert (a == b[-len(a) :]).all()
    long = C.spell([b"x" * (2 * C.LONG) + b" "], code)
    half = int(long[0][0]) // 2
    assert all((s[: C.LONG] == s[half - (half - int(code[0][120]) * C.LONG) :][: C.LONG]).all() for s in long[3])


def test_query_against_the_contract(spark, sf_dir):
    got = op12_context_mixing(spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = {r.doc_id: r for r in got.collect()}
    assert len(found) == len(docs)
    for (i, text), want in zip(docs, brute_base(docs), strict=True):
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4] and math.isclose(r.base_score, want[4], rel_tol=1e-9)
        assert r.score < 0


@pytest.fixture(scope="module")
def large():
    return "/root/testdata/sf0.01"


def test_first_weights_come_from_every_word(spark):
    """A step of Newton's method over all bits of all words, each as often as it occurs, however they are dealt."""
    rng = random.Random(8)
    counts = {f"{rng.choice('abc')}{rng.choice(('', 'an', 'xyz'))}{i}".encode(): rng.randrange(1, 50) for i in range(300)}
    counts[b"w" * 30_000], ends = 7, 400  # longer than any text that a sample of short ones holds
    closed, n = [w + b" " for w in counts], np.array(list(counts.values()), np.int64)
    code = C.huffman(np.bincount(np.frombuffer(b"".join(closed), np.uint8), minlength=256))
    counted = C.count_bits(closed, n, code) + C.count_bits([b"\n"], np.array([ends]), code)
    used, first = [*range(len(C.ORDERS)), C.INPUTS - 1], C.start_weights()[0]
    weights = first[: C.PLACES, used].astype(float)
    for _ in range(C.ROUNDS):
        slopes, curves = np.zeros(weights.shape), np.zeros((*weights.shape, len(used)))
        for word, often in [*zip(closed, n.tolist(), strict=True), (b"\n", ends)]:
            _, bit, where, slots = C.spell([word], code)
            for i, y in enumerate(bit.tolist()):
                seen = [counted[k, :, s[i]] - (np.arange(2) == y) for k, s in enumerate(slots)]
                x = np.array([*[C.logits(*c) for c in seen], C.UNIT], float)
                p = 1 / (1 + math.exp(-max(-7.9, min(7.9, weights[where[i]] @ x))))
                slopes[where[i]] += often * (y - p) * x
                curves[where[i]] += often * p * (1 - p) * np.outer(x, x)
        for place in range(C.PLACES):
            hold = C.HOLD * np.trace(curves[place]) / len(used)
            weights[place] += np.linalg.solve(curves[place] + hold * np.eye(len(used)), slopes[place] + hold * (first[place, used] - weights[place]))
    for parts in (1, 5):
        known = spark.createDataFrame([(bytearray(w), c) for w, c in counts.items()], "word binary, n long").repartition(parts)
        got = C.fit(known, ends, code, counted)[0]
        assert np.allclose(got[:, used], np.tile(weights, (C.STATES, 1)), rtol=1e-3, atol=1e-5)
        assert (got[:, C.INPUTS - 2] == first[:, C.INPUTS - 2]).all() and not np.allclose(got[:, used], first[:, used], atol=1e-3)


def test_numbers_of_words():
    rng = random.Random(4)
    for texts in ([], [b""], [b" \x0b", b"a"], [bytes(rng.choice(b" \t\n\x0b\x0c\rabA\x00\x1c\x1f") for _ in range(rng.randrange(30))) for _ in range(500)]):
        words, tokens, bounds = C._numbered(texts)
        assert [[words[k] for k in tokens[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)] == [t.lower().split() for t in texts]
        assert words == list(dict.fromkeys(w for t in texts for w in t.lower().split()))


def test_held_out_texts_are_foretold(spark, large):
    """Bits a byte on held-out documents against an order-0 code, and shuffled letters against the texts themselves."""
    docs = spark.read.parquet(f"{large}/documents.parquet").where("length(text) < 6000").select("doc_id", "text")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1
    own = C.score(docs, held).where("held_out").agg(F.sum("score").alias("s"), F.sum("n_bytes").alias("n")).first()
    assert -own.s / math.log10(2) / own.n < 2.6
    turned = F.when(held, F.reverse("text")).otherwise(F.col("text"))
    other = C.score(docs.withColumn("text", turned), held).where("held_out").agg(F.sum("score").alias("s"), F.sum("n_bytes").alias("n")).first()
    assert other.s / other.n < 1.3 * own.s / own.n


def test_odd_rows_and_parts_of_long_texts(spark, tmp_path, monkeypatch):
    docs = odd(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(((i, *x[:4], round(x[4], 6)) for (i, _), x in zip(rows, brute_base(rows), strict=True)), key=str)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_context_mixing(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    same = {r.score for r in got if r.doc_id in (1, 2, 3)}
    assert len(same) == 1 and all(r.score < 0 for r in got)
    assert C.score(empty(spark), F.lit(False)).count() == 0
    none = C.score(docs, F.lit(True)).collect()  # nothing to learn from
    assert len(none) == len(rows) and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in none)
    few = C.score(docs, F.col("doc_id") % 5 == 1, block=1000).collect()  # the long text in 300 parts
    whole = C.score(docs, F.col("doc_id") % 5 == 1).collect()
    plain = lambda x: sorted(((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.n_bytes, round(r.base_score, 6)) for r in x), key=str)
    assert plain(few) == plain(whole)
