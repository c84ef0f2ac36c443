import random

import numpy as np
import pytest
import regex

from tessera.llm import language_id as L
from tessera.llm import queries

from .helpers import empty, odd


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return L.train(docs)


def words(model, text):
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    letter, starts, ends = L._words(raw)
    return model.scores(raw, letter, starts, ends)


def brute(score, penalty):
    best, back = score[0].astype(float), []
    for row in score[1:]:
        top = int(best.argmax())
        step = [top if best[top] - penalty > best[k] else k for k in range(len(row))]
        back.append(step)
        best = np.array([best[s] - (penalty if s != k else 0) for k, s in enumerate(step)]) + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(step[path[-1]])
    return path[::-1]


def test_viterbi_against_brute_force(spark, model, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng = random.Random(1)
    mixed = [" ".join(rng.choice(texts)[: rng.choice([30, 200, 600])] for _ in range(rng.randint(1, 4))) for _ in range(40)]
    scores = [words(model, t) for t in mixed]
    bounds = np.cumsum([0] + [len(s) for s in scores])
    got = model.labels(np.concatenate(scores), bounds)
    for s, a, b in zip(scores, bounds, bounds[1:], strict=False):
        assert got[a:b].tolist() == brute(s, model.penalty)


def test_spans_of_mixed_text(model):
    en, de = "the of and that is with from the and that this are for ", "der die und nicht das ein ist mit den von auch "
    (lang, score, spans), = model.identify([en * 3 + de * 3])
    assert [s[2] for s in spans] == ["en", "de"] and 0.4 < score < 0.7 and lang in ("en", "de")
    assert spans[0][0] == 0 and abs(spans[1][0] - len(en * 3)) < 8


def brute_score(model, word):
    """The log-probabilities of one word, its trigrams and hashes by Python's integers."""
    data = word.encode()
    padded = b" " + data + b" "
    total = np.zeros(len(model.languages))
    for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
        code = ((a * 65599 + b) * 65599 + c) % 2**32 * 2654435761 % 2**32 >> 32 - L.BITS
        total += model.grams[code]
    power, whole = 0x9E3779B97F4A7C15, 0
    for i, x in enumerate(data):
        whole += (x + 1) * pow(power, i % 64 + 1, 2**64)
    total += model.wholes[whole * 0xD6E8FEB86659FD93 % 2**64 >> 64 - L.BITS]
    scripts = [next((L.NAMES.index(s) for s, lo, hi in L.SCRIPTS if lo <= ord(c) <= hi), len(L.NAMES) - 1) for c in word]
    return total + model.barred[max(scripts)]


def test_word_scores_against_brute_force(spark, model, sf_dir):
    text = " ".join(r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect() if r.text)
    text += " Ünïcödé naïve Собака мир ΑΒΓ 漢字 हिन्दी ภาษาไทย"
    own = regex.findall(r"[\p{L}\p{M}]+", text.lower())
    scores = words(model, text)
    assert len(scores) == len(own)
    for w, row in zip(own, scores, strict=True):
        assert np.allclose(row, brute_score(model, w), atol=1e-3), w


def test_scripts_are_ranges_of_code_points():
    def of(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return [L.NAMES[k] for k in L.Model.scripts(raw, *L._words(raw))]

    want = {"Việt": "latin", "ở": "latin", "かな": "kana", "ქართული": "georgian", "हिन्दी": "devanagari", "ภาษาไทย": "thai", "বাংলা": "bengali", "\U0001d49c": "other", "漢字": "han", "한국어": "hangul", "\U00020000": "han", "tree": "latin", "ελληνικά": "greek"}
    assert {x: of(x) for x in want} == {x: [s] for x, s in want.items()}
    assert of("“one” … 、two。 ª ¿tres? — \U0001f600 x\u0301y") == ["latin"] * 5


def test_hundreds_of_languages():
    rng = random.Random(2)
    tongues = {f"l{k:03d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for k in range(300)}
    m = L.Model([(" ".join(w * 4), lang) for lang, w in tongues.items()])
    some = rng.sample(sorted(tongues), 20)
    assert [x[0] for x in m.identify([" ".join(tongues[k]) for k in some])] == some
    (_, _, spans), = m.identify([" ".join(tongues["l007"] * 3 + tongues["l290"] * 3)])
    assert [s[2] for s in spans] == ["l007", "l290"]


def test_words_are_scored_alike_in_parts(model, monkeypatch):
    text = "the of and das ist nicht, été señor 12 über-all " * 40
    whole = words(model, text)
    monkeypatch.setattr(L, "WORDS", 7)
    assert np.array_equal(words(model, text), whole)


def test_scripts_narrow_the_candidates():
    m = L.Model([("the cat and the dog " * 20, "en"), ("кот и собака в доме " * 20, "ru"), ("der hund und die katze " * 20, "de")])
    assert [x[0] for x in m.identify(["Собака", "the dog", "und die", "ΑΒΓ", "漢字", "123 !?", ""])][:3] == ["ru", "en", "de"]
    assert m.identify(["ª"])[0][0] in m.languages and m.identify(["ª", "the dog"])[0][0] in m.languages
    assert m.identify(["123 !?"])[0] == ("und", 0.0, []) and m.identify(["漢字"])[0][0] in m.languages


def test_held_out_accuracy(spark):
    found = queries.op4_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = [r for r in found.join(docs, "doc_id").collect() if r.held_out and r.lang]
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark, model):
    rows = {r.id: r for r in L.identify(odd(spark), model).collect()}
    assert len(rows) == 9 and all(rows[i].lang == "und" and rows[i].score == 0 and rows[i].spans == [] for i in (1, 2, 3))
    assert rows[4].lang in model.languages and rows[8].spans[0].end == 3000
    assert L.identify(empty(spark), model).count() == 0
    nothing = L.train(empty(spark))
    assert {r.lang for r in L.identify(odd(spark), nothing).collect()} == {"und"}


def test_long_texts_in_windows_give_what_they_give_whole(monkeypatch):
    import random

    rng = random.Random(4)
    words = {"en": "the of and house water with from this that language".split(), "de": "der die und haus wasser mit von dieses sprache nicht".split(), "ru": "это дом вода язык который было".split()}
    model = L.Model([(" ".join(rng.choices(own, k=60)), lang) for lang, own in words.items() for _ in range(20)])
    texts = ["", "123 456", "\u0301 \u0302", "the house"]
    for _ in range(25):
        parts = [" ".join(rng.choices(words[rng.choice(sorted(words))], k=rng.randrange(1, 40))) for _ in range(rng.randrange(1, 6))]
        texts.append(rng.choice((" ", ". ", "\n")).join(parts))
    whole = model.identify(texts)
    for window in (7, 50, 1000):
        for text, want in zip(texts, whole, strict=True):
            got = model.identify_long(text.encode(), window)
            assert (got[0], got[2]) == (want[0], want[2]) and abs(got[1] - want[1]) < 1e-9, (window, text)


def test_memory_of_a_long_text_does_not_grow_with_languages():
    import tracemalloc

    name = lambda k: chr(97 + k // 8) + chr(97 + k % 8)
    model = L.Model([(f"wort{name(k)} haus{name(k)} " * 20, f"l{k:02d}") for k in range(60)])
    data = b"wortah hausah wortah hausah " * 70_000  # 2 MB
    tracemalloc.start()
    found = model.identify_long(data, 1 << 17)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0] == "l07" and most < 100 << 20
