import math
import random
import re

import numpy as np

from tessera.llm import spaced_seeds as S

from .helpers import empty, odd

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


def bench(spark, *items):
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def pairs(found):
    return sorted((r.id, r.item) for r in found.collect())


def test_finds_every_planted_passage_and_nothing_else(spark, sf_dir):
    own, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    want = []
    listed = [(r.item_id, words(r.text)) for r in items.collect()]
    for d in own.collect():
        text = " " + " ".join(words(d.text)) + " "
        want += [(d.doc_id, i) for i, w in listed if " " + " ".join(w) + " " in text]
    found = S.overlaps(own, items)
    assert want and pairs(found) == sorted(want)
    kept = {r.doc_id for r in S.decontaminate(own, items).collect()}
    assert kept == {r.doc_id for r in own.collect()} - {d for d, _ in want}


def test_substitutions_case_and_marks(spark):
    w = ITEM.split()
    every_fifth = " ".join("X" if i % 5 == 4 else x for i, x in enumerate(w))
    every_third = " ".join("X" if i % 3 == 2 else x for i, x in enumerate(w))
    texts = [f"before {ITEM.upper()}, after", ", ".join(w), every_fifth, every_third, " ".join(w[:13]) + " other words", " ".join(w[:9]) + " other words", " ".join(reversed(w)), f"{ITEM} {ITEM}"]
    found = S.overlaps(docs(spark, *texts), bench(spark, ITEM))
    assert [d for d, _ in pairs(found)] == [0, 1, 2, 4, 7]
    first = {r.id: r for r in found.collect()}
    assert (first[0].text_start, first[0].n_matches) == (1, 20) and first[2].n_matches >= 13 and first[7].text_start == 0


def test_short_items_repeated_words_and_blocks(spark):
    items = bench(spark, "alpha beta", None, "", "same same same same same same same same same same", ITEM, ITEM)
    texts = ["x alpha beta y", "alpha x beta", "same " * 500, ITEM, None, ""]
    want = [(0, 0), (2, 3), (3, 4), (3, 5)]
    assert pairs(S.overlaps(docs(spark, *texts), items, least_item=1)) == want
    assert pairs(S.overlaps(docs(spark, *texts), items, block_chars=60, least_item=1)) == want
    assert pairs(S.overlaps(docs(spark, *texts), items)) == [p for p in want if p[1]]  # two tokens say too little
    assert pairs(S.overlaps(docs(spark, "Yes, of course", ITEM), bench(spark, "Yes", ITEM))) == [(1, 1)]


def test_odd_rows(spark):
    item = "the same text of some words that is here twice and a little longer"
    assert pairs(S.overlaps(odd(spark), bench(spark, item))) == [(5, 0), (5, 0), (9, 0)]
    kept = S.decontaminate(odd(spark), bench(spark, item))
    assert kept.columns == odd(spark).columns and kept.count() == 7
    assert S.overlaps(empty(spark), bench(spark, item)).count() == 0
    assert S.overlaps(odd(spark), bench(spark).limit(0)).count() == 0


def test_long_data_are_hashed_alike_in_chunks(monkeypatch):
    text = b"some words, and more of them " * 50
    whole = S.token_hashes(text)
    monkeypatch.setattr(S, "CHUNK", 37)
    parts = S.token_hashes(text)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert [text[a:b] for a, b in zip(whole[1].tolist(), whole[2].tolist(), strict=True)] == re.findall(rb"[a-z]+", text)


def brute_overlap(item, text, least=13):
    """Most matches over all placements and regions with three matches to a mismatch, if they are enough."""
    need, best = (least if 0.8 * len(item) >= least else math.ceil(0.8 * len(item))), 0
    for shift in range(-len(item) + 1, len(text)):
        equal = [0 <= shift + i < len(text) and text[shift + i] == x for i, x in enumerate(item)]
        for a in range(len(item)):
            hits = 0
            for b in range(a, len(item)):
                hits += equal[b]
                if hits > best and hits >= 3 * (b + 1 - a - hits):
                    best = hits
    return best if best >= need else None


def test_against_all_placements(spark):
    rng = random.Random(3)
    items, texts = [], []
    for n in [*range(2, 18), 20, 20, 26, 34, 34]:
        item = [f"w{rng.randrange(400)}" for _ in range(n)]
        for k in range(1, 7):
            copy = list(item)
            for i in rng.sample(range(n), min(n, k)):
                copy[i] = f"x{rng.randrange(400)}"
            cut = rng.choice([0, 0, 0, 1, 2])
            texts.append(copy[cut:] if k % 2 else [*"before it".split(), *copy, *"after it".split()])
        items.append(item)
    w = ITEM.split()
    items.append(w)
    texts += [["x" if i % 4 == 3 and i < 16 else x for i, x in enumerate(w)], [*w[:9], "y", "y", *w[11:]]]
    items.append([f"v{i}" for i in range(34)])
    texts.append([f"v{i}" if not 12 <= i < 16 and i not in (20, 27) else "z" for i in range(34)])
    want = sorted((d, i, m) for d, t in enumerate(texts) for i, x in enumerate(items) if (m := brute_overlap(x, t)))
    found = S.overlaps(docs(spark, *map(" ".join, texts)), bench(spark, *map(" ".join, items)), least_item=1)
    assert sorted((r.id, r.item, r.n_matches) for r in found.collect()) == want and len(want) > 40


def test_no_region_avoids_all_masks():
    """All arrangements of 13 to 25 matches with three to a mismatch, as far as no mask lies in them; longer regions hold such ones."""
    span = max(map(len, S.MASKS))
    bits = [int(m, 2) for m in S.MASKS]
    front = {(1, 1, 0)}  # the last tokens as bits, matches, mismatches
    while front:
        assert not any(m >= 13 and 3 * x <= m for _, m, x in front)
        steps = {((s << 1 | v) & (1 << span) - 1, m + v, x + 1 - v) for s, m, x in front for v in (0, 1)}
        front = {(s, m, x) for s, m, x in steps if m <= 25 and x <= 8 and not any(s & b == b for b in bits)}


def test_unicode_spaces_marks_and_unspaced_scripts(spark):
    han = "春眠不覚暁処処聞啼鳥夜来風雨声花落知多少"
    texts = [f"今日の詩は「{han}」という", f"x {ITEM.replace(' ', chr(0xA0))} y", f"x {ITEM.replace(' ', chr(0x3000))} y", " ".join(f"“{w}”" for w in ITEM.split()), ITEM.replace(" ", "—"), han[:3] + "その他の文字", "5€ " + ITEM.replace(" ", " "), "café " + ITEM]
    found = S.overlaps(docs(spark, *texts), bench(spark, ITEM, han))
    assert pairs(found) == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 0), (6, 0), (7, 0)]
    starts = {r.id: (r.text_start, r.n_tokens) for r in found.collect()}
    assert starts[0] == (5, 20) and starts[3] == (0, 20) and starts[6] == (2, 20) and starts[7] == (1, 20)


def test_long_tokens_that_differ_in_the_order_of_their_bytes(spark, monkeypatch):
    long = ["a" * i + "b" + "c" * 63 + "d" + "e" * 9 for i in range(20)]
    swapped = ["a" * i + "d" + "c" * 63 + "b" + "e" * 9 for i in range(20)]
    assert not (S.token_hashes(" ".join(long).encode())[0] == S.token_hashes(" ".join(swapped).encode())[0]).any()
    texts = [" ".join(long), " ".join(swapped), ITEM, " ".join(reversed(ITEM.split()))]
    assert pairs(S.overlaps(docs(spark, *texts), bench(spark, " ".join(long), ITEM))) == [(0, 0), (2, 1)]
    # with equal hashes for all tokens only the bytes tell them apart
    same = lambda data: (np.ones(len(w := list(re.finditer(rb"[a-z0-9]+", data))), np.uint64), np.array([m.start() for m in w], np.int64), np.array([m.end() for m in w], np.int64))
    monkeypatch.setattr(S, "token_hashes", same)
    index = S.Index([(7, ITEM.encode())], S.MASKS, 13)
    for text, want in ((f"x {ITEM} y", [(0, 0, 1, 0, 20, 20)]), (" ".join(reversed(ITEM.split())), [])):
        data = text.encode()
        tokens, starts, ends = same(data)
        assert index.overlaps(data, tokens, starts, ends, np.array([0, len(tokens)])) == want


def test_a_phrase_that_all_items_share(monkeypatch):
    """Hits of thousands of items are expanded in chunks, to the same result."""
    phrase = "which of the following is the best answer to the question"
    items = [(i, f"{phrase} {' '.join(f'i{i}w{k}' for k in range(8))}".encode()) for i in range(3000)]
    index = S.Index(items, S.MASKS, 13)
    data = b"\n".join([f"{phrase} and more of it".encode() * 3, items[1234][1], b"nothing"])
    tokens, starts, ends = S.token_hashes(data)
    bounds = np.searchsorted(starts, [0, data.index(b"\n"), data.rindex(b"\n"), len(data)])
    whole = index.overlaps(data, tokens, starts, ends, bounds)
    assert [r[:2] for r in whole] == [(1, 1234)]
    monkeypatch.setattr(S, "HITS", 5000)
    assert index.overlaps(data, tokens, starts, ends, bounds) == whole


def test_an_index_of_a_large_block_is_built_in_bounded_memory():
    import tracemalloc

    rng = random.Random(1)
    items = [(i, " ".join(f"w{rng.randrange(50_000)}" for _ in range(rng.choice((8, 40)))).encode()) for i in range(16_000)]
    chars = sum(len(t) for _, t in items)
    tracemalloc.start()
    index = S.Index(items, S.MASKS, 13, 5)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert chars > 2_000_000 and held < 40 * chars
    data = items[77][1] + b"\n" + items[8000][1]
    tokens, starts, ends = S.token_hashes(data)
    found = index.overlaps(data, tokens, starts, ends, np.array([0, len(items[77][1].split()), len(tokens)]))
    assert {r[:2] for r in found} == {(0, 77), (1, 8000)}
