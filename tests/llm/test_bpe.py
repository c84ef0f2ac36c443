import base64
import hashlib

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe

from .helpers import LONG, empty, odd

PATH = P.path("byte_bpe_50k.tiktoken")
with open(PATH, "rb") as f:
    DATA = f.read()
CODEC = bpe.Codec(DATA, P.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}, special_tokens={})


def same(texts):
    ids, counts = CODEC.encode(texts)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == REFERENCE.encode_ordinary(text)
        at += n
    assert CODEC.decode(ids, counts) == [t.encode() for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aeé tn's\n \t0漢\U0001f600.,"), max_size=60), max_size=6))
def test_any_text(texts):
    same(texts)


def test_spaces_long_pieces_and_specials():
    same(["", " ", "  ", "a  b", "a\n b", "a \nb", "a \n b", "a\n\n b", " a", "a ", "<|endoftext|>", "don't 'll", "x" * 5000, "é" * 300, "ab" * 700 + " " + "z" * 257, LONG[:20000]])


def test_memory_may_run_full(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    same(["one two three four five", "one two six"])


def test_digests(spark):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(odd(spark), PATH, P.PATTERN).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = set()
    for r in odd(spark).collect():
        ids = REFERENCE.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    assert got == want
    assert bpe.digests(empty(spark), PATH, P.PATTERN).count() == 0


def test_decode_keeps_columns_and_takes_null_ids(spark):
    rows = spark.createDataFrame([(1, [0, 1], "x"), (2, None, "y"), (3, [], None)], "doc_id long, ids array<int>, other string")
    got = [tuple(map(lambda v: bytes(v) if isinstance(v, bytearray) else v, r)) for r in bpe.decode(rows, PATH, P.PATTERN).select("doc_id", "other", "decoded").collect()]
    assert got == [(1, "x", CODEC.tokens[0] + CODEC.tokens[1]), (2, "y", b""), (3, None, b"")]


def test_other_patterns_split_whole_texts():
    texts = ["one two  three four", " a b", "", "x" * 700, "don't stop"]
    for pattern in (r"[\s\S]{1,7}", r"(\w+)|(\W+)", r" ?\S+"):
        codec = bpe.Codec(DATA, pattern)
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=REFERENCE._mergeable_ranks, special_tokens={})
        for _ in range(2):
            ids, counts = codec.encode(texts)
            want = [enc.encode_ordinary(t) for t in texts]
            assert counts.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


def test_clashing_names_give_way(spark):
    rows = spark.createDataFrame([(1, "a b", "old", "old")], "doc_id long, text string, ids string, decoded string")
    ids = bpe.encode(rows, PATH, P.PATTERN, keep=["doc_id", "ids", "decoded"])
    back = bpe.decode(ids, PATH, P.PATTERN)
    assert ids.columns == ["doc_id", "decoded", "ids"] and back.columns == ["doc_id", "ids", "decoded"]
    assert bytes(back.first().decoded) == b"a b" and back.first().ids == REFERENCE.encode_ordinary("a b")


def test_a_round_trip_is_encoding_then_decoding(spark):
    pairs = lambda df: sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in df.collect()), key=str)
    docs = odd(spark)
    assert pairs(bpe.round_trip(docs, PATH, P.PATTERN)) == pairs(bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN))
    clash = spark.createDataFrame([("a b", "x", 1)], "text string, decoded string, n int")
    assert bpe.round_trip(clash, PATH, P.PATTERN, keep=["decoded", "n"]).columns == ["n", "ids", "decoded"]
