"""Secret scans: fixed patterns, and the guess cost of values in a credential context.

The fixed patterns give spans of the kinds assign, access and hex. Beside them every value that follows a credential
word is priced by dynamic programming: the cheapest segmentation into common words, dates, repeated blocks, keyboard
walks, stretches that come again later in the value and brute-force stretches, in powers of ten of the guesses that a
cracker would need. It is the true minimum over all segmentations: a walk, a repeat, a copy or a date may begin at any of
its characters, and a copy may be of any length and distance. It is worked out from a value's end to its start, which
prices all of its tails too, so that a run of values within one another is priced once. Values that cost `least` or more
get a span of the kind guess; placeholders, plain words, keyboard walks and addresses with a scheme stay below (what
follows a credential word inside an address is a value of its own).

Defined cases: null and empty texts have no spans; whole texts are scanned, and a value of any length is priced in
time proportional to its length; offsets count code points, ends exclusive; repeated rows are scanned alike; spans of
equal start go by kind, as listed in KINDS, and overlapping ones all stay; columns other than id and text are ignored by
`scan` and kept as they are by `redact`, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import base64
import json
import math
import re
from collections import deque
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

KINDS = ("assign", "access", "hex", "guess")
WORDS_IN_ASSIGN = ("password", "passwd", "secret", "token", "api")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_NAME = r"pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|private|access|encryption|signing|account|storage|shared|master|session)[\x20_.-]?key|credentials?|auth(?:orization)?"
_SUFFIX = r"(?:[\x20_.-]?(?:access|private|secret|token|api|key|value|val|string|text|code|hash|data))"
#: A credential word with suffixes, `=`, `:`, `:=`, `=>` or `is` (or `bearer` and a space), the name of a scheme; then a value.
CONTEXT = re.compile(rf"""(?ai)(?:(?:{_NAME}|bearer){_SUFFIX}{{0,3}}["'\]]{{0,2}}(?:[\x20\t]*(?:=>|:=|->|[:=]+)[\x20\t]*|[\x20\t]+is[\x20\t]+)|bearer[\x20\t]+)["']?(?:(?:basic|bearer|digest|token)[\x20\t]+)?["']?(?=[^\s"'`<>&|,;]{{4}})""")
VALUE = re.compile(r"""[^\s"'`<>&|,;]+""")
#: Values that are an address, not a secret.
ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,15}://")
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")
#: Common password words, commonest first; the place is the guess number.
COMMON = """password admin welcome letmein login master hello monkey dragon shadow sunshine princess football baseball
superman batman trustno iloveyou qwerty abc secret default guest test user root changeme example sample dummy null none
true false token value string your here insert replace placeholder todo summer winter spring autumn love star king
london paris berlin madrid january february march april may june july august september october november december monday
friday sunday the and with from this that computer internet server database public private access system service""".split()
#: Characters of words, and of blocks that are repeated; longer stretches that come again are copies.
LONGEST = 20


def _ranks() -> dict[str, int]:
    """The place of common password words, then of words and word parts of four letters or more in the vocabularies of
    four public tokenizers (English, many languages, whole words, pieces), which list them by frequency: at most 180,000.
    """
    listed: list[list[str]] = []
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        with open(public_tokenizers.path(name), "rb") as f:
            ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
        listed.append([token.decode("utf-8", "ignore").strip() for _, token in ranked])
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        vocab = json.load(f)["model"]["vocab"]
    listed.append([w.removesuffix("</w>") for w in sorted(vocab, key=vocab.get)])
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    listed.append([pieces.id_to_piece(i).strip("\u2581") for i in range(pieces.get_piece_size())])
    ranks: dict[str, int] = {}
    for words in (COMMON, *listed):
        own = dict.fromkeys(w.lower() for w in words if words is COMMON or 4 <= len(w) <= LONGEST and w.isalpha())
        for i, w in enumerate(own):
            place = i + 1 if words is COMMON else len(COMMON) + i + 1
            ranks[w] = min(place, ranks.get(w, place))
    return ranks


RANK = _ranks()
PLAIN = str.maketrans("043157$@!", "oaeistsai")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
NEXT = {(a, b) for row in ROWS for x, y in zip(row, row[1:], strict=False) for a, b in ((x, y), (y, x))}
DATE = re.compile(r"(?:(?:19|20)\d\d)([-/.]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/.]?)(?:0?[1-9]|1[0-2])\2(?:(?:19|20)\d\d)|(?:19|20)\d\d")
#: Powers of ten of guesses: one more segment; a character of a brute-force stretch; a year; a day; the first key and the
#: turns of a keyboard walk, besides its length; a word in capitals or with signs for letters; where a copy is found.
SEGMENT, BRUTE, YEAR, DAY, WALK, VARIED, COPY = math.log10(2), 1.0, math.log10(120), math.log10(120 * 365), math.log10(47 * 4), math.log10(4), 2.0
#: Values from 10 ** LEAST guesses on are taken for secrets.
LEAST = 10.0


class _Ends:
    """Ends of a stretch that grows towards its start, of which those are kept that may yet be the cheapest.

    A stretch costs what lies behind it and log10 of its length. Of two ends the later one loses ground ever more slowly,
    so from the place where it is no dearer than an earlier one it stays so, and the earlier one is dropped.
    """

    def __init__(self):
        self.at: list[int] = []

    def least(self, best: list[float], start: int) -> float:
        low, kept = math.inf, []
        for x in self.at:
            cost = best[x] + math.log10(x - start)
            if cost < low:
                low = cost
                kept.append(x)
        self.at = kept
        return low


def again(value: str) -> list[int]:
    """For each place the length of the longest stretch from there that also begins at a later place.

    A suffix automaton of the value read backwards: the link of the state of all that has been read is the longest part of
    its end that was read before.
    """
    moves, link, size, last, out = [{}], [-1], [0], 0, []
    for c in reversed(value):
        new = len(moves)
        moves.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
        out.append(size[link[new]])
    return out[::-1]


class _Copies:
    """The cheapest end of a copy from each place, lengths counting as the power of two below them.

    How far a copy may reach never grows from a place to the one before by more than one, so for each power of two the
    ends in reach are a window that moves towards the start, and its minimum is kept up by a queue.
    """

    def __init__(self, value: str):
        self.reach = again(value)
        self.queues: list[tuple[int, deque]] = [(1 << k, deque()) for k in range((LONGEST + 1).bit_length() - 1, max(self.reach, default=0).bit_length())]

    def least(self, best: list[float], start: int) -> float:
        low = math.inf
        for power, queue in self.queues:
            shortest = max(power, LONGEST + 1)
            if start + shortest >= len(best):
                break
            while queue and best[queue[-1]] >= best[start + shortest]:
                queue.pop()
            queue.append(start + shortest)
            most = min(2 * power - 1, self.reach[start])
            while queue and queue[0] > start + most:
                queue.popleft()
            if queue:
                low = min(low, best[queue[0]] + math.log10(power))
        return low


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def tail_costs(value: str) -> list[float]:
    """log10 of the guesses for each tail of `value`: the minimum over segmentations of the sum of their costs."""
    n, low = len(value), _lower(value)
    plain = low.translate(PLAIN)
    best = [0.0] * (n + 1)
    walk, walks = 1, _Ends()
    same = [0] * (LONGEST + 1)  # by period: characters from here on that equal the one a period later
    repeats: list[list[_Ends]] = [[_Ends() for _ in range(p)] for p in range(LONGEST + 1)]
    copies = _Copies(value) if n > LONGEST + 1 else None
    for i in range(n - 1, -1, -1):
        cost = best[i + 1] + BRUTE  # a brute-force stretch grows by one character
        for size in range(3, min(LONGEST, n - i) + 1):
            part = low[i : i + size]
            rank = RANK.get(part)
            if rank:
                cost = min(cost, best[i + size] + SEGMENT + math.log10(rank + 1) + (0 if value[i : i + size] == part else VARIED))
            turned = RANK.get(plain[i : i + size])
            if turned:
                cost = min(cost, best[i + size] + SEGMENT + math.log10(turned + 1) + (0 if value[i : i + size] == plain[i : i + size] else VARIED))
        for p in range(1, min(LONGEST, n - i - 1) + 1):
            if value[i] != value[i + p]:
                if same[p]:
                    same[p], repeats[p] = 0, [_Ends() for _ in range(p)]
                continue
            same[p] += 1
            times = 2 if p > 1 else 3
            if same[p] >= p * (times - 1):
                ends = repeats[p][i % p]
                ends.at.append(i + p * times)
                cost = min(cost, ends.least(best, i) - math.log10(p) + SEGMENT + (BRUTE if p == 1 else _block_cost(value[i : i + p])))
        if i + 1 < n and (low[i], low[i + 1]) in NEXT:
            walk += 1
            if walk >= 3:
                walks.at.append(i + 3)
                cost = min(cost, walks.least(best, i) + SEGMENT + WALK)
        elif walk > 1:
            walk, walks = 1, _Ends()
        if value[i].isdigit():
            for j in range(i + 4, min(n, i + 10) + 1):
                if DATE.fullmatch(value, i, j):
                    cost = min(cost, best[j] + SEGMENT + (YEAR if j - i == 4 else DAY))
        if copies:
            cost = min(cost, copies.least(best, i) + SEGMENT + COPY)
        best[i] = cost
    return best


def guess_cost(value: str) -> float:
    return tail_costs(value)[0]


@lru_cache(1 << 12)
def _block_cost(block: str) -> float:
    return guess_cost(block)


def spans(text: str, least: float = LEAST) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) by start, then kind."""
    out = []
    low = text.lower()  # only searched for words, so its length may differ
    if any(w in low for w in WORDS_IN_ASSIGN):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    if any(w in low for w in CONTEXT_WORDS):
        at, first, end, costs = 0, 0, 0, []
        while m := CONTEXT.search(text, at):
            at = m.end()
            if at >= end:  # else the value is a tail of the last one
                first, end = at, VALUE.match(text, at).end()
                costs = tail_costs(text[at:end])
            if costs[at - first] >= least and not ADDRESS.match(text, at):
                out.append(("guess", at, end))
                at = end  # what is cheap may itself be a credential word
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redacted(text: str, mark: str = "[SECRET]", least: float = LEAST) -> str:
    """The text with every stretch under a span replaced by `mark`."""
    parts, done = [], 0
    for _, start, end in spans(text, least):
        if start >= done:
            parts += [text[done:start], mark]
        done = max(done, end)
    return "".join([*parts, text[done:]]) if parts else text


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """Rows (id, spans array<struct<kind, start, end>>)."""
    kind = docs.select(id_col).dtypes[0][1]
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(texts, batch):
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(x.decode("utf-8", "replace"), least)] for x in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, shape)], ["id", "spans"])

    return map_texts(docs, [id_col], text_col, run, f"id {kind}, spans array<struct<kind string, start long, end long>>")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", least: float = LEAST) -> DataFrame:
    """The documents with every secret replaced by `mark`; a null text stays null."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else redacted(x, mark, least) for x in texts.to_pylist()], pa.string())

    return docs.withColumn(text_col, clean(F.col(f"`{text_col}`")))
