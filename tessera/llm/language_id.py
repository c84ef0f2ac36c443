"""Language spans of mixed-language text: scripts narrow the candidates, Viterbi picks among them.

A word is a run of letters and combining marks. It gets a log-probability for each learned language from hashed byte
trigrams, word ends included, and from the hashed word itself. Its script is told by ranges of code points, and languages
that were never seen in that script are ruled out for it. The labels of a text's words are the Viterbi path under a
penalty for each switch, so that a stray word does not make a span.

Texts whose best single language can't be beaten by any switch are settled by that bound alone; the others step through
Viterbi together, one word of each at a time. A text of over WINDOW bytes goes through by itself, window by window, with
the same result: only the state before each window is kept, so memory doesn't grow with words times languages.

Defined cases: a null text and one without letters are `und` with score 0 and no spans; a text whose letters are in no
learned script is judged by all languages; whole texts are labelled, the longest too; any number of languages can be
learned; ties go to the language first in the alphabet; repeated rows are labelled alike; other columns are ignored; without any training text all is `und`; no rows give none.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

BITS = 16
PENALTY = 12.0
RULED_OUT = -40.0
#: Words that are scored at once, to bound memory.
WORDS = 1 << 17
#: Bytes of a text above which it is labelled window by window, and of a window.
WINDOW = 1 << 20
#: Training texts for each language at most about this many, and of at most so many characters.
SAMPLE, SAMPLE_CHARS = 1500, 20_000
#: Ranges of code points of scripts. A letter outside all of them is of the script "other"; ASCII and combining accents are Latin.
SCRIPTS = (
    ("latin", 0x41, 0x36F), ("latin", 0x1E00, 0x1EFF), ("latin", 0x2C60, 0x2C7F), ("latin", 0xA720, 0xA7FF), ("latin", 0xAB30, 0xAB6F), ("latin", 0xFB00, 0xFB06), ("latin", 0xFF21, 0xFF5A),
    ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x400, 0x52F), ("cyrillic", 0x1C80, 0x1C8F), ("cyrillic", 0x2DE0, 0x2DFF), ("cyrillic", 0xA640, 0xA69F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("hebrew", 0xFB1D, 0xFB4F),
    ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("arabic", 0x8A0, 0x8FF), ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFF),
    ("syriac", 0x700, 0x74F), ("thaana", 0x780, 0x7BF), ("nko", 0x7C0, 0x7FF),
    ("devanagari", 0x900, 0x97F), ("devanagari", 0xA8E0, 0xA8FF), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("oriya", 0xB00, 0xB7F),
    ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("sinhala", 0xD80, 0xDFF),
    ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF), ("tibetan", 0xF00, 0xFFF), ("myanmar", 0x1000, 0x109F), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF),
    ("georgian", 0x10A0, 0x10FF), ("georgian", 0x1C90, 0x1CBF), ("georgian", 0x2D00, 0x2D2F), ("ethiopic", 0x1200, 0x139F), ("ethiopic", 0x2D80, 0x2DDF), ("cherokee", 0x13A0, 0x13FF), ("cherokee", 0xAB70, 0xABBF),
    ("hangul", 0x1100, 0x11FF), ("hangul", 0x3130, 0x318F), ("hangul", 0xA960, 0xA97F), ("hangul", 0xAC00, 0xD7FF),
    ("kana", 0x3040, 0x30FF), ("kana", 0x31F0, 0x31FF), ("kana", 0xFF66, 0xFF9F), ("bopomofo", 0x3100, 0x312F), ("bopomofo", 0x31A0, 0x31BF),
    ("han", 0x2E80, 0x2FDF), ("han", 0x3005, 0x3007), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x323AF),
)
NAMES = ["latin", *sorted({s for s, _, _ in SCRIPTS} - {"latin"}), "other"]

_LETTER = np.array([chr(i).isalpha() if i < 128 else False for i in range(256)])
_RANGES = sorted((lo, hi, NAMES.index(s)) for s, lo, hi in SCRIPTS)
_FROM, _TO, _OF = (np.array(x) for x in zip(*_RANGES, strict=True))


@cache
def _word_points() -> np.ndarray:
    """Whether each code point is a letter or a combining mark, and so a part of a word."""
    return np.fromiter((unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)), bool, 0x110000)


def _points(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points of the multi-byte characters of valid UTF-8 that begin at `at`."""
    lead = raw[at].astype(np.int32)
    byte = lambda k: raw[np.minimum(at + k, len(raw) - 1)].astype(np.int32) & 0x3F
    two = (lead & 0x1F) << 6 | byte(1)
    three = (lead & 0x0F) << 12 | byte(1) << 6 | byte(2)
    four = (lead & 0x07) << 18 | byte(1) << 12 | byte(2) << 6 | byte(3)
    return np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))


def _script_of(points: np.ndarray) -> np.ndarray:
    k = np.maximum(np.searchsorted(_FROM, points, side="right") - 1, 0)
    return np.where((points >= _FROM[k]) & (points <= _TO[k]), _OF[k], len(NAMES) - 1)


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is a byte of a letter or mark, first byte of each word, byte after each word)."""
    letter = _LETTER[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        lead = lead[_word_points()[_points(raw, lead)]]
        size = np.where(raw[lead] < 0xE0, 2, np.where(raw[lead] < 0xF0, 3, 4))
        for k in range(4):  # with their continuation bytes
            letter[lead[size > k] + k] = True
    edge = np.diff(np.concatenate(([False], letter, [False])).astype(np.int8))
    return letter, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _codes(raw: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """A hashed trigram for each byte: the byte and its neighbours, anything that is no letter being a word end."""
    own = np.where(letter, raw, 32).astype(np.uint32)
    end = np.full(1, 32, np.uint32)
    before, after = np.concatenate((end, own[:-1])), np.concatenate((own[1:], end))
    mixed = (before * np.uint32(65599) + own) * np.uint32(65599) + after
    return ((mixed * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def _word_codes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes."""
    power = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
    sizes = ends - starts
    inside = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    value = (raw[inside].astype(np.uint64) + np.uint64(1)) * power[place & 63]
    total = np.add.reduceat(value, np.cumsum(sizes) - sizes)
    return ((total * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)


class Model:
    """Tables of log-probabilities, learned from (text, language) pairs."""

    def __init__(self, samples: list[tuple[str, str]], penalty: float = PENALTY):
        self.languages = sorted({lang for _, lang in samples})
        self.penalty = penalty
        count = len(self.languages)
        grams, wholes = np.ones((count, 1 << BITS)), np.full((count, 1 << BITS), 0.2)
        scripts = np.zeros((len(NAMES), count))
        for text, lang in samples:
            k = self.languages.index(lang)
            raw = np.frombuffer(text.lower().encode(), np.uint8)
            letter, starts, ends = _words(raw)
            if not len(starts):
                continue
            grams[k] += np.bincount(_codes(raw, letter)[letter], minlength=1 << BITS)
            wholes[k] += np.bincount(_word_codes(raw, starts, ends), minlength=1 << BITS)
            scripts[:, k] += np.bincount(self.scripts(raw, letter, starts, ends), minlength=len(NAMES))
        logs = lambda x: np.log(x / x.sum(axis=1, keepdims=True)).T.astype(np.float32)
        self.grams, self.wholes = np.ascontiguousarray(logs(grams)), np.ascontiguousarray(logs(wholes))
        seen = scripts >= 0.01 * np.maximum(1, scripts.sum(axis=0))
        self.barred = np.where(seen | ~seen.any(axis=1, keepdims=True), 0, RULED_OUT).astype(np.float32)

    @staticmethod
    def scripts(raw, letter, starts, ends) -> np.ndarray:
        """The script of each word: the last one in NAMES of its letters' scripts; Latin if all are ASCII."""
        at = np.flatnonzero(letter & (raw >= 0xC0))
        own = np.zeros(len(raw) + 1, np.int64)
        own[at] = _script_of(_points(raw, at))
        return np.maximum.reduceat(own, np.stack((starts, ends), axis=1).ravel())[::2]

    def scores(self, raw, letter, starts, ends) -> np.ndarray:
        """(words, languages): log-probabilities; a bounded number of words at once."""
        out = np.zeros((len(starts), len(self.languages)), np.float32)
        for low in range(0, len(starts), WORDS):
            s, e = starts[low : low + WORDS], ends[low : low + WORDS]
            a, b = s[0], e[-1]
            out[low : low + WORDS] = self._scores(raw[a:b], letter[a:b], s - a, e - a)
        return out

    def _scores(self, raw, letter, starts, ends) -> np.ndarray:
        where = np.flatnonzero(letter)
        sizes = ends - starts
        at = np.cumsum(sizes) - sizes
        codes = _codes(raw, letter)[where]
        out = np.stack([np.add.reduceat(self.grams[:, k][codes], at) for k in range(len(self.languages))], axis=1)
        return out + self.wholes[_word_codes(raw, starts, ends)] + self.barred[self.scripts(raw, letter, starts, ends)]

    def labels(self, score: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The language of each word; bounds: the first word of each text, and the end."""
        n, count = score.shape
        sizes = np.diff(bounds)
        full = np.flatnonzero(sizes)
        upto = np.concatenate((np.zeros((1, count)), np.cumsum(score, axis=0, dtype=np.float64)))
        best = (upto[bounds[1:]] - upto[bounds[:-1]]).argmax(axis=1)
        out = np.repeat(best, sizes)
        if count == 1 or not len(full):
            return out
        text = np.repeat(np.arange(len(sizes)), sizes)
        own = np.take_along_axis(score, out[:, None], axis=1)
        worst = np.zeros(len(sizes))
        far = 1e9 * (text + 1.0)
        for k in range(count):  # the largest sum that any stretch of words gains in language k
            run = np.cumsum(score[:, k] - own[:, 0], dtype=np.float64) - far
            before = np.concatenate(([0.0], run[:-1]))
            before[bounds[:-1][full]] += -1e9
            gain = run - np.minimum.accumulate(before)
            worst[full] = np.maximum(worst[full], np.maximum.reduceat(gain, bounds[:-1][full]))
        mixed = np.flatnonzero(worst > self.penalty / 2)
        if len(mixed):
            self._viterbi(score, bounds, mixed[np.argsort(-sizes[mixed], kind="stable")], sizes, out)
        return out

    def _viterbi(self, score, bounds, texts, sizes, out) -> None:
        first, size = bounds[texts], sizes[texts]
        steps = int(size[0])
        active = np.searchsorted(-size, -np.arange(steps), side="left")  # texts with more than t words
        came = np.zeros((int(size.sum()), score.shape[1]), np.min_scalar_type(score.shape[1]))
        at = np.concatenate(([0], np.cumsum(active)))
        best = score[first].astype(np.float64)
        for t in range(1, steps):
            a = active[t]
            best = best[:a] if len(best) > a else best
            top = best.argmax(axis=1)
            leap = best[np.arange(a), top][:, None] - self.penalty
            jump = leap > best
            came[at[t] : at[t + 1]] = np.where(jump, top[:, None], np.arange(score.shape[1]))
            best = np.maximum(best, leap) + score[first[:a] + t]
            if t + 1 == steps or active[t + 1] < a:  # texts that end here
                stop = active[t + 1] if t + 1 < steps else 0
                out[first[stop:a] + t] = best[stop:].argmax(axis=1)
        one = active[1] if steps > 1 else 0
        out[first[one:]] = score[first[one:]].argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            a = active[t]
            now = out[first[:a] + t]
            out[first[:a] + t - 1] = came[at[t] : at[t + 1]][np.arange(a), now]

    def _first_labels(self, score: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi steps over a window of words from the state `best` before it: where each state came from, and the state behind."""
        came = np.zeros(score.shape, np.min_scalar_type(score.shape[1]))
        own = np.arange(score.shape[1])
        for t in range(len(score)):
            top = int(best.argmax())
            leap = best[top] - self.penalty
            came[t] = np.where(leap > best, top, own)
            best = np.maximum(best, leap) + score[t]
        return came, best

    def _window(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, bool]:
        """Of a window of a text: words' scores, their first and last code points and bytes, its code points, and whether it has a letter."""
        text = data.decode("utf-8", "replace")
        low = text.lower()
        low = low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        raw = np.frombuffer(low.encode("utf-8", "replace") + b" ", np.uint8)
        letter, starts, ends = _words(raw)
        score = self.scores(raw, letter, starts, ends) if len(starts) else np.zeros((0, len(self.languages)), np.float32)
        point = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32)
        return score, point[starts] - 1, point[ends - 1], ends - starts, len(text), any(map(str.isalpha, text))

    def identify_long(self, data: bytes, window: int = WINDOW) -> tuple[str, float, list[tuple[int, int, str]]]:
        """What `identify` gives for one text, in memory for a window of it: the text is cut at white space, and the state of the
        search is kept for each window, from which its steps are taken once more on the way back."""
        cuts, at = [], 0
        while at < len(data):
            end = min(len(data), at + window)
            while end < len(data) and data[end] not in b" \t\n\v\f\r":
                end += 1
            cuts.append((at, end))
            at = end
        count, total, points, lettered = len(self.languages), 0.0, [], False
        for a, b in cuts:
            found = self._window(data[a:b])
            total = total + found[0].sum(axis=0, dtype=np.float64)
            points.append(found[4])
            lettered = lettered or found[5]
        if not count or not lettered or not np.any(total):
            return ("und", 0.0, [])
        base = np.concatenate(([0], np.cumsum(points)))
        constant = int(np.argmax(total))
        run, least, worst = np.zeros(count), np.zeros(count), 0.0
        for a, b in cuts:  # the largest sum that any stretch of words gains in another language
            score = self._window(data[a:b])[0]
            if len(score):
                sums = run + np.cumsum(score - score[:, constant : constant + 1], axis=0, dtype=np.float64)
                before = np.minimum.accumulate(np.concatenate((run[None, :], sums[:-1])), axis=0)
                worst = max(worst, float((sums - np.minimum(before, least)).max()))
                least, run = np.minimum(least, np.minimum(before[-1], sums[-1])), sums[-1]
        labels: list[np.ndarray] = []
        if count > 1 and worst > self.penalty / 2:
            best, states = np.zeros(count), []
            for a, b in cuts:
                states.append(best)
                best = self._first_labels(self._window(data[a:b])[0], best)[1]
            now = int(best.argmax())
            for (a, b), state in zip(reversed(cuts), reversed(states), strict=True):
                came = self._first_labels(self._window(data[a:b])[0], state)[0]
                own = np.zeros(len(came), np.min_scalar_type(count))
                for t in range(len(came) - 1, -1, -1):
                    own[t] = now
                    now = int(came[t, now])
                labels.insert(0, own)
        spans, weight = [], np.zeros(count)
        for k, (a, b) in enumerate(cuts):
            _, first, last, size, *_ = self._window(data[a:b])
            own = labels[k] if labels else np.full(len(first), constant)
            weight += np.bincount(own, weights=size, minlength=count)
            head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
            for i, j in zip(head.tolist(), [*head[1:].tolist(), len(own)], strict=False):
                span = (int(first[i] + base[k]), int(last[j - 1] + base[k]), self.languages[int(own[i])])
                if spans and spans[-1][2] == span[2]:
                    span = (spans.pop()[0], span[1], span[2])
                spans.append(span)
        k = int(weight.argmax())
        return (self.languages[k], float(weight[k] / weight.sum()), spans) if weight.sum() else ("und", 0.0, [])

    def identify(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, share of the letters in it, spans (start, end, language) in code points) of each text."""
        low = [t.lower() for t in texts]
        low = [b if len(b) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t, b in zip(texts, low, strict=True)]
        data = [t.encode("utf-8", "replace") for t in low]
        raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
        letter, starts, ends = _words(raw)
        edges = np.concatenate(([0], np.cumsum([len(x) + 1 for x in data])))
        lettered = [any(map(str.isalpha, t[:64])) or any(map(str.isalpha, t)) for t in texts]
        nothing = ("und", 0.0, [])
        if not len(starts) or not self.languages:
            return [nothing] * len(texts)
        bounds = np.searchsorted(starts, edges)
        labels = self.labels(self.scores(raw, letter, starts, ends), bounds)
        point = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32)  # code points up to each byte, this one included
        change = np.ones(len(labels), bool)
        change[1:] = labels[1:] != labels[:-1]
        change[bounds[:-1][np.diff(bounds) > 0]] = True
        head = np.flatnonzero(change)
        tail = np.append(head[1:], len(labels)) - 1
        run = list(zip((point[starts[head]] - 1).tolist(), point[ends[tail] - 1].tolist(), labels[head].tolist(), strict=True))
        spans_at = np.searchsorted(head, bounds).tolist()
        base = (np.concatenate(([0], point))[edges]).tolist()
        text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        weight = np.bincount(text * len(self.languages) + labels, weights=ends - starts, minlength=len(texts) * len(self.languages)).reshape(len(texts), -1)
        out = []
        for i in range(len(texts)):
            total = weight[i].sum()
            if not total or not lettered[i]:
                out.append(nothing)
                continue
            k = int(weight[i].argmax())
            out.append((self.languages[k], float(weight[i, k] / total), [(a - base[i], b - base[i], self.languages[x]) for a, b, x in run[spans_at[i] : spans_at[i + 1]]]))
        return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS, penalty: float = PENALTY) -> Model:
    """A model from about `sample` texts a language, of at most `sample_chars` characters, chosen by a hash of the key."""
    own = docs.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.pmod(F.xxhash64(key_col), F.lit(1 << 30)).alias("h"))
    own = own.where("t is not null and l is not null").where(F.length("t") <= sample_chars)
    share = {r[0]: min(1.0, sample / r[1]) for r in own.groupBy("l").count().collect()}  # a row for each language
    if not share:
        return Model([], penalty)
    limits = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(int(v * (1 << 30))))])
    return Model([(r[0], r[1]) for r in own.where(F.col("h") < F.element_at(limits, F.col("l"))).select("t", "l").collect()], penalty)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, lang, score, spans array<struct<start, end, lang>>) of each whole text."""
    kind = docs.select(id_col).dtypes[0][1]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # tables of a fixed size a language
    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(texts, batch):
        model = sent.value
        short = iter(model.identify([x.decode("utf-8", "replace") for x in texts if len(x) <= WINDOW]))
        found = [next(short) if len(x) <= WINDOW else model.identify_long(x) for x in texts]
        spans = pa.array([[{"start": a, "end": b, "lang": x} for a, b, x in f[2]] for f in found], shape)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64()), spans], ["id", "lang", "score", "spans"])

    return map_texts(docs, [id_col], text_col, run, f"id {kind}, lang string, score double, spans array<struct<start long, end long, lang string>>")
