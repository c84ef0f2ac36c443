"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded from its own characters and words (shares and
neighbourhoods of character classes, word lengths, repeats), through a learned layer. Gated attention weighs the
passages, the weights being learned from document labels alone, and the weighted sum of the encodings is scored:

    h = tanh(W x + b);  a = softmax over the bag of w . (tanh(V h) * sigmoid(U h));  score = sigmoid(c . sum(a h) + d)

The model is fitted on the driver, on a bounded sample of labelled documents, by full-batch Adam with a fixed seed. The
encoder sees the shape of passages, not their meaning: fluent text that is wrong looks like a good one.

Defined cases: a null or wordless text is one empty passage and is scored like any other bag; texts over PART bytes are
cut at white space into parts whose passages join one bag; whole texts are scored; repeated rows get equal scores;
other columns are ignored; without training documents, or with one class only, the score is the smoothed share of good
ones; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, small_or_plain

PASSAGE = 50
PART = 1 << 20
#: Labelled documents of each class that the model is fitted on, at most about, and characters of each.
SAMPLE, SAMPLE_CHARS = 1500, 20_000

#: Character classes: 0 space, 1 line end, 2 lower case, 3 upper case, 4 digit, 5 sentence marks, 6 other ASCII, 7 leading and 8 following non-ASCII bytes.
_CLASS = np.full(256, 6, np.int8)
_CLASS[[9, 11, 12, 13, 32]] = 0
_CLASS[10] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 2, 3, 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[192:], _CLASS[128:192] = 7, 8
KINDS = 9
WIDTH = KINDS + KINDS * KINDS + 7


def passages(data: bytes) -> np.ndarray:
    """One row of features for each passage; one zero row if there is no word."""
    raw = np.frombuffer(data, np.uint8)
    kind = _CLASS[raw]
    inside = kind > 1
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros((1, WIDTH), np.float32)
    count = -(-len(starts) // PASSAGE)
    heads = starts[::PASSAGE]
    mine = np.repeat(np.arange(count, dtype=np.int32), np.diff(np.append(heads, len(raw))))
    body = kind[heads[0] :]
    size = np.bincount(mine, minlength=count).astype(np.float32)[:, None]
    single = np.bincount(mine * KINDS + body, minlength=count * KINDS).reshape(count, KINDS) / size
    pair = body[:-1] * np.int32(KINDS) + body[1:]
    double = np.bincount(mine[:-1] * (KINDS * KINDS) + pair, minlength=count * KINDS * KINDS).reshape(count, -1) / size
    lengths = (ends - starts).astype(np.float64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw[starts[0] :].astype(np.uint64) + np.uint64(1)) * _powers(len(raw) - starts[0]))))
    word = (sums[ends - starts[0]] - sums[starts - starts[0]]) * _powers(len(raw) + 1)[::-1][starts]
    at = np.arange(0, len(starts), PASSAGE)
    n = np.diff(np.append(at, len(starts))).astype(np.float64)
    mean = np.add.reduceat(lengths, at) / n
    spread = np.sqrt(np.maximum(0, np.add.reduceat(lengths * lengths, at) / n - mean * mean))
    same = np.concatenate(([False], word[1:] == word[:-1])).astype(np.float64)
    of = np.repeat(np.arange(count), n.astype(np.int64))
    order = np.lexsort((word, of))
    twin = np.concatenate(([False], (word[order][1:] == word[order][:-1]) & (of[order][1:] == of[order][:-1])))
    again = np.bincount(of[order], weights=twin, minlength=count) / n
    odd = np.add.reduceat((kind[ends - 1] == 6).astype(np.float64), at) / n
    wordy = np.stack((mean / 10, spread / 10, np.add.reduceat(same, at) / n, again, odd, n / PASSAGE, np.maximum.reduceat(lengths, at) / 50), axis=1)
    return np.concatenate((single, double, np.minimum(wordy, 5)), axis=1).astype(np.float32)


_table = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2 ** 64."""
    global _table
    if len(_table) < n:
        _table = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n, PART + 1024), 0x9E3779B97F4A7C15, np.uint64))))
    return _table[:n]


def bags(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Passage features end to end, and the number of passages of each text."""
    rows, counts = [], []
    for text in texts:
        parts = [text]
        if len(text) > PART:
            parts, at = [], 0
            while at < len(text):
                end = min(len(text), at + PART)
                while end < len(text) and end - at < 2 * PART and _CLASS[text[end]] > 1:
                    end += 1
                parts.append(text[at:end])
                at = end
        found = [passages(x) for x in parts]
        rows += found
        counts.append(sum(map(len, found)))
    return np.concatenate(rows) if rows else np.zeros((0, WIDTH), np.float32), np.array(counts, np.int64)


class Model:
    """Gated attention over bags."""

    def __init__(self, share: float):
        self.share, self.weights = share, None

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 250, rate: float = 0.02, decay: float = 1e-4) -> Model:
        rng = np.random.default_rng(0)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        w = {"W": draw(WIDTH, hidden), "b": np.zeros(hidden, np.float32), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate, 1), "c": draw(hidden, 1), "d": np.zeros(1, np.float32)}
        slope, power = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        at, bag = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
        for step in range(1, epochs + 1):
            g = self._gradient(w, x, at, bag, y)
            for k in w:
                grad = g[k] + decay * w[k]
                slope[k] = 0.9 * slope[k] + 0.1 * grad
                power[k] = 0.99 * power[k] + 0.01 * grad * grad
                w[k] = (w[k] - rate * (slope[k] / (1 - 0.9**step)) / (np.sqrt(power[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        self.weights = w
        return self

    @staticmethod
    def _gradient(w, x, at, bag, y) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of the bags' labels."""
        h, v, u, a, z, p = Model._forward(w, x, at, bag)
        g = {}
        dz = ((p - y) / len(y))[:, None].astype(x.dtype)
        g["c"], g["d"] = z.T @ dz, dz.sum(axis=0)
        dzh = dz @ w["c"].T
        dh = a * dzh[bag]
        da = (h * dzh[bag]).sum(axis=1, keepdims=True)
        ds = a * (da - np.add.reduceat(a * da, at)[bag])
        g["w"] = (v * u).T @ ds
        dv, du = ds @ w["w"].T * u * (1 - v * v), ds @ w["w"].T * v * u * (1 - u)
        g["V"], g["U"] = h.T @ dv, h.T @ du
        dh += dv @ w["V"].T + du @ w["U"].T
        dh *= 1 - h * h
        g["W"], g["b"] = x.T @ dh, dh.sum(axis=0)
        return g

    @staticmethod
    def _forward(w, x, at, bag):
        h = np.tanh(x @ w["W"] + w["b"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        s = (v * u) @ w["w"]
        e = np.exp(s - np.maximum.reduceat(s, at)[bag])
        a = e / np.add.reduceat(e, at)[bag]
        z = np.add.reduceat(a * h, at)
        return h, v, u, a, z, 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)[:, 0]))

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[float]]]:
        """The score of each text and the attention of its passages."""
        x, counts = bags(texts)
        if self.weights is None or not len(counts):
            return np.full(len(counts), self.share), [[1.0 / k] * k for k in counts.tolist()]
        x = np.clip((x - self.mean) / self.scale, -8, 8).astype(np.float32)
        at = np.cumsum(counts) - counts
        a, p = (f := self._forward(self.weights, x, at, np.repeat(np.arange(len(counts)), counts)))[3], f[5]
        return p, [y.tolist() for y in np.split(a[:, 0], at[1:])]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from about `sample` labelled documents of each class, chosen by a hash of the id."""
    marks = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    marks = marks.groupBy("i").agg(F.min("y").alias("y")).withColumn("h", F.pmod(F.xxhash64("i"), F.lit(1 << 30)))
    total = {r[0]: r[1] for r in marks.groupBy("y").count().collect()}
    share = (total.get(1, 0) + 1) / (sum(total.values()) + 2)
    if len(total) < 2:
        return Model(share)
    limit = lambda y: int(min(1.0, sample / total[y]) * (1 << 30))
    chosen = marks.where(F.col("h") < F.when(F.col("y") == 1, limit(1)).otherwise(limit(0))).select("i", "y")
    own = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).where(F.length("t") <= sample_chars)
    rows = sorted((r[0], r[1], r[2]) for r in own.join(small_or_plain(chosen), "i").select("i", "t", "y").collect())  # the sample
    y = np.array([r[2] for r in rows], np.float32)
    if not 0 < y.sum() < len(y):
        return Model(share)
    return Model(share).fit(*bags(r[1].encode() for r in rows), y)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score, attention array<float>) of each whole text."""
    kind = docs.select(id_col).dtypes[0][1]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size

    def run(texts, batch):
        p, a = sent.value.score(texts)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.astype(np.float64)), pa.array(a, pa.list_(pa.float32()))], ["id", "score", "attention"])

    return map_texts(docs, [id_col], text_col, run, f"id {kind}, score double, attention array<float>")
