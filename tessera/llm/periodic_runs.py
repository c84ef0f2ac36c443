"""Periodic runs of words by bit-parallel lags.

The words of a text are numbered, and each bit of the numbers is one bit plane: a big integer with a bit a word. At a lag
of q words the planes are XORed with themselves shifted by q and ORed: a zero bit says that two words q apart are equal.
Doubling shifts ANDed together leave the places where enough zeros follow each other, max(q, least - q) of them, so that
a run of period q has at least `least` words and two periods. A lag is given up as soon as a few planes leave no such place.

All lags below SMALL are tried. A longer lag q is tried only if some block of words, at a multiple of its size, is found
again q words on (by a hash of the block, for sizes doubling with the lag): a run of period q holds such a block, so none
is missed. Blocks that lie in a run already known, together with what is found q words on, and whose period divides q
give nothing new and are passed over, so a text of one word over and over needs no more lags than any other.

Of equal stretches that several lags give, the smallest lag is the period: a stretch of two periods or more that has a
smaller period too is a run of that one, with the same ends.

Defined cases: null and wordless texts have no runs and the empty text is what is left of them; whole texts are read, the
longest too, in memory in proportion to their length; white space is \\x20 and \\x09-\\x0D, all else belongs to words, which
are compared byte by byte; repeated rows are treated alike, a null id stays null; other columns are ignored, whatever
their names; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .quality_rules import let, words
from .simhash_dedup import PART, _parts

#: Words that a run has at least, besides two periods.
LEAST = 12
#: Lags that are tried without looking for equal blocks first.
SMALL = 64
#: Planes that are compared before a lag is looked at for the first time.
FIRST_PLANES = 3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def numbered(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words' numbers in order, and the words by number. Long texts are taken apart in parts."""
    known: dict[bytes, int] = {}
    found = [np.zeros(0, np.int32)]
    for part in _parts(text, PART):
        own = part.split()
        for w in set(own).difference(known):
            known[w] = len(known)
        found.append(np.fromiter(map(known.__getitem__, own), np.int32, len(own)))
    return np.concatenate(found), list(known)


def planes(ids: np.ndarray) -> list[int]:
    """One big integer for each bit of the numbers; bit i belongs to word i."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    return [int.from_bytes(np.packbits(ids >> b & 1, bitorder="little").tobytes(), "little") for b in range(top)]


def _starts(equal: int, length: int) -> int:
    """The bits from which `length` bits of `equal` are set, by shifts that double."""
    have = 1
    while have < length and equal:
        step = min(have, length - have)
        equal &= equal >> step
        have += step
    return equal


def stretches(layers: list[int], n: int, lag: int, length: int) -> Iterator[tuple[int, int]]:
    """Maximal (start, end) of places i with equal words at i and i + lag, `length` or more in a row."""
    if n - lag < length:
        return
    all_ = (1 << (n - lag)) - 1
    apart, done = 0, 0
    while True:
        for layer in layers[done : done + FIRST_PLANES]:
            apart |= layer ^ layer >> lag
        done += FIRST_PLANES
        from_here = _starts(all_ & ~apart, length)
        if not from_here:
            return
        if done >= len(layers):
            break
    bits = np.unpackbits(np.frombuffer(from_here.to_bytes((n - lag + 7) // 8, "little"), np.uint8), bitorder="little")
    edge = np.flatnonzero(np.diff(np.concatenate(([0], bits, [0])).astype(np.int8)))
    yield from zip(edge[::2].tolist(), (edge[1::2] + length - 1).tolist(), strict=True)


def _doubled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows of 2 * size words from those of size words."""
    a, b = hashes[:-size], hashes[size:]
    out = (a ^ a >> np.uint64(31)) * _MIX + b
    return (out ^ out >> np.uint64(29)) * _MIX


def _lags(hashes: np.ndarray, size: int, runs: list[tuple[int, int, int]]) -> list[int]:
    """Lags from 2 * size to below 4 * size at which some block of `size` words is found again, outside of known runs."""
    n = len(hashes)
    block, place = [], []
    blocks = np.arange(0, max(0, n - 2 * size), size)
    rows = max(1, (1 << 20) // (2 * size))  # blocks that are looked at together
    padded = np.concatenate((hashes, ~hashes[-1:].repeat(4 * size))) if n else hashes
    for at in range(0, len(blocks), rows):
        some = blocks[at : at + rows]
        view = np.lib.stride_tricks.as_strided(padded[some[0] + 2 * size :], (len(some), 2 * size), (8 * size, 8))
        row, column = np.nonzero(view == hashes[some][:, None])
        column += 2 * size
        inside = some[row] + column < n
        block.append(some[row][inside])
        place.append(column[inside])
    if not block:
        return []
    at, lag = np.concatenate(block), np.concatenate(place)
    if len(at) and runs:
        start, end, period = np.array(sorted(runs), np.int64).T
        ends = np.maximum.accumulate(end)
        last = np.maximum.accumulate(np.where(end == ends, np.arange(len(end)), 0))  # of the runs up to here, the one that ends last
        over = np.searchsorted(start, at, side="right") - 1
        run = last[np.maximum(over, 0)]
        known = (over >= 0) & (at + lag + size <= end[run]) & (lag % period[run] == 0)
        lag = lag[~known]
    return np.unique(lag).tolist()


def find_runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) by start, then period."""
    n, seen = len(ids), {}
    if n < least:
        return []
    layers = planes(ids)

    def look(lag: int) -> None:
        for a, b in stretches(layers, n, lag, max(lag, least - lag)):
            seen.setdefault((a, b + lag), lag)

    for lag in range(1, min(SMALL, n // 2 + 1)):
        look(lag)
    hashes, size = (ids.astype(np.uint64) + np.uint64(1)) * _MIX, 1
    while 2 * size <= n // 2:
        if 2 * size >= SMALL:
            for lag in _lags(hashes, size, [(a, b, q) for (a, b), q in seen.items()]):
                if lag <= n // 2:
                    look(lag)
        hashes = _doubled(hashes, size)
        size *= 2
    return sorted((a, b - a, q) for (a, b), q in seen.items())


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words some run repeats: those behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) > 0


def runs_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Rows (id, n_words, runs array<struct<start, length, period>>, collapsed): each document's runs by start, then
    period, and its words without those that a run repeats, joined by one space."""
    kind = docs.select(f"`{id_col}`").dtypes[0][1]
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(texts, batch):
        counts, found, left = [], [], []
        for text in texts:
            ids, names = numbered(text)
            runs = find_runs(ids, least)
            kept = ids[~dropped(len(ids), runs)] if runs else ids
            counts.append(len(ids))
            found.append([{"start": a, "length": b, "period": q} for a, b, q in runs])
            left.append(b" ".join(map(names.__getitem__, kept.tolist())).decode("utf-8", "replace"))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, shape), pa.array(left, pa.string())], ["id", "n_words", "runs", "collapsed"])

    return map_texts(docs, [id_col], text_col, run, f"id {kind}, n_words long, runs array<struct<start long, length long, period long>>, collapsed string")


def looped(id_: Column, text: Column) -> Column:
    """The text of the query's contract: for one id in ten, words repeat from a place on with a period that the id sets."""
    h = F.crc32(id_.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def loop(w: Column) -> Column:
        n = F.size(w).cast("long")
        start = g % n
        period = F.lit(1) + F.floor((n - start) / (3 + g % 8))
        at = lambda i: F.when(i >= start, start + (i - start) % period).otherwise(i).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, at(i))), " ")).otherwise(F.lit(""))

    return F.when(h % 10 == 0, let(words(F.coalesce(text, F.lit(""))), loop)).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """The longest run of each document (the first, then that of the smallest period, on ties), and digests of all."""
    one = lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))
    best = F.array_min(F.transform("runs", lambda x: F.struct((-x["length"]).alias("less"), x["start"].alias("start"), x["period"].alias("period"))))
    out = found.select("id", "runs", "collapsed", best.alias("best"))
    length = -F.col("best.less")
    return out.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", one), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
