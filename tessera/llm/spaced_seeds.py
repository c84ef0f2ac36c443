"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters, digits and marks in lower case; ASCII signs and all Unicode white space and punctuation part
them. Characters of scripts written without spaces, and non-ASCII symbols, are tokens of their own. Every window of a benchmark
item and of a document is hashed once per fixed mask; a mask reads the positions marked 1 and ignores those marked 0,
so a substituted token at an ignored position does not hide the hit. Hits of the hash join are verified on the tokens
themselves, byte by byte: along the hit's diagonal the region with the most matches is taken in which there are at least
three matches to a mismatch, and it counts as an overlap if it has `least` matching tokens (for items shorter than
`least / 0.8` tokens: four fifths of the item's tokens, all others counting as mismatches). Some mask of MASKS lies in
every region of 13 matches or more; short items have masks of their own, one for every way to miss a fifth. Items of fewer
than LEAST_ITEM tokens say too little to tell a leak from ordinary text ("Yes" would match every text with that word):
they never overlap, unless `least_item` says otherwise.

Defined cases: null or tokenless texts and items never overlap; repeated document rows give repeated result rows, repeated
items count once each; a pair of document and item is reported once, with its longest overlap (the first in the text on
ties); whole texts are searched, hits of however many items being expanded a bounded number at a time; other columns are
ignored whatever their names; empty tables give no rows. The benchmark is taken in blocks of a bounded size, each
broadcast in turn, at the cost of one more scan of the documents; a worker builds a block's index once.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, settled, small_or_plain

#: No region of 13 matches or more, three to a mismatch, avoids all of them (the tests search through all arrangements).
MASKS = ("111111", "1110111", "1111011", "11011011", "1111101", "11111001", "11110101", "11110011", "1011111")
#: Characters of benchmark text in one broadcast block (its index takes about 30 bytes for each), and tokens of an item at least.
BLOCK_CHARS, LEAST_ITEM = 8_000_000, 5
#: Bytes of text that are hashed at once, and hits or tokens on their diagonals that are looked at once, to bound memory.
CHUNK, HITS = 1 << 20, 1 << 20

_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_SLOT = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_ROUND = np.uint64(0x9E3779B97F4A7C16)
_KEEP = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])


#: Code points of scripts without spaces: Thai, Lao, Tibetan, Myanmar, Tai, Khmer, kana, bopomofo, Han, Yi, and their extensions.
UNSPACED = ((0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x302F), (0x3031, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B16F), (0x1F200, 0x1F2FF), (0x20000, 0x323AF))


@cache
def _kinds() -> np.ndarray:
    """By code point: 0 a part of a token or ASCII, 1 between tokens, 2 a token of its own."""
    kinds = np.zeros(0x110000, np.uint8)
    for i in range(128, 0x110000):
        c = unicodedata.category(chr(i))
        if c[0] in "ZP" or c == "Cc" or i in (0x200B, 0x2060, 0xFEFF):
            kinds[i] = 1
        elif c in ("Sm", "Sc", "So"):
            kinds[i] = 2
    for lo, hi in UNSPACED:
        kinds[lo : hi + 1][kinds[lo : hi + 1] == 0] = 2
    return kinds


def folded(text: bytes) -> bytes:
    """The text in lower case with ASCII spaces for other separators and around characters that are tokens."""
    if text.isascii():
        return text.lower()
    codes = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
    kind = _kinds()[codes]
    codes = np.where(kind == 1, np.uint32(32), codes)
    if (kind == 2).any():
        wide = np.where(kind == 2, 3, 1)
        last, codes = np.cumsum(wide) - 1, np.repeat(codes, wide)
        codes[last[kind == 2]] = codes[last[kind == 2] - 2] = 32
    return codes.astype("<u4").tobytes().decode("utf-32-le").encode()


def token_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 64-bit hash, the first byte and the byte after of every token of folded UTF-8; long data are read in chunks."""
    raw = np.frombuffer(data, np.uint8)
    hashes, starts, ends, at = [], [], [], 0
    while at < len(raw):
        end = min(len(raw), at + CHUNK)
        while end < len(raw) and _KEEP[raw[end]]:
            end += 1
        part = raw[at:end]
        keep = _KEEP[part]
        edge = np.diff(np.concatenate(([False], keep, [False])).astype(np.int8))
        begins = np.flatnonzero(edge == 1)
        if len(begins):
            where = np.arange(len(part))
            sizes = np.diff(np.append(begins, len(part)))
            place = where[begins[0] :] - np.repeat(begins, sizes)
            round_ = place.astype(np.uint64) // np.uint64(64)
            value = _BYTE[part[begins[0] :]] * (_PLACE[place & 63] + round_ * _ROUND) + round_
            value[~keep[begins[0] :]] = 0
            hashes.append(np.add.reduceat(value, begins - begins[0]))
            starts.append(begins + at)
            ends.append(np.flatnonzero(edge == -1) + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def seeds(tokens: np.ndarray, mask: str, terms: list[np.ndarray] | None = None) -> np.ndarray:
    """The hash of the masked window at each position; `terms`: the tokens times the constant of each of the first slots."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask) + (mask.count("1") << 8), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out += terms[k][k : k + n] if terms and k < len(terms) else tokens[k : k + n] * _SLOT[k % 16]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ out >> np.uint64(31)


def slot_terms(tokens: np.ndarray, masks: list[str]) -> list[np.ndarray]:
    return [tokens * x for x in _SLOT[: min(8, max(map(len, masks), default=0))]]


def best_region(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, matches) of the region with the most matches and at least three to a mismatch; the first on ties."""
    run = np.concatenate(([0], np.cumsum(np.where(equal, 1, -3))))
    count = np.concatenate(([0], np.cumsum(equal)))
    first = np.searchsorted(-np.minimum.accumulate(run), -run)  # for each end the earliest start with a net of zero or more
    end = int((count - count[first]).argmax())
    inside = np.flatnonzero(equal[first[end] : end]) + first[end]
    return (int(inside[0]), int(inside[-1]) + 1, len(inside)) if len(inside) else (0, 0, 0)


def short_masks(n: int, misses: int) -> list[tuple[str, int]]:
    """(mask, place in the item) such that any `misses` tokens of an item of `n` tokens lie outside some mask.

    The item is cut into as few parts as leave six marked positions, or into single tokens, and every choice of
    `misses` parts is ignored once.
    """
    out = []
    for parts in range(misses + 1, n + 1):
        sizes = np.array_split(np.arange(n), parts)
        if n - misses * len(sizes[0]) >= 6 or parts == n:
            for gone in combinations(sizes, misses):
                ignored = {int(i) for part in gone for i in part}
                mask = "".join("0" if i in ignored else "1" for i in range(n))
                out.append((mask.strip("0"), mask.index("1")))
            break
    return out


class Index:
    """Seeds of one block of benchmark items: for each mask the hashes in order, with the item and the place of each."""

    def __init__(self, items: list[tuple[int, bytes]], masks: tuple[str, ...], least: int, least_item: int = 1):
        self.ids = [i for i, _ in items]
        texts = [folded(t) for _, t in items]
        self.data = b"\n".join(texts)
        self.flat, self.starts, self.stops = token_hashes(self.data)
        ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
        bounds = np.concatenate(([0], np.searchsorted(self.starts, ends)))
        self.sizes, self.offsets = np.diff(bounds), bounds[:-1]
        self.need = np.where(0.8 * self.sizes >= least, least, np.ceil(0.8 * self.sizes - 1e-9).astype(np.int64))
        owner = np.repeat(np.arange(len(items), dtype=np.int32), self.sizes)
        place = (np.arange(len(self.flat)) - self.offsets[owner]).astype(np.int32)
        rows_of: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        fit = self.sizes >= least_item
        long = (0.8 * self.sizes >= least) & fit
        terms = slot_terms(self.flat, list(masks))
        for mask in masks:
            found = seeds(self.flat, mask, terms)
            at = np.flatnonzero(long[owner[: len(found)]] & (place[: len(found)] + len(mask) <= self.sizes[owner[: len(found)]]))
            rows_of[mask] = [(found[at], owner[at], place[at])]
        for n in np.unique(self.sizes[~long & fit & (self.sizes > 0)]).tolist():
            own = np.flatnonzero((self.sizes == n) & ~long).astype(np.int32)
            whole = self.flat[self.offsets[own][:, None] + np.arange(n)]
            for mask, p in short_masks(n, n - int(self.need[own[0]])):
                keys = _row_seeds(whole[:, p : p + len(mask)], mask)
                rows_of.setdefault(mask, []).append((keys, own, np.full(len(own), p, np.int32)))
        self.masks, self.tables = [], []
        for mask, rows in rows_of.items():
            keys, item, at = (np.concatenate([r[k] for r in rows]) for k in range(3))
            if len(keys):
                order = np.argsort(keys, kind="stable")
                seen = np.zeros(1 << 20, bool)
                seen[(keys >> np.uint64(44)).astype(np.int64)] = True
                self.masks.append(mask)
                self.tables.append((keys[order], item[order], at[order], seen))

    def _diagonals(self, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The distinct (text, item, diagonal) of all hits; a bounded number of hits at a time."""
        found, terms = [], slot_terms(tokens, self.masks)
        for mask, (keys, item, place, seen) in zip(self.masks, self.tables, strict=True):
            got = seeds(tokens, mask, terms)
            at = np.flatnonzero(seen[(got >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, got[at]), np.searchsorted(keys, got[at], side="right")
            many = hi - lo
            at, lo, many = at[many > 0], lo[many > 0], many[many > 0]
            for part in _runs(many):
                k, first, where = many[part], lo[part], np.repeat(at[part], many[part])
                entry = np.repeat(first - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
                text = np.searchsorted(bounds, where, side="right") - 1
                found.append(np.unique(np.stack((text, item[entry], where - place[entry]), axis=1), axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def _matching(self, tokens: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Those (text, item, diagonal, first, last) on whose diagonal enough tokens match; first and last in the item."""
        text, item, diagonal = rows.T
        first, last = np.maximum(0, bounds[text] - diagonal), np.minimum(self.sizes[item], bounds[text + 1] - diagonal)
        size, kept = last - first, []
        for part in _runs(size):
            n = size[part]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            equal = self.flat[np.repeat((self.offsets[item] + first)[part], n) + step] == tokens[np.repeat((diagonal + first)[part], n) + step]
            kept.append(np.add.reduceat(equal, np.cumsum(n) - n, dtype=np.int64) >= self.need[item[part]])
        return np.column_stack((rows, first, last))[np.concatenate(kept)] if kept else np.zeros((0, 5), np.int64)

    def overlaps(self, data: bytes, tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, first token in the text, first token in the item, tokens, matches) of texts end to end in `data`."""
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for text, i, diagonal, first, last in self._matching(tokens, bounds, self._diagonals(tokens, bounds)).tolist():
            lo, own = int(bounds[text]), int(self.offsets[i])
            equal = self.flat[own + first : own + last] == tokens[diagonal + first : diagonal + last]
            for k in np.flatnonzero(equal).tolist():
                t, u = diagonal + first + k, own + first + k
                equal[k] = data[starts[t] : ends[t]] == self.data[self.starts[u] : self.stops[u]]
            if np.count_nonzero(equal) < self.need[i]:
                continue
            start, end, matches = best_region(equal)
            if matches < self.need[i]:
                continue
            new = (matches, -(diagonal + first + start - lo), first + start, end - start)
            if (text, i) not in best or new[:2] > best[text, i][:2]:
                best[text, i] = new
        return [(text, i, -b[1], b[2], b[3], b[0]) for (text, i), b in sorted(best.items())]


def _row_seeds(rows: np.ndarray, mask: str) -> np.ndarray:
    """The seed of each row, all of the mask's length."""
    flat = np.ascontiguousarray(rows).ravel()
    return seeds(flat, mask)[:: rows.shape[1]]


#: The index that this worker built last, by the name of its block.
_BUILT: dict[str, Index] = {}


def _index(name: str, items: list[tuple[int, bytes]], *how) -> Index:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Index(items, *how)
    return _BUILT[name]


def _runs(many: np.ndarray) -> list[slice]:
    """Consecutive slices of about HITS in sum, one element at least."""
    if not len(many):
        return []
    cut = np.flatnonzero(np.diff((np.cumsum(many) - many) // HITS)) + 1
    return [slice(a, b) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(many)], strict=True)]


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, least: int = 13, block_chars: int = BLOCK_CHARS, least_item: int = LEAST_ITEM) -> DataFrame:
    """Rows (id, item, text_start, item_start, n_tokens, n_matches), in tokens: overlaps of documents with items."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), F.lower(F.col(item_text)).alias("t")).where("t is not null")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks, stamp = max(1, math.ceil(chars / block_chars)), uuid.uuid4().hex
    kind, item_kind = docs.select(id_col).dtypes[0][1], items.dtypes[0][1]

    def one(block: int) -> DataFrame:
        mine = items.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == block) if blocks > 1 else items
        sent = spark.sparkContext.broadcast([(r[0], r[1].encode()) for r in mine.collect()])  # of a block's size

        def run(texts, batch):
            index = _index(f"{stamp}-{block}", sent.value, masks, least, least_item)
            low = [folded(x) for x in texts]
            data = b"\n".join(low)
            tokens, starts, stops = token_hashes(data)
            ends = np.cumsum([len(x) + 1 for x in low])
            bounds = np.concatenate(([0], np.searchsorted(starts, ends)))
            rows = index.overlaps(data, tokens, starts, stops, bounds)
            if not rows:
                return None
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3, 4, 5)]
            names = pa.array([index.ids[r[1]] for r in rows], pa.int64() if item_kind in ("bigint", "long") else None)
            return pa.RecordBatch.from_arrays([ids, names, *cols], ["id", "item", "text_start", "item_start", "n_tokens", "n_matches"])

        return map_texts(docs, [id_col], text_col, run, f"id {kind}, item {item_kind}, text_start long, item_start long, n_tokens long, n_matches long", most_bytes=2 << 20)

    return reduce(DataFrame.unionByName, map(one, range(blocks)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents that overlap no item. Rows with a null id are judged together, as one document."""
    bad = settled(overlaps(docs, benchmark, id_col=id_col, **how).select(F.col("id").alias("__bad")).distinct())  # else counted and joined from two searches
    return docs.join(small_or_plain(bad), docs[id_col].eqNullSafe(bad["__bad"]), "left_anti")
