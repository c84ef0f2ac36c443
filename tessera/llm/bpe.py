"""Byte-level BPE encoding and decoding with length-bucketed padded numpy matrices.

Texts are split by a pattern; each distinct piece of a batch becomes a row of byte ids in the matrix of its length
bucket. Every round each row merges its leftmost pair of minimum rank: ranks of neighbouring pairs stand in a second
matrix, looked up in an open-addressing hash table, and a merge compacts the row by one cell. Rows without a pair that
can merge leave the matrix. Pieces longer than LONG bytes would need as many rounds as bytes, so those take the same
merges from a heap over a linked list.

Defined cases: null and empty texts have no ids and decode to empty bytes; whole texts are encoded, whatever their
length; of pairs of equal rank the leftmost merges first; repeated rows are encoded alike; extra columns are dropped
unless named in `keep`; a kept column of the name `ids`, or one of the name `decoded` in a table to decode, gives way to
the new one; no rows give no rows. Any pattern may be passed in; for others than UNIT_PATTERN texts are split whole.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

NONE = np.int32(2**31 - 1)
LONG = 256
#: Entries of the per-worker memory of units; it is emptied when full, which changes no result.
MEMORY = 1 << 17
#: Ids that are decoded at once, and bytes of text that are encoded at once, to bound memory.
DECODE_IDS, ENCODE_BYTES = 1 << 19, 2 << 20
#: Marks a unit at the start of a text; no text holds this code point.
FIRST = "\ud800"
#: The pattern whose pieces never reach over a single space, so that texts may be taken apart there.
UNIT_PATTERN = public_tokenizers.PATTERN


class Codec:
    """Ranks of a byte-level BPE in the format of one base64 token and its rank a line."""

    def __init__(self, rank_file: bytes, pattern: str):
        expression = regex.compile(pattern)
        self.split = lambda text: [m[0] for m in expression.finditer(text)] if expression.groups else expression.findall(text)
        self.in_units = pattern == UNIT_PATTERN
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x)}
        self.first = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(x) for x in self.tokens], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.bits = max(4, int(4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys, slot = left << 32 | right, self._slot(left << 32 | right)
        while len(keys):  # of the keys that want a free slot, one gets it; the rest move on
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = merged[placed]
            keys, merged, slot = keys[~placed], merged[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)
        self.memory: dict[str, bytes] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges into, NONE where it can't."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        out = np.full(len(keys), NONE, np.int32)
        there = self.keys[slot]
        hit = there == keys
        out[hit] = self.values[slot[hit]]
        todo = np.flatnonzero((there != keys) & (there != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (there != -1)]
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of at most `width` bytes, end to end, and the number of each."""
        n = len(pieces)
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(n, width)
        size = np.fromiter(map(len, pieces), np.int64, n)
        ids = self.first[raw]
        cols = np.arange(width)
        ids[cols >= size[:, None]] = -1
        rank = np.full((n, width), NONE, np.int32)
        rank[:, :-1] = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        row, out, counts = np.arange(n), np.full((n, width), -1, np.int32), np.zeros(n, np.int64)
        while len(row):
            at = rank.argmin(axis=1)  # the leftmost of the smallest
            best = rank[np.arange(len(row)), at]
            ended = best == NONE
            if ended.any():
                out[row[ended], : ids.shape[1]] = ids[ended]
                counts[row[ended]] = size[ended]
                go = ~ended
                row, ids, rank, size, at, best = row[go], ids[go], rank[go], size[go], at[go], best[go]
                if not len(row):
                    break
            every = np.arange(len(row))
            ids[every, at] = best
            moved = cols[None, :-1] > at[:, None]
            ids[:, :-1] = np.where(moved, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(cols[None, :-1] >= at[:, None], rank[:, 1:], rank[:, :-1])
            ids[:, -1], rank[:, -1] = -1, NONE
            size -= 1
            if (top := int(size.max())) < ids.shape[1]:
                ids, rank, cols = ids[:, : max(2, top)].copy(), rank[:, : max(2, top)].copy(), cols[: max(2, top)]
            after = np.minimum(at + 1, ids.shape[1] - 1)
            right = np.where(at + 1 < ids.shape[1], ids[every, after], -1)
            rank[every, at] = self.ranks(best, right)
            has = at > 0
            rank[every[has], at[has] - 1] = self.ranks(ids[every[has], at[has] - 1], best[has])
        return out[np.arange(width) < counts[:, None]], counts

    def _heap(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece, by the same merges in the same order."""
        ids = self.first[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        one = lambda a, b: int(self.ranks(np.array([a], np.int32), np.array([b], np.int32))[0])
        known: dict[tuple[int, int], int] = {}
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    pair = (ids[x], ids[y])
                    r = known.get(pair)
                    if r is None:
                        r = known[pair] = one(*pair)
                    if r != NONE:
                        heapq.heappush(heap, (r, x, *pair))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and the number of ids of each."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = np.where(sizes <= 32, sizes + -sizes % 4, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        width[sizes > LONG] = 0
        order, flat, counts = [], [], []
        for w in np.unique(width).tolist():
            where = np.flatnonzero(width == w)
            if w == 0:
                long = [self._heap(pieces[i]) for i in where]
                flat += long
                counts.append(np.array([len(x) for x in long], np.int64))
                order.append(where)
                continue
            step = max(1, (1 << 18) // w)
            for at in range(0, len(where), step):
                part = where[at : at + step]
                ids, many = self._matrix([pieces[i] for i in part.tolist()], w)
                flat.append(ids)
                counts.append(many)
                order.append(part)
        if not order:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        order, counts, flat = np.concatenate(order), np.concatenate(counts), np.concatenate(flat)
        back = np.argsort(order)
        return gather(flat, (np.cumsum(counts) - counts)[back], counts[back]), counts[back]

    def _learn(self, units: list[str]) -> None:
        """Remember the ids of units that are new."""
        heads = [x[1:] for x in units if x[0] == FIRST]
        tails = [x for x in units if x[0] != FIRST]
        split = [self.split(x) for x in heads]
        parts = list(chain.from_iterable(split))
        many = np.fromiter(map(len, split), np.int64, len(split))
        if tails:  # end to end: each begins with the space before it, where no piece goes on
            joined = self.split(" " + " ".join(tails))
            ends = np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))
            upto = np.cumsum(np.fromiter(map(len, tails), np.int64, len(tails)) + 1)
            many = np.concatenate((many, np.diff(np.searchsorted(ends, upto) + 1, prepend=0)))
            parts += joined
        index = dict.fromkeys(parts)
        flat, sizes = self.encode_pieces([x.encode() for x in index])
        for i, x in enumerate(index):
            index[x] = i
        codes = np.fromiter(map(index.__getitem__, parts), np.int64, len(parts))
        ids = gather(flat, (np.cumsum(sizes) - sizes)[codes], sizes[codes]).astype(np.int32).tobytes()
        upto = (4 * np.concatenate(([0], np.cumsum(sizes[codes])))[np.concatenate(([0], np.cumsum(many)))]).tolist()
        names = chain((FIRST + x for x in heads), tails)
        self.memory.update((x, ids[a:b]) for x, a, b in zip(names, upto, upto[1:], strict=False))

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each.

        A piece never reaches over a single space that has no white space after it, so such a text is looked up in
        units between those spaces. A text with other spaces is one unit, and isn't remembered.
        """
        rows = []
        for text in texts:
            units = text.split(" ") if self.in_units else [text]
            units[0] = FIRST + units[0]
            rows.append(units)
        index = dict.fromkeys(chain.from_iterable(rows), 0)
        odd = {x for x in index if not x or x[0].isspace()}
        once = set() if self.in_units else set(index)
        if odd:
            for i, units in enumerate(rows):
                if not odd.isdisjoint(units):
                    rows[i] = [" ".join(units)]
                    once.add(rows[i][0])
            index = dict.fromkeys(chain.from_iterable(rows), 0)
        missing = [x for x in index if x not in self.memory]
        if len(self.memory) + len(missing) > MEMORY:
            self.memory.clear()
            missing = list(index)
        self._learn(missing)
        parts = [self.memory[x] for x in index]
        for x in once:
            self.memory.pop(x, None)
        for i, x in enumerate(index):
            index[x] = i
        flat = np.frombuffer(b"".join(parts), np.int32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        many = np.fromiter(map(len, rows), np.int64, len(rows))
        codes = np.fromiter(map(index.__getitem__, chain.from_iterable(rows)), np.int64, int(many.sum()))
        ids = gather(flat, (np.cumsum(sizes) - sizes)[codes], per := sizes[codes])
        upto = np.concatenate(([0], np.cumsum(per)))[np.concatenate(([0], np.cumsum(many)))]
        return ids, np.diff(upto)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text, from ids end to end."""
        parts = [ids[at : at + DECODE_IDS] for at in range(0, len(ids), DECODE_IDS)]
        data = b"".join([gather(self.bytes, self.offsets[x], self.lengths[x]).tobytes() for x in parts])
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.lengths[ids])))
        upto = ends[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [data[a:b] for a, b in zip(upto, upto[1:], strict=False)]


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size] end to end."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(rank_file: bytes, pattern: str) -> Codec:
    key = (hash(rank_file), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(rank_file, pattern)
    return _codecs[key]


def _rank_file(df: DataFrame, path: str):
    with open(path, "rb") as f:  # on the driver; a vocabulary file's size is fixed
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Rows (*keep, ids array<int>): the ids of each whole text, without special tokens."""
    keep = [c for c in keep if c.lower() != "ids"]
    kinds = ", ".join(f"`{c}` {docs.select(f'`{c}`').dtypes[0][1]}" for c in keep)
    file = _rank_file(docs, path)

    def run(texts, batch):
        ids, counts = _codec(file.value, pattern).encode(x.decode("utf-8", "replace") for x in texts)
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
        return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], [*keep, "ids"])

    return map_texts(docs, list(keep), text_col, run, f"{kinds}, ids array<int>", ENCODE_BYTES)


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The rows of `encoded` with a column `decoded` (binary): the bytes that the ids stand for; null ids are empty."""
    file = _rank_file(encoded, path)
    encoded = encoded.drop(*[c for c in encoded.columns if c.lower() == "decoded" and c != ids_col])
    names = encoded.columns
    at = names.index(ids_col)
    schema = ", ".join(f"`{c}` {k}" for c, k in encoded.dtypes) + ", decoded binary"

    def run(batches):
        codec = None
        for whole in batches:
            codec = codec or _codec(file.value, pattern)
            many = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(whole.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            start = 0
            while start < whole.num_rows:  # rows of about DECODE_IDS ids, one at least
                limit = DECODE_IDS + (int(many[start - 1]) if start else 0)
                end = max(start + 1, int(np.searchsorted(many, limit, side="right")))
                batch = whole.slice(start, end - start)
                counts = np.diff(many[start:end], prepend=many[start - 1] if start else 0)
                start, col = end, batch.column(at)
                data = codec.decode(col.flatten().to_numpy(zero_copy_only=False), counts)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], [*names, "decoded"])

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, keep: list[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Rows (*keep, ids array<int>, decoded binary): what `encode` and then `decode` give, with one Python worker a task."""
    keep = [c for c in keep if c.lower() not in ("ids", "decoded")]
    kinds = "".join(f"`{c}` {docs.select(f'`{c}`').dtypes[0][1]}, " for c in keep)
    file = _rank_file(docs, path)

    def run(texts, batch):
        codec = _codec(file.value, pattern)
        ids, counts = codec.encode(x.decode("utf-8", "replace") for x in texts)
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
        cols = [pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(codec.decode(ids, counts), pa.binary())]
        return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *cols], [*keep, "ids", "decoded"])

    return map_texts(docs, keep, text_col, run, f"{kinds}ids array<int>, decoded binary", ENCODE_BYTES)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digest form of encoding and decoding `documents`."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")
    return round_trip(docs, path, pattern).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
