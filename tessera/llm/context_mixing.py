"""Language-model scores by online logistic context mixing over bits, and smoothed word frequencies beside them.

A text is its words, A-Z in lower case, each closed by a space, and one end. Every byte is spelled by the bits of its code
in a Huffman tree of the corpus's bytes. For each bit several predictors look up how often it was one or zero in the training
documents: under the last one, three and five bytes of the word, and under all of the word so far, hashed together
with the place in the tree. One more predicts the word that followed the last word's previous appearance in the same text. Their logits
are added up by weights, of which a set is chosen by how that last prediction fares and by how far the word has come;
after every few bits the weights in use move against their errors, and each result is refined by a table of what came of
like results, which moves too. The text's probability is the product over its bits.

What is learned: the count of every word over all training documents, found by one shuffle and joined back to every block
of texts; it grows with the corpus. The predictors' tables are counted from those word counts (each word brings its bits
as often as it occurs), in SLOTS hashed slots a predictor, so that they can be sent to every task whatever the corpus's
size. The predictors' first weights are fitted to every word of all training documents, as often as it occurs, each bit's
own occurrence left out of the counts: ROUNDS steps of Newton's method, whose sums the tasks bring together. What a
prediction of the next word weighs at first is a constant, and so is the table. Weights and table start anew after each
STRETCH bits of a text, so that stretches of many texts go through together.

Texts are read once, into blocks: the numbers of their words in a dictionary of the block. Long texts are taken apart at
white space and their parts' scores added up; words over LONG bytes are spelled in parts. Bits of texts are laid out for
about three times SIDE_BY_SIDE stretches at a time, however long the texts are. Memory goes with the block, or with the longest word.

Defined cases: null and empty texts are one end; white space is \\x20 and \\x09-\\x0D, all else belongs to words, which are
compared byte by byte; without training documents all counts are zero; repeated rows are scored alike and each counts in
training; a null id is scored and, since no remainder is known of it, learned from like any other that is not held out;
other columns are ignored, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, settled
from .simhash_dedup import LOWER, _parts

#: Bytes of text in a block, of those whose words are foretold together, and bytes above which a word is spelled in parts.
BLOCK, GROUP, LONG = 8 << 20, 1 << 20, 2048
#: Bytes of a block's texts whose words' bits are held at once.
HELD = 4 << 20
#: Bytes of words that are spelled together, about.
SOME = 1 << 16
#: Contexts: so many last bytes of the word, -1 for all of it; slots of each one's table.
ORDERS, SLOTS = (1, 3, 5, -1), 1 << 20
#: Bits after which weights start anew, those with one set of weights after which it moves, and stretches side by side.
STRETCH, TOGETHER, SIDE_BY_SIDE = 2048, 32, 1024
#: Inputs of the mixer, in 64 bits: the predictors, none, the word predicted to come, a constant; sets of weights: 3 states by 3 places.
INPUTS, SAID, STATES, PLACES = 8, 5, 3, 3
#: Input units a logit, and the greatest input; bits are counted with DELTA more.
UNIT, MOST, DELTA = 16.0, 127, 0.05
#: What a prediction of the next word counts, in input units; words up to so many bytes are predicted; its first weights by state, times UNIT.
FORETOLD, FORETOLD_BYTES, FIRST = 32, 64, (0.25, 0.5, 1.5)
#: Cells of the refining table by state; steps of weights and cells.
CELLS, WEIGHT_STEP, CELL_STEP = 24, 0.00002, 0.01
#: Steps of the fit of the first weights, and how much of the mean curvature holds them where they were.
ROUNDS, HOLD = 1, 0.01
#: Words whose bits one task counts, about.
WORDS_A_TASK = 400_000
END, CLOSE = b"\n", b" "
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), 0x100000001B3


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte the length of its code, its bits and the numbers of the nodes where they are read; rows by byte."""
    heap = [(int(c) + 1, s, s) for s, c in enumerate(counts)]  # (count, first byte, tree)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), (a[2], b[2])))
    length, paths, made, todo = np.zeros(256, np.int32), {}, 0, [(heap[0][2], (), ())]
    while todo:
        tree, bits, nodes = todo.pop()
        if isinstance(tree, int):
            length[tree], paths[tree] = len(bits), (bits, nodes)
            continue
        node, made = made, made + 1
        todo += [(tree[k], (*bits, k), (*nodes, node)) for k in (0, 1)]
    bits, nodes = np.zeros((256, length.max()), np.uint8), np.zeros((256, length.max()), np.int32)
    for s, (b, n) in paths.items():
        bits[s, : len(b)], nodes[s, : len(n)] = b, n
    return length, bits, nodes


def portions(sizes: np.ndarray, most: int) -> list[slice]:
    """Consecutive slices of about `most` in sum, one element at least."""
    if not len(sizes):
        return []
    cut = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most)) + 1
    return [slice(a, b) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(sizes)], strict=True)]


def lengths(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, words), np.int64, len(words))


def spell(words: list[bytes], code: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a few closed words the number of bits each, and for every bit itself, its place and the predictors' slots.

    The place is 0, 1 or 2: in the first, the second or a later byte. Contexts of any length are differences of one
    running polynomial over all bytes, taken back to where they start.
    """
    length, bits, nodes = code
    data = np.frombuffer(b"".join(words), np.uint8)
    sizes = lengths(words)
    start = np.cumsum(sizes) - sizes
    at = (np.arange(len(data)) - np.repeat(start, sizes)) % LONG
    many = length[data]
    ends = np.cumsum(many)
    byte = np.repeat(np.arange(len(data), dtype=np.int32), many)
    depth = np.arange(len(byte), dtype=np.int32) - np.repeat((ends - many).astype(np.int32), many)
    power, back = (np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(max(0, len(data) - 1), x, np.uint64), dtype=np.uint64))) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)))
    cell = (data.astype(np.int32) * bits.shape[1]).take(byte)
    cell += depth
    node = ((nodes.astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B)).ravel().take(cell)
    here, slots = np.arange(len(data)), []
    for order in ORDERS:
        since = here - at if order < 0 else here - np.minimum(at, order)
        context = (total[here] - total[since]) * back[since] + (here - since).astype(np.uint64) * _MIX + np.uint64(order & 255)
        context = ((context ^ context >> np.uint64(29)) * _MIX >> np.uint64(32)).astype(np.uint32)
        slot = context.take(byte)
        slot += node
        slot *= np.uint32(0x9E3779B1)
        slot >>= np.uint32(33 - SLOTS.bit_length())
        slots.append(slot.view(np.int32))
    return np.add.reduceat(many, start) if len(words) else sizes, bits.ravel().take(cell), np.minimum(at, PLACES - 1).astype(np.uint8).take(byte), slots


def count_bits(words: list[bytes], counts: np.ndarray, code, out: np.ndarray | None = None) -> np.ndarray:
    """Zeros and ones by predictor and slot, shape (predictors, 2, SLOTS), of closed words that come so often; added to `out` in place."""
    out = np.zeros((len(ORDERS), 2, SLOTS)) if out is None else out
    for part in portions(lengths(words), SOME):
        many, bit, _, slots = spell(words[part], code)
        weight = np.repeat(counts[part].astype(np.float64), many)
        side = bit.astype(np.int32) * np.int32(SLOTS)
        for k, own in enumerate(slots):
            np.add.at(out[k].reshape(-1), own + side, weight)
    return out


def logits(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(UNIT * np.log((ones + DELTA) / (zeros + DELTA))), -MOST, MOST).astype(np.int8)


@dataclass
class Spelled:
    """The bits of a list of words, end to end, and their predictors' inputs in columns, with room for others.

    Column SAID has the bit itself and twice its place, and of a bit in a text eight times its state (0 without a prediction,
    1, or 2 if the last one came true), so that one look in memory gives all there is to a bit.
    """

    first: np.ndarray  # of each word its first bit; one more than words
    bit: np.ndarray
    inputs: np.ndarray


def spelled(words: list[bytes], code, look) -> Spelled:
    """`look(k, slots, bit)`: the inputs of predictor k."""
    parts = portions(lengths(words), SOME)
    total = sum(int(code[0].take(np.frombuffer(b"".join(words[part]), np.uint8)).sum()) for part in parts)
    many, bit, inputs, at = [np.zeros(1, np.int64)], np.empty(total, np.uint8), np.zeros((total, INPUTS), np.int8), 0
    for part in parts:
        n, b, where, slots = spell(words[part], code)
        own = inputs[at : at + len(b)]
        for k, x in enumerate(slots):
            own[:, k] = look(k, x, b)
        own[:, SAID], own[:, INPUTS - 1] = b | where << 1, int(UNIT)
        bit[at : at + len(b)] = b
        many.append(n)
        at += len(b)
    return Spelled(np.cumsum(np.concatenate(many)), bit, inputs)


@dataclass
class Told:
    """The words of texts, end to end, and what is foretold of them."""

    tokens: np.ndarray  # numbers of words
    first: np.ndarray  # of each its first bit; one more than tokens
    guess: np.ndarray  # the word that is foretold, -1 for none
    right: np.ndarray  # whether it comes
    came: np.ndarray  # whether the last one's came
    shared: np.ndarray  # bits before the last that is foretold


def foretell(words: list[bytes], tokens: np.ndarray, bounds: np.ndarray, own: Spelled) -> Told:
    """What is foretold in texts of `tokens` (numbers of words; `bounds` has each text's first one)."""
    n = len(tokens)
    length = np.diff(own.first)[tokens]
    starts = bounds[:-1][np.diff(bounds) > 0]
    before = np.concatenate(([len(words)], tokens[:-1]))[:n]
    before[starts] = len(words)
    key = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * (len(words) + 1) + before
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order][1:] == key[order][:-1])
    guess = np.full(n, -1)
    guess[order[again + 1]] = tokens[order[again]]
    guess[(guess >= 0) & (lengths(words) > FORETOLD_BYTES)[np.maximum(guess, 0)]] = -1
    right = guess == tokens
    shared = length - 1  # all of a word that comes true are foretold rightly
    rest, k = np.flatnonzero((guess >= 0) & ~right), 0
    while len(rest):
        shared[rest] = k
        rest = rest[own.bit[own.first[tokens[rest]] + k] == own.bit[own.first[guess[rest]] + k]]
        k += 1
    came = np.concatenate(([False], right[:-1]))[:n]
    came[starts] = False
    return Told(tokens, np.concatenate(([0], np.cumsum(length))), guess, right, came, shared)


def lay_out(told: Told, own: Spelled, low: int, high: int) -> np.ndarray:
    """uint64: of each bit from `low` to `high` the inputs of its word, with the prediction and its state."""
    some = slice(int(np.searchsorted(told.first, low, "right")) - 1, int(np.searchsorted(told.first, high)))
    first, until = told.first[some], told.first[some.start + 1 : some.stop + 1]
    source = np.repeat((own.first[told.tokens[some]] - first + low).astype(np.int32), np.minimum(until, high) - np.maximum(first, low))
    source += np.arange(high - low, dtype=np.int32)
    inputs = own.inputs.view(np.uint64).ravel().take(source)
    del source
    cells, which = inputs.view(np.int8).reshape(-1, INPUTS), np.flatnonzero(told.guess[some] >= 0)
    start, last = np.maximum(first[which], low) - low, first[which] + told.shared[some][which] - low
    many = np.maximum(0, np.minimum(last + 1, high - low) - start)
    at = np.repeat(start - (np.cumsum(many) - many), many)
    at += np.arange(len(at))
    said = cells[at, SAID]
    cells[at, INPUTS - 2] = (2 * FORETOLD * (said & 1) - FORETOLD).astype(np.int8)
    cells[at, SAID] = said | np.repeat(8 * (1 + told.came[some][which].astype(np.int8)), many)
    cells[last[~told.right[some][which] & (last >= 0) & (last < high - low)], INPUTS - 2] *= -1
    return inputs


def start_weights() -> tuple[np.ndarray, np.ndarray]:
    weights = np.full((STATES * PLACES, INPUTS), 0.25 / UNIT, np.float32)
    weights[:, -1] = 0
    weights[:, INPUTS - 2] = np.repeat(FIRST, PLACES) / UNIT
    middle = (np.arange(CELLS) - CELLS // 2 + 0.5) / 1.5
    return weights, np.tile(1 / (1 + np.exp(-middle)), STATES).astype(np.float32)


def mix(told: Told, own: Spelled, bounds: np.ndarray, weights: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """log10 of each text's probability; `bounds` has each text's first token.

    The stretches of all texts go through side by side, the longest first, so that those which go on are always the first.
    """
    first = told.first[bounds]
    many = -(-np.diff(first) // STRETCH)
    start = np.repeat(first[:-1], many) + STRETCH * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    size = np.minimum(STRETCH, np.repeat(first[1:], many) - start)
    logs, full = np.zeros(len(start)), 3 * SIDE_BY_SIDE * STRETCH
    for part in portions(size, -(-int(size.sum()) // max(1, round(int(size.sum()) / full)))):
        low = int(start[part.start])
        inputs = lay_out(told, own, low, int(start[part.stop - 1] + size[part.stop - 1]))
        order = part.start + np.argsort(-size[part], kind="stable")
        for at in range(0, len(order), SIDE_BY_SIDE):
            some = order[at : at + SIDE_BY_SIDE]
            logs[some] = _mix_some(inputs, start[some] - low, size[some], weights, cells)
        del inputs  # before the next are laid out
    out = np.zeros(len(many))
    if len(logs):
        out[many > 0] = np.add.reduceat(logs, (np.cumsum(many) - many)[many > 0])
    return out


def _mix_some(inputs: np.ndarray, start, size, weights, cells) -> np.ndarray:
    """log10 of each stretch's probability. Arrays have stretches in columns, so that what is done to one bit of all is done at once."""
    rows, sets, used = len(start), len(weights), [*range(len(ORDERS)), INPUTS - 2]
    w, a = np.tile(weights.T, (1, rows)), np.tile(cells, rows)
    set_of, cell_of = np.arange(rows) * sets, np.arange(rows) * len(cells)
    logs, chunk = np.zeros(rows), 2 * TOGETHER
    columns, room, spare = np.empty((len(used), chunk, rows), np.float32), np.empty((TOGETHER, rows), np.float32), np.empty((TOGETHER, rows), np.float32)
    for low in range(0, int(size.max()) if rows else 0, chunk):
        k = int(np.searchsorted(-size, -low, side="left"))  # the stretches that are longer
        x = inputs.take(start[:k] + np.arange(low, low + chunk)[:, None], mode="clip").view(np.int8).reshape(chunk, k, INPUTS)
        for c, j in enumerate(used):
            columns[c, :, :k] = x[:, :, j]
        said = x[:, :, SAID]
        y, first, middle = (said & 1).astype(np.float32), said[::TOGETHER], ((said >> 3) * np.int8(CELLS) + np.int8(CELLS // 2)).astype(np.float32)
        chosen = set_of[:k] + (first >> 3) * PLACES + (first >> 1 & 3)
        left, product = size[:k] - low, np.ones(k)
        for g in range(0, chunk, TOGETHER):
            n = int(np.searchsorted(-size, -(low + g), side="left"))
            if not n:
                break
            now, use, real = columns[:, g : g + TOGETHER, :n], chosen[g // TOGETHER, :n], y[g : g + TOGETHER, :n]
            logit, p = room[:, :n], spare[:, :n]
            np.multiply(now[0], w[used[0]].take(use), out=logit)
            for c in range(1, len(used)):
                logit += np.multiply(now[c], w[used[c]].take(use), out=p)
            logit += w[-1].take(use) * np.float32(UNIT)
            np.clip(logit, -7.9, 7.9, out=logit)
            np.exp(np.negative(logit, out=p), out=p)
            p += 1
            np.reciprocal(p, out=p)
            logit *= np.float32(1.5)
            logit += middle[g : g + TOGETHER, :n]  # above zero, where whole numbers are cut off downwards
            at = logit.astype(np.intp)
            at += cell_of[:n]
            seen = a.take(at)
            error = np.subtract(real, p, out=logit)
            p += seen
            p *= np.float32(-0.5)
            p += real
            chance = np.subtract(1, np.abs(p, out=p), out=p)
            becomes = real - seen
            becomes *= np.float32(CELL_STEP)
            becomes += seen
            if left[n - 1] < g + TOGETHER:  # some stretches end here
                inside = np.arange(g, g + TOGETHER)[:, None] < left[:n]
                error *= inside
                chance[~inside] = 1
                a[at[inside]] = becomes[inside]
            else:
                a[at] = becomes
            step = np.float32(WEIGHT_STEP)
            for c, j in enumerate(used):
                w[j, use] += np.multiply(error, now[c], out=becomes).sum(axis=0) * step
            w[-1, use] += error.sum(axis=0) * (step * np.float32(UNIT))
            product[:n] *= (chance[::4] * chance[1::4] * chance[2::4] * chance[3::4]).astype(np.float64).prod(axis=0)
        logs[:k] += np.log10(product)
    return logs


@dataclass
class Model:
    """The code, the predictors' tables, the first weights and cells, and the counts that all words share."""

    code: tuple[np.ndarray, np.ndarray, np.ndarray]
    tables: np.ndarray  # int8 (predictors, SLOTS)
    weights: np.ndarray
    cells: np.ndarray
    tokens: int
    distinct: int
    ends: int


def bit_logs(own: Spelled, words: list[bytes], tokens: np.ndarray, bounds: np.ndarray, model: Model) -> np.ndarray:
    """log10 of the probability of each text; `words` are closed."""
    return mix(foretell(words, tokens, bounds, own), own, bounds, model.weights, model.cells)


def pulls(words: list[bytes], counts: np.ndarray, code, others: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The slopes, then the curvature, of the log-likelihood of closed words that come so often, shape (PLACES, inputs, 1 + inputs).

    `weights` (PLACES, inputs) are those of the predictors and the constant; `others` (predictors, 2, SLOTS) their inputs
    without the zero, or the one, that is looked at.
    """
    wide = len(ORDERS) + 1
    out = np.zeros((PLACES, wide, 1 + wide))
    for part in portions(lengths(words), SOME):
        many, bit, where, slots = spell(words[part], code)
        side, often = bit.astype(np.int32) * np.int32(SLOTS), np.repeat(counts[part].astype(np.float32), many)
        inputs = [others[k].ravel().take(x + side) for k, x in enumerate(slots)]
        for place in range(PLACES):
            own = np.flatnonzero(where == place)
            x = np.full((wide, len(own)), UNIT, np.float32)
            for k, column in enumerate(inputs):
                x[k] = column.take(own)
            n = often.take(own)
            p = 1 / (1 + np.exp(-np.clip(weights[place].astype(np.float32) @ x, -7.9, 7.9)))
            out[place, :, 0] += x @ (n * (bit.take(own) - p))
            n *= p * (1 - p)
            out[place, :, 1:] += (x * n) @ x.T
    return out


def stepped(weights: np.ndarray, found: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Weights (PLACES, inputs) after a step of Newton's method, held near `start` where nothing pulls."""
    slopes, curves = found[:, :, 0], found[:, :, 1:]
    hold = HOLD * np.trace(curves, axis1=1, axis2=2)[:, None] / len(start[0]) + 1e-9
    return weights + np.linalg.solve(curves + hold[:, :, None] * np.eye(len(start[0])), (slopes + hold * (start - weights))[:, :, None])[:, :, 0]


def _closed(words: list[bytes]) -> list[bytes]:
    """Words as they are spelled, and the end as the last."""
    return [*[w + CLOSE for w in words], END]


def _bytes(x: pa.Array) -> list[bytes]:
    """The values of strings or binaries without nulls; `to_pylist` takes ten times as long."""
    x = x.cast(pa.binary())
    _, ends, data = x.buffers()
    if not len(x) or data is None:
        return [b""] * len(x)
    at, data = np.frombuffer(ends, np.int32)[x.offset : x.offset + len(x) + 1].tolist(), data.to_pybytes()
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


def _numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of texts in order of their first appearance, the texts' words by number, and each text's first one."""
    lower = pa.array([text.translate(LOWER) for text in texts], pa.binary())
    split = pc.ascii_split_whitespace(lower.view(pa.string()))  # white space at either end gives an empty string there
    coded = split.values.dictionary_encode()
    words, tokens, ends = _bytes(coded.dictionary), coded.indices.to_numpy(), split.offsets.to_numpy()
    if b"" in words:
        none = words.index(b"")
        real = tokens != none
        tokens, ends = tokens[real], np.concatenate(([0], np.cumsum(real)))[ends]
        tokens = tokens - (tokens > none)
        del words[none]
    return words, tokens.astype(np.int32), ends.astype(np.int64)


def _squeezed(x: bytes) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True)


def _loosened(x: bytes) -> bytes:
    return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the greatest takes, with that size before them."""
    kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
    return bytes([kind.itemsize]) + _squeezed(x.astype(kind).tobytes())


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(_loosened(x[1:]), f"u{x[0]}").astype(np.int64)


def _words(x: bytes) -> list[bytes]:
    return _loosened(x).split()


def blocks(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", most: int = BLOCK) -> DataFrame:
    """Rows (block, ids, held, row, last, sizes, tokens, words, counts): texts of about `most` bytes together.

    Parts of a long text have one number `row`, and the last is marked; `tokens` has the numbers of the words and `sizes`
    each part's number of them; `counts` says how often each word of the block stands in texts that are not held out.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(f"`{text_col}`").cast("string").alias("text"))
    types = {"block": pa.int64(), "held": pa.list_(pa.bool_()), "row": pa.list_(pa.int64()), "last": pa.list_(pa.bool_()), "sizes": pa.binary(), "tokens": pa.binary(), "words": pa.binary(), "counts": pa.binary()}

    def block(number: int, batch: pa.RecordBatch, rows: list[int], row: list[int], last: list[bool], parts: list[bytes]) -> pa.RecordBatch:
        words, tokens, bounds = _numbered(parts)
        held = batch.column(1).take(pa.array(rows, pa.int64()))
        learned = np.repeat(~np.array(held.to_pylist(), bool), np.diff(bounds))
        values = {"block": (TaskContext.get().partitionId() << 32) + number, "held": held.to_pylist(), "row": row, "last": last, "sizes": _packed(np.diff(bounds)), "tokens": _packed(tokens)}
        values |= {"words": _squeezed(b" ".join(words)), "counts": _packed(np.bincount(tokens[learned], minlength=len(words)))}
        ids = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), batch.column(0).take(pa.array(rows, pa.int64())))
        return pa.RecordBatch.from_arrays([ids, *[pa.array([values[c]], t) for c, t in types.items()]], ["ids", *types])

    def run(batches):
        number, seen = 0, TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in pieces(whole, most):
                texts = batch.column(2).cast(pa.binary()).to_pylist()
                rows, last, parts, size = [], [], [], 0
                for i, text in enumerate(texts):
                    cut = list(_parts(text or b"", most)) or [b""]
                    for k, part in enumerate(cut):
                        rows.append(i)
                        parts.append(part)
                        last.append(k + 1 == len(cut))
                        size += len(part)
                        if size >= most or (i + 1 == len(texts) and last[-1]):
                            yield block(number, batch, rows, [seen + r for r in rows], last, parts)
                            rows, last, parts, size, number = [], [], [], 0, number + 1
                seen += len(texts)

    kind = own.dtypes[0][1]
    return own.mapInArrow(run, f"ids array<{kind}>, block long, held array<boolean>, row array<long>, last array<boolean>, sizes binary, tokens binary, words binary, counts binary")


def _posted(held: DataFrame) -> DataFrame:
    """Rows (block, j, word, m): each block's words, and how often it has them for learning."""

    def run(batches):
        for batch in batches:
            for name, packed, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words, m = _words(packed), _unpacked(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), name)), pa.array(np.arange(len(words)), pa.int32()), pa.array(words, pa.binary()), pa.array(m)], ["block", "j", "word", "m"])

    return held.select("block", "words", "counts").mapInArrow(run, "block long, j int, word binary, m long")


def _byte_counts(known: DataFrame) -> np.ndarray:
    def run(batches):
        for batch in batches:
            words, counts, out = [w + CLOSE for w in _bytes(batch.column(0))], batch.column(1).to_numpy(), np.zeros(256)
            for part in portions(lengths(words), SOME):
                out += np.bincount(np.frombuffer(b"".join(words[part]), np.uint8), np.repeat(counts[part], lengths(words[part])), 256)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(out.astype(np.int64))], ["byte", "n"])

    out = np.zeros(256, np.int64)
    for r in known.mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():  # 256 rows
        out[r.byte] = r.n
    return out


#: Slots whose counts travel together.
CHUNK = SLOTS // 64


def _bit_counts(known: DataFrame, tasks: int, code) -> np.ndarray:
    """Zeros and ones by predictor and slot; the tasks' tables are added up chunk by chunk before they come to the driver."""

    def run(batches):
        out = np.zeros((len(ORDERS), 2, SLOTS))
        for batch in batches:
            count_bits([w + CLOSE for w in _bytes(batch.column(0))], batch.column(1).to_numpy(), code, out)
        for k in range(len(ORDERS)):
            for c in range(SLOTS // CHUNK):
                part = out[k, :, c * CHUNK : (c + 1) * CHUNK]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([c], pa.int32()), pa.array([_packed(part.ravel().astype(np.uint64))], pa.binary())], ["k", "c", "counts"])

    def add(key, table):
        total = sum((_unpacked(x) for x in table.column("counts").to_pylist()), np.zeros(2 * CHUNK, np.int64))
        return pa.table({"k": [key[0].as_py()], "c": [key[1].as_py()], "counts": [_packed(total)]}, pa.schema([("k", pa.int32()), ("c", pa.int32()), ("counts", pa.binary())]))

    parts = known.repartition(tasks, "word").mapInArrow(run, "k int, c int, counts binary")
    out = np.zeros((len(ORDERS), 2, SLOTS), np.float32)
    for r in parts.groupBy("k", "c").applyInArrow(add, "k int, c int, counts binary").toLocalIterator():  # of a fixed size
        out[r.k, :, r.c * CHUNK : (r.c + 1) * CHUNK] = _unpacked(r.counts).reshape(2, CHUNK)
    return out


def _pulls(known: DataFrame, code, others, weights: np.ndarray) -> np.ndarray:
    """The `pulls` of all words, added up before they come to the driver."""
    shape = (PLACES, len(ORDERS) + 1, len(ORDERS) + 2)

    def run(batches):
        out = np.zeros(shape)
        for batch in batches:
            out += pulls([w + CLOSE for w in _bytes(batch.column(0))], batch.column(1).to_numpy(), code, others.value, weights)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size), pa.int32()), pa.array(out.ravel())], ["i", "x"])

    out = np.zeros(int(np.prod(shape)))
    for r in known.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():  # 90 rows
        out[r.i] = r.x
    return out.reshape(shape)


def fit(known: DataFrame, ends: int, code, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First weights and cells: those of the predictors by all words of known(word, n) and `ends` ends."""
    weights, cells = start_weights()
    used = [*range(len(ORDERS)), INPUTS - 1]
    zeros, ones = counted[:, 0], counted[:, 1]
    others = np.stack([logits(np.maximum(0, zeros - 1), ones), logits(zeros, np.maximum(0, ones - 1))], axis=1)
    sent, first = known.sparkSession.sparkContext.broadcast(others), weights[:PLACES, used].astype(np.float64)  # of a fixed size
    now = first
    for _ in range(ROUNDS):
        now = stepped(now, _pulls(known, code, sent, now) + pulls([END], np.array([ends]), code, others, now), first)
    sent.destroy()
    weights[:, used] = np.tile(now, (STATES, 1))
    return weights, cells


def train(known: DataFrame, ends: int) -> Model:
    """The model from the training documents' words, known(word, n), and their number `ends`."""
    sums = known.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    counts = _byte_counts(known)
    counts[END[0]] += ends
    code = huffman(counts)
    counted = _bit_counts(known, max(1, -(-sums.v // WORDS_A_TASK)), code)
    counted += count_bits([END], np.array([ends]), code)
    weights, cells = fit(known, ends, code, counted)
    return Model(code, np.stack([logits(*c) for c in counted]), weights, cells, int(sums.n) + ends, sums.v + (ends > 0), ends)


def _ended(tokens: np.ndarray, bounds: np.ndarray, last: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts with the end behind their last parts."""
    return np.insert(tokens, bounds[1:][last], end), bounds + np.concatenate(([0], np.cumsum(last)))


def _text_logs(closed: list[bytes], tokens: np.ndarray, bounds: np.ndarray, n_bytes: np.ndarray, model: Model) -> np.ndarray:
    """The `bit_logs` of texts, for which only their own words are spelled."""
    seen = np.zeros(len(closed), bool)
    seen[tokens] = True
    words, tokens = [closed[k] for k in np.flatnonzero(seen).tolist()], (np.cumsum(seen) - 1)[tokens]
    own, out = spelled(words, model.code, lambda k, slots, bit: model.tables[k].take(slots)), np.zeros(len(n_bytes))
    for part in portions(n_bytes, GROUP):
        a, b = bounds[part.start], bounds[part.stop]
        out[part] = bit_logs(own, words, tokens[a:b], bounds[part.start : part.stop + 1] - a, model)
    return out


def _scored(words: list[bytes], counts: np.ndarray, tokens: np.ndarray, bounds: np.ndarray, model: Model) -> dict[str, np.ndarray]:
    """Of each part of a text its tokens, how many are known, the base score, the model's, and bytes as they are spelled."""
    closed = _closed(words)
    size, n = lengths(closed), len(bounds) - 1
    text = np.repeat(np.arange(n), np.diff(bounds))
    n_bytes = np.bincount(text, size[tokens], n).astype(np.int64)
    score = np.zeros(n)
    for part in portions(n_bytes, HELD):
        a, b = bounds[part.start], bounds[part.stop]
        score[part] = _text_logs(closed, tokens[a:b], bounds[part.start : part.stop + 1] - a, n_bytes[part], model)
    base = np.log10(counts + 0.5) - np.log10(model.tokens + 0.5 * (model.distinct + 1))
    return {"n_tokens": np.diff(bounds), "n_known": np.bincount(text, counts[tokens] > 0, n).astype(np.int64), "base_score": np.bincount(text, base[tokens], n), "score": score, "n_bytes": n_bytes}


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes); it learns from the documents for
    which `held_out` is not true. -score / log10(2) / n_bytes is the number of bits a byte."""
    own = docs.select(F.coalesce(held_out, F.lit(False)).alias("held"), F.col(f"`{text_col}`").cast("string").alias("text"))
    held = settled(blocks(docs, held_out, id_col, text_col, block))
    posted = _posted(held)
    every = settled(posted.groupBy("word").agg(F.sum("m").alias("n"), F.count("*").alias("in_blocks")))
    ends = own.where("not held").count()
    model = train(every.where("n > 0").select("word", "n"), ends)
    # a word of one block needs no answer: it has all there are
    more = posted.join(every.where("in_blocks > 1").select("word", "n"), "word").where("n <> m")
    answers = more.groupBy("block").agg(F.collect_list("j").alias("at"), F.collect_list("n").alias("n"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    types = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "n_bytes": pa.int64()}

    def run(batches):
        model = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                words, counts = _words(row["words"].as_py()), np.append(_unpacked(row["counts"].as_py()), model.ends)
                if row["at"].is_valid:
                    counts[row["at"].values.to_numpy()] = row["n"].values.to_numpy()
                bounds = np.concatenate(([0], np.cumsum(_unpacked(row["sizes"].as_py()))))
                tokens, bounds = _ended(_unpacked(row["tokens"].as_py()), bounds, np.array(row["last"].as_py(), bool), len(words))
                found = _scored(words, counts, tokens, bounds, model)
                yield pa.RecordBatch.from_arrays([row["ids"].values, row["held"].values, row["row"].values, *[pa.array(found[c], t) for c, t in types.items()]], ["id", "held_out", "row", *types])

    kind = held.schema["ids"].dataType.elementType.simpleString()
    parts = held.join(answers, "block", "left").mapInArrow(run, f"id {kind}, held_out boolean, row long, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score", "n_bytes")]
    out = parts.groupBy("row").agg(F.first("id").alias("id"), F.first("held_out").alias("held_out"), *sums)
    return out.select("id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes")
