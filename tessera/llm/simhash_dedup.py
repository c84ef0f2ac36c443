"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most `max_bits` bits agree in at
least 8 - max_bits bytes, so a pair is a candidate only if its tally of shared positional bytes reaches that minimum.
The index is kept over the combinations of that many byte positions: a pair meets under some combination exactly if
its tally reaches the minimum, so single frequent bytes never bring pairs together. The shared bytes of every pair that
meets are tallied, pairs short of the minimum go, and survivors are verified bit by bit.

Defined cases: null or wordless texts have fingerprint zero and link like any other; exact copies meet as one
fingerprint before any pairing; repeated rows give repeated result rows; a null id stays null and never names a
component unless the component has no other id; other columns are ignored whatever their names; no rows give no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, settled, small_or_plain
from .components import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Buckets above this size are split again by bits, so that one task holds at most so many fingerprints at once.
BUCKET = 2048
#: Links that a task holds before it hands them on, about.
LINKS = 50_000
#: Bytes of text that are taken apart at once.
PART = 1 << 20
#: A fingerprint with over a MANYth of all rows, and over MANY, is joined by a broadcast.
MANY = 300


def _parts(text: bytes, size: int):
    """The text in parts of about `size` bytes, cut at white space."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end]
        at = end


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of one UTF-8 text: majority bits over the XXH64 of its word shingles, repeats included.

    Long texts go through in parts that share the words at their ends, so memory stays bounded.
    """
    ones, count, words = np.zeros(64, np.int64), 0, []
    for part in _parts(text.translate(LOWER), PART):
        words = [*words[len(words) - shingle + 1 :], *part.split()] if len(words) >= shingle else words + part.split()
        n = len(words) - shingle + 1
        if n <= 0:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        digest = xxhash.xxh64_digest
        rows = np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in spans]), np.uint8).reshape(n, 8)
        count += n
        for at in range(0, n, 255 * 64):
            bits = np.unpackbits(rows[at : at + 255 * 64], axis=1)
            for low in range(0, len(bits), 255):  # at most 255 rows, so the bytes can't overflow
                ones += np.add.reduce(bits[low : low + 255], axis=0, dtype=np.uint8)
    if not count:
        return xxhash.xxh64_intdigest(b" ".join(words), seed) if words else 0
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Rows (id, fp): the fingerprint of each whole text as a signed long."""
    kind = docs.select(id_col).dtypes[0][1]

    def run(texts, batch):
        fps = [_signed(fingerprint(x, shingle, seed)) for x in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return map_texts(docs, [id_col], text_col, run, f"id {kind}, fp long")


def _masks(max_bits: int) -> list[int]:
    parts = [0xFF << (8 * i) for i in range(8)]
    return [sum(c) for c in combinations(parts, 8 - max_bits)]


def _bit_masks(mask: int, max_bits: int) -> list[int]:
    """Masks that split the bits outside `mask` into 8 runs; a linked pair agrees in all but `max_bits` of the runs."""
    free = [i for i in range(64) if not mask >> i & 1]
    runs = [sum(1 << int(i) for i in part) for part in np.array_split(free, 8)]
    return [sum(c) for c in combinations(runs, 8 - max_bits)]


def _spanning(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of one bucket that connect what any of its links connect: a breadth-first forest, not all pairs."""
    out, rest, all_bytes = [], np.unique(fps), 8 - max_bits
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            found = np.zeros(len(rest), bool)
            new = []
            for at in range(0, len(front), 128):
                part = front[at : at + 128]
                apart = part[:, None] ^ rest[None, :]
                shared = (apart.view(np.uint8).reshape(*apart.shape, 8) == 0).sum(axis=2, dtype=np.uint8)
                near = (shared >= all_bytes) & (np.bitwise_count(apart.view(np.uint64)) <= max_bits)
                near[:, found] = False
                hit = near.any(axis=0)
                who = part[near.argmax(axis=0)]
                out += zip(who[hit].tolist(), rest[hit].tolist(), strict=True)
                found |= hit
            new = rest[found]
            front, rest = new, rest[~found]
    return out


def _first_combination(max_bits: int) -> np.ndarray:
    """For each set of agreeing bytes, as bits, the number of the first mask of `_masks` that lies in it; -1 for none."""
    sets = [sum(1 << i for i in c) for c in combinations(range(8), 8 - max_bits)]
    return np.array([next((k for k, s in enumerate(sets) if s & have == s), -1) for have in range(256)], np.int64)


def _meets_first(apart: np.ndarray, c: int, sub: int, first: np.ndarray, subs: list[list[int]]) -> np.ndarray:
    """Whether bucket (c, sub) is the first of all in which fingerprints `apart` from each other meet; sub is -1 if there is none.

    Links that are given only there still connect all: what a link joins in a later bucket is joined in an earlier one.
    """
    agree = (apart.view(np.uint8).reshape(-1, 8) == 0) @ (1 << np.arange(8))  # little-endian: byte i is the i-th mask part
    out = first[agree] == c
    for k in range(sub + 1):
        same = apart & np.int64(subs[c][k]) == 0
        out &= same if k == sub else ~same
    return out


def _bucket_links(buckets: DataFrame, max_bits: int) -> DataFrame:
    first = _first_combination(max_bits)
    subs = [[_signed(s) for s in _bit_masks(m, max_bits)] for m in _masks(max_bits)]

    def out(links: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *links])
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches):
        for batch in batches:
            ends, values = batch.column(0).offsets.to_numpy(), batch.column(0).values.to_numpy()
            c, sub = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            held, count = [], 0
            for i in range(batch.num_rows):
                fps = values[ends[i] : ends[i + 1]]
                pairs = np.array(_spanning(fps, max_bits), np.int64).reshape(-1, 2)
                pairs = pairs[_meets_first(pairs[:, 0] ^ pairs[:, 1], c[i], sub[i], first, subs)]
                held.append(pairs)
                count += len(pairs)
                if count > LINKS:
                    yield out(held)
                    held, count = [], 0
            yield out(held)

    return buckets.select("fps", F.col("c").cast("int"), F.col("sub").cast("int")).mapInArrow(run, "a long, b long")


def links(fps: DataFrame, max_bits: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fps(fp)` that connect all fingerprints within `max_bits` bits."""
    masks = [_signed(m) for m in _masks(max_bits)]
    subs = [[_signed(s) for s in _bit_masks(m, max_bits)] for m in _masks(max_bits)]
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    posted = fps.select("fp", F.posexplode(lit(masks)).alias("c", "mask")).select("fp", "c", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("k"))
    counted = posted.groupBy("k").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    counted = settled(counted)
    apart = F.col("a").bitwiseXOR(F.col("b"))
    tally = sum((apart.bitwiseAND(F.lit(_signed(0xFF << (8 * i)))) == 0).cast("int") for i in range(8))
    found = counted.where(F.col("n") == 2).where(tally >= 8 - max_bits).where(F.bit_count(apart) <= max_bits).select("a", "b").distinct()
    sizes = counted.agg(F.sum((F.col("n") > 2).cast("long")), F.max("n")).first()
    if not sizes[0]:
        return found
    members = lambda which: posted.join(small_or_plain(counted.where(which).select("k")), "k")
    some = members(F.col("n").between(3, bucket)).groupBy("k", "c").agg(F.collect_list("fp").alias("fps")).withColumn("sub", F.lit(-1))
    found = found.unionByName(_bucket_links(some, max_bits))
    if sizes[1] > bucket:  # each bucket of a bit run holds at most 2 ** (3 * max_bits) fingerprints
        hot = members(F.col("n") > bucket)
        sub = F.element_at(F.array(*[lit(x) for x in subs]), F.col("c") + 1)
        finer = hot.select("fp", "k", "c", F.posexplode(sub).alias("sub", "m")).select("fp", "c", "sub", F.xxhash64("k", "m", F.col("fp").bitwiseAND(F.col("m"))).alias("k"))
        finer = finer.groupBy("k", "c", "sub").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        found = found.unionByName(_bucket_links(finer, max_bits))
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3, shingle: int = 3, seed: int = 42, bucket: int = BUCKET) -> DataFrame:
    """One row (id, fp, component) a document; component: the smallest id reachable over links, its own included."""
    each = settled(fingerprints(docs, id_col, text_col, shingle, seed))
    reps = settled(each.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    stars = components(links(reps.select("fp"), max_bits, bucket), "a", "b")
    linked = reps.join(stars, reps.fp == stars.node).select("fp", "root", "rep")
    lowest = linked.groupBy("root").agg(F.min("rep").alias("least"))
    linked = linked.join(lowest, "root").select("fp", "least")
    named = reps.join(linked, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component"), "copies")
    hot = max(MANY, each.count() // MANY)  # at most MANY fingerprints have more copies; those rows are not shuffled
    few = F.broadcast(settled(named.where(F.col("copies") > hot).drop("copies")))
    rest = each.join(few.select("fp"), "fp", "left_anti").join(named.where(F.col("copies") <= hot).drop("copies"), "fp")
    return each.join(few, "fp").unionByName(rest).select("id", "fp", "component")
