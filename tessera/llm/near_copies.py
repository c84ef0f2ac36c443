"""Near copies at a similarity of 0.8 or more of their five-word shingles: SimHash index and MinHash bands, exactly verified.

Every text has a SimHash over its shingles, and the SimHash operator's index of positional bytes with count filtering finds
those within BITS bits; what these links connect is one bucket. SimHash bits move too far when a tenth of a text is cut
off or appended, so the same scheme of buckets holds MinHash bands besides: BANDS of ROWS least hashes over the shingles. Two
texts of similarity s meet in a band with probability 1 - (1 - s ** ROWS) ** BANDS, 0.995 at 0.8. What meets in either way is
verified exactly: by the shingle sets of the two texts, of which only those of texts in a bucket with others are drawn.

No group is expanded into all its pairs, and none is left unfinished. A bucket's texts are searched breadth first, each
found text being compared with all that are not found yet, so links span what any links of the bucket connect. Buckets
that several bands share are searched once. A bucket over CROWD texts is dealt into chunks which have PIVOTS texts in
common; what the chunks' links have not joined to the largest group of the bucket is then compared, chunk by chunk, with
every text of it: pairs inside that group need no comparison any more, all others get theirs.

Defined cases: null and wordless texts are one text; texts of equal words in equal order, A-Z in either case, are copies
whatever lies between the words; texts of fewer words than a shingle have themselves as their one shingle; texts of any
length are read whole, in parts; a null id stays null and names a group only if no member has an id; other columns are
ignored, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash_dedup
from .common import fresh, map_texts, settled, small_or_plain
from .components import components
from .simhash_dedup import LOWER, MANY

SIMILARITY, SHINGLE = 0.8, 5
BANDS, ROWS = 10, 4
#: Bits in which SimHashes that meet may differ.
BITS = 3
#: Texts of one bucket that one task searches, and texts that the chunks of a larger one have in common.
CROWD, PIVOTS = 2048, 16
_rng = np.random.default_rng(11)
_EACH = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _parts(text: bytes):
    return simhash_dedup._parts(text.translate(LOWER), simhash_dedup.PART)


def exact_key(text: bytes) -> bytes:
    """128 bits that texts share whose words are equal."""
    key = xxhash.xxh3_128()
    for part in _parts(text):
        key.update(b" ".join([*part.split(), b""]))
    return key.digest()


def shingles(text: bytes, size: int = SHINGLE) -> tuple[bytes, np.ndarray]:
    """The exact key, and the distinct 64-bit hashes of the shingles in order."""
    key, known, parts, digest = xxhash.xxh3_128(), {}, [np.zeros(0, np.uint64)], xxhash.xxh64_intdigest
    for part in _parts(text):
        words = part.split()
        key.update(b" ".join([*words, b""]))
        known.update({w: digest(w) for w in set(words).difference(known)})
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    tokens = np.concatenate(parts)
    size = min(size, len(tokens))
    rolled = np.zeros(len(tokens) - size + 1 if len(tokens) else 0, np.uint64)
    for k in range(size):
        rolled = (rolled ^ tokens[k : k + len(rolled)]) * _STEP
        rolled ^= rolled >> np.uint64(31)
    return key.digest(), np.unique(rolled)


def bands(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit number for each band; none for no shingles."""
    if not len(hashes):
        return []
    least = np.full(len(_EACH), ~np.uint64(0))
    for at in range(0, len(hashes), 2048):
        z = hashes[at : at + 2048, None] * _EACH
        z ^= z >> np.uint64(32)
        np.minimum(least, z.min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in least.reshape(BANDS, ROWS)]


def simhash(hashes: np.ndarray) -> int:
    """The signed majority of the bits of 64-bit hashes; zero for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # at most 255, so the bytes can't overflow
        part = hashes[at : at + 255].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(part, axis=1), axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (id, key, fp, bands array<long>) of whole texts."""
    kind = docs.select(f"`{id_col}`").dtypes[0][1]

    def run(texts, batch):
        found = [shingles(x, shingle) for x in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([k for k, _ in found], pa.binary()), pa.array([simhash(h) for _, h in found], pa.int64()), pa.array([bands(h) for _, h in found], pa.list_(pa.int64()))], ["id", "key", "fp", "bands"])

    return map_texts(docs, [id_col], text_col, run, f"id {kind}, key binary, fp long, bands array<long>")


def alike(a: int, b: int, shared: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of sizes a and b that share so many have the similarity or more."""
    return shared >= similarity * (a + b - shared) - 1e-9


class Sets:
    """Shingle sets that are looked up together: how many shingles each shares with another set."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        flat, owner = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]

    def shared(self, other: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.flat, other), np.searchsorted(self.flat, other, side="right")
        many = high - low
        at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return np.bincount(self.owner[at], minlength=len(self.sizes))


def forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between sets alike that connect all that any such links connect."""
    out, rest, front = [], np.arange(len(sets)), []
    held, index = np.zeros(0, np.int64), Sets([])
    while len(rest) or front:
        if not front:
            front, rest = [int(rest[0])], rest[1:]
        if not len(rest):
            break
        if 2 * len(rest) < len(held) or not len(held):
            held, index = rest, Sets([sets[i] for i in rest.tolist()])
        new = []
        for f in front:
            near = alike(len(sets[f]), index.sizes, index.shared(sets[f]), similarity) & np.isin(held, rest)
            found = held[near]
            out += [(f, int(i)) for i in found]
            new += found.tolist()
            rest = rest[~np.isin(rest, found)]
        front = new
    return out


def _links(groups: DataFrame, similarity: float) -> DataFrame:
    """Rows (u, v): a forest of true links of each group, of groups(of array<struct<key, shingles>>)."""

    def run(batches):
        for batch in batches:
            for row in batch.column(0):
                keys = row.values.field("key").to_pylist()
                sets = [np.frombuffer(x, np.uint64) for x in row.values.field("shingles").to_pylist()]
                found = forest(sets, similarity)
                yield pa.RecordBatch.from_arrays([pa.array([keys[a] for a, _ in found], pa.binary()), pa.array([keys[b] for _, b in found], pa.binary())], ["u", "v"])

    return groups.select("of").mapInArrow(run, "u binary, v binary")


def _cross_links(pairs: DataFrame, similarity: float) -> DataFrame:
    """Rows (u, v): of each text of a block `rest` a true link with one text of each component in a block `of`."""

    def run(batches):
        for batch in batches:
            for rest, of in zip(batch.column(0), batch.column(1), strict=True):
                keys, roots = of.values.field("key").to_pylist(), of.values.field("root").to_pylist()
                index, found = Sets([np.frombuffer(x, np.uint64) for x in of.values.field("shingles").to_pylist()]), []
                for own, x in zip(rest.values.field("key").to_pylist(), rest.values.field("shingles").to_pylist(), strict=True):
                    mine = np.frombuffer(x, np.uint64)
                    near = np.flatnonzero(alike(len(mine), index.sizes, index.shared(mine), similarity)).tolist()
                    found += [(own, keys[i]) for i in {roots[i]: i for i in near if keys[i] != own}.values()]
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["u", "v"])

    return pairs.select("rest", "of").mapInArrow(run, "u binary, v binary")


def _drawn(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Rows (key, shingles binary) of the documents whose ids are in wanted(rep); one row a key."""
    names = wanted.select(F.col("rep").alias("__rep")).distinct()
    some = docs.join(small_or_plain(names), docs[id_col].eqNullSafe(names["__rep"]), "left_semi")

    def run(texts, batch):
        found = [shingles(x, shingle) for x in texts]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([h.tobytes() for _, h in found], pa.binary())], ["key", "shingles"])

    return map_texts(some, [id_col], text_col, run, "key binary, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles"))


def _by_simhash(reps: DataFrame) -> DataFrame:
    """Rows (key, rep, c, h) of the texts whose SimHash is another's, or is linked to another: h is their bucket."""
    worded = reps.where(F.size("bands") > 0).select("key", "rep", "fp")
    fps = settled(worded.groupBy("fp").agg(F.count("*").alias("n")))
    stars = settled(components(simhash_dedup.links(fps.select("fp"), BITS), "a", "b"))
    alone = fps.where("n > 1").select(F.col("fp").alias("node"), F.col("fp").alias("root")).join(stars.select("node"), "node", "left_anti")
    several = settled(stars.select("node", "root").unionByName(alone))
    return worded.join(small_or_plain(several), F.col("fp") == F.col("node")).select("key", "rep", F.lit(BANDS).alias("c"), F.col("root").alias("h"))


def _edges(docs: DataFrame, reps: DataFrame, similarity: float, crowd: int, how: dict) -> DataFrame:
    """Verified links (u, v) between the keys of reps(key, rep, fp, bands)."""
    posted = reps.select("key", "rep", F.posexplode("bands").alias("c", "h")).unionByName(_by_simhash(reps))
    members = F.xxhash64("key").cast("decimal(20,0)")
    buckets = posted.groupBy("c", "h").agg(F.count("*").alias("n"), F.sum(members).alias("s")).where("n > 1")
    chosen = settled(buckets.groupBy("n", "s").agg(F.min(F.struct("c", "h")).alias("b")).select("b.*", "n").withColumn("bucket", F.xxhash64("c", "h")))  # one of those with equal texts
    inside = settled(posted.join(small_or_plain(chosen), ["c", "h"]).select("bucket", "n", "key", "rep"))
    if inside.isEmpty():
        return reps.select(F.col("key").alias("u"), F.col("key").alias("v")).limit(0)
    sets = settled(_drawn(docs, inside, shingle=how["shingle"], id_col=how["id_col"], text_col=how["text_col"]))
    element = F.struct("key", "shingles")
    each = inside.where(F.col("n") <= crowd).join(sets, "key").groupBy("bucket").agg(F.collect_list(element).alias("of"))
    found = _links(each, similarity)
    hot = inside.where(F.col("n") > crowd)
    if hot.isEmpty():
        return found
    hot = settled(hot.join(sets, "key").withColumn("chunk", F.pmod(F.xxhash64("key", "bucket"), F.ceil(F.col("n") / (crowd / 2)).cast("long"))))
    pivots = hot.groupBy("bucket", F.pmod(F.xxhash64("key"), F.lit(PIVOTS)).alias("salt")).agg(F.min(F.struct("key", "shingles")).alias("p"), F.first("n").alias("n"))
    common = pivots.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / (crowd / 2)).cast("long") - 1)).alias("chunk"), "p.key", "p.shingles")
    chunks = hot.select("bucket", "chunk", "key", "shingles").unionByName(common).dropDuplicates(["bucket", "chunk", "key"]).groupBy("bucket", "chunk").agg(F.collect_list(element).alias("of"))
    found = settled(found.unionByName(_links(chunks, similarity)))
    stars = components(found, "u", "v")
    rooted = settled(hot.join(stars, hot["key"] == stars["node"], "left").withColumn("root", F.coalesce("root", "key")).drop("node"))
    largest = rooted.groupBy("bucket", "root").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max_by("root", F.struct("k", "root")).alias("giant"))
    apart = rooted.join(small_or_plain(largest), "bucket").where("root <> giant").drop("giant")
    if apart.isEmpty():
        return found
    rest = apart.groupBy("bucket", F.col("chunk").alias("of_rest")).agg(F.collect_list(element).alias("rest"))
    all_ = rooted.groupBy("bucket", "chunk").agg(F.collect_list(F.struct("key", "shingles", "root")).alias("of"))
    return found.unionByName(_cross_links(rest.join(all_, "bucket"), similarity))


def _groups(docs: DataFrame, each: DataFrame, similarity: float, crowd: int, how: dict) -> DataFrame:
    """One row (key, rep, copies, component, kept) a distinct text; kept: the key of its group's text that stays."""
    reps = settled(each.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    stars = components(_edges(docs, reps, similarity, crowd, how), "u", "v")
    linked = settled(reps.select("key", "rep").join(stars, F.col("key") == F.col("node")).select("key", "rep", "root"))
    first = linked.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "key")).alias("m"))  # by id, then key
    named = linked.join(first, "root").select(F.col("key").alias("k"), F.col("m.rep").alias("component"), F.col("m.key").alias("kept"))
    return reps.select("key", "rep", "copies").join(named, F.col("key") == F.col("k"), "left").select("key", "rep", "copies", F.when(F.col("k").isNull(), F.col("rep")).otherwise(F.col("component")).alias("component"), F.coalesce("kept", "key").alias("kept"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """One row (id, key, component) a document; component: the smallest id of its group."""
    how = {"id_col": id_col, "text_col": text_col, "shingle": shingle}
    each = settled(signatures(docs, **how))
    groups = settled(_groups(docs, each, similarity, crowd, how))
    hot = max(MANY, each.count() // MANY)  # at most MANY texts have more copies; those rows are not shuffled
    few = F.broadcast(groups.where(F.col("copies") > hot).select("key", "component"))
    rest = each.select("id", "key").join(few.select("key"), "key", "left_anti").join(groups.where(F.col("copies") <= hot).select("key", "component"), "key")
    return each.select("id", "key").join(few, "key").unionByName(rest).select("id", "key", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """The documents with one row of each group left: the one with the smallest id.

    Of rows that share that id and its words the first by text stays. Texts are shuffled only if the ids to drop are too
    many to broadcast.
    """
    how = {"id_col": id_col, "text_col": text_col, "shingle": shingle}
    each = settled(signatures(docs, **how))
    groups = _groups(docs, each, similarity, crowd, how)
    kept = settled(groups.where(F.col("key") == F.col("kept")).select("rep", F.col("key").alias("k")))
    crowd = settled(each.groupBy("id").count().where("count > 1").select("id"))
    stays = F.col("id").eqNullSafe(F.col("rep")) & (F.col("key") == F.col("k"))
    gone = each.select("id", "key").join(kept, stays, "left_anti").select("id").unionByName(crowd).distinct()
    gone = settled(gone.withColumnRenamed("id", "__gone"))
    own = docs[id_col]
    out = docs.join(small_or_plain(gone), own.eqNullSafe(gone["__gone"]), "left_anti")
    if crowd.isEmpty():
        return out

    @F.arrow_udf("binary")
    def key_of(texts: pa.Array) -> pa.Array:
        return pa.array([exact_key(x or b"") for x in texts.cast(pa.binary()).to_pylist()], pa.binary())

    several = crowd.withColumnRenamed("id", "__several")
    name = fresh(docs, "key")
    rows = docs.join(small_or_plain(several), own.eqNullSafe(several["__several"]), "left_semi")
    rows = rows.withColumn(name, key_of(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    rows = rows.join(kept.withColumnsRenamed({"rep": "__rep", "k": "__k"}), rows[id_col].eqNullSafe(F.col("__rep")) & (rows[name] == F.col("__k")), "left_semi")
    by = F.struct(F.col(f"`{text_col}`"), F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")]))
    first = rows.groupBy(name).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), by).alias("row"))
    return out.unionByName(first.select("row.*"))
