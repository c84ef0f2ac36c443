"""A Merkle manifest of a dataset: mountain-range stacks over indexed partitions, merged where partitions cut a run.

Every row is a leaf. Per source the leaves stand in order of their ids; while several nodes remain, each `FANOUT`
consecutive ones, and the fewer of the last run, become the digest of their concatenation: nothing is padded. What remains
is the source's root, and the source roots, in order of the sources, are put together in the same way.

Leaves are dealt out by ranges of (source, id), so that a source of any size lies over many partitions, and a count of
each partition gives its first leaf's place. A task goes through its leaves with one stack a source: a node is pushed at
its level, and as its run is full the carry goes on as a digest on the level above. Each digest is emitted as a node
record. A run that begins or ends in another partition can't be completed: its nodes are emitted as edges, at most two
short runs a level and partition, and merged level by level over all partitions.

A proof holds the siblings of a leaf and of all nodes over it. Blocks of 256 leaves carry their own two lowest levels;
above, each node hands the runs over it down to its children, level by level, in joins of rows that are 256 times fewer
than the leaves.

Defined cases: null sources come first and are one source, a null id is the first of its source; rows of equal source and
id go by their digests, and equal rows are leaves of their own; a lone leaf is its source's root and a lone source's root
the root; null fields count as `-`, empty texts as `0:`; texts of any length are hashed in place and never shuffled; other
columns are ignored, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, small_or_plain

FANOUT, BITS = 16, 4
#: Leaves of one partition, about.
LEAVES = 200_000
#: Levels of a block's own nodes: 256 leaves.
INSIDE = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: list[bytes]) -> bytes:
    """The digest of digests, concatenated as lower-case hexadecimal."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


def leaf_digest(fields: list[Column]) -> Column:
    """The digest of fields, each `-` if null, else its UTF-8 byte count, a colon and itself."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[one(c.cast("string")) for c in fields]).cast("binary"), 256))


class Stack:
    """The nodes of one source in one partition that wait for the rest of their runs, level by level.

    `emit(level, place, node, edge, top)` is called once for each node above the leaves, and for leaves that are an edge or
    their source's root.
    """

    def __init__(self, emit):
        self.held: list[list[bytes]] = []
        self.first: list[int] = []  # the place of the first node held at each level
        self.emit = emit

    def add(self, level: int, place: int, node: bytes) -> None:
        if level == len(self.held):
            self.held.append([])
            self.first.append(place)
        if not self.held[level]:
            self.first[level] = place
        self.held[level].append(node)
        if place % FANOUT == FANOUT - 1:
            self._close(level, self.first[level] % FANOUT == 0)

    def _close(self, level: int, whole: bool) -> None:
        """The run at this level is over: its digest goes up, or its nodes are an edge."""
        nodes, first = self.held[level], self.first[level]
        self.held[level] = []
        if level or not whole:
            for k, x in enumerate(nodes):
                self.emit(level, first + k, x, not whole, False)
        if whole:
            self.add(level + 1, first // FANOUT, digest(nodes))

    def finish(self, total: int) -> None:
        """No more leaves of this source here, which has `total` in all partitions: its last, short runs go up."""
        level, count = 0, total
        while level < len(self.held):
            nodes, first = self.held[level], self.first[level]
            if count == 1 and nodes:
                self.emit(level, 0, nodes[0], False, True)
                return
            if nodes:
                self._close(level, first % FANOUT == 0 and first + len(nodes) == count)
            level, count = level + 1, -(-count // FANOUT)


def _index(placed: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, dict[str, int]]]]:
    """The leaves of each source, and by partition the first leaf's place in its source and the sizes of the sources
    that may go on in other partitions: the first and the last. Two counts a partition come to the driver."""
    counts = settled(placed.groupBy("part", "g").agg(F.count("*").alias("n")))
    ends = counts.groupBy("part").agg(F.min(F.struct("g", "n")).alias("a"), F.max(F.struct("g", "n")).alias("b")).orderBy("part").collect()
    sizes: dict[str, int] = {}
    before: dict[int, int] = {}
    for r in ends:
        before[r.part] = sizes.get(r.a.g, 0)
        for g, n in {r.a.g: r.a.n, r.b.g: r.b.n}.items():
            sizes[g] = sizes.get(g, 0) + n
    totals = counts.groupBy("g").agg(F.sum("n").alias("total"))
    return totals, {r.part: (before[r.part], {g: sizes[g] for g in (r.a.g, r.b.g)}) for r in ends}


def forest(leaves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of leaves(g, o, leaf, ...) in order of (o, leaf) in each group g: the leaves with their `place`; the nodes
    (g, level, place, node) above them, and edges among the leaves; and the groups' roots (g, level, node, total)."""
    spark = leaves.sparkSession
    leaves = settled(leaves)  # ranges are drawn from a sample, for which nothing should be hashed again
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(leaves.count() / LEAVES))
    placed = settled(leaves.repartitionByRange(parts, "g", "o", "leaf").sortWithinPartitions("g", "o", "leaf").withColumn("part", F.spark_partition_id()))
    totals, index = _index(placed)
    schema = placed.drop("part").schema

    def run(batches):
        stack, group, place, sizes = None, None, 0, {}
        rows: list[tuple] = []

        def nodes(names) -> pa.RecordBatch:
            """The node records that have come up, in the columns of the leaves and a few more."""
            made, rows[:] = list(rows), []
            columns = dict(zip(("g", "level", "place", "leaf", "edge", "top"), zip(*made, strict=True), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(made), f.type) for f in names], schema=names)

        names = None
        for batch in batches:
            own = batch.schema.get_field_index("part")
            kept = [batch.schema.field(k) for k in range(batch.num_columns) if k != own]
            names = pa.schema([*[pa.field(f.name, f.type) for f in kept], pa.field("level", pa.int32()), pa.field("place", pa.int64()), pa.field("edge", pa.bool_()), pa.field("top", pa.bool_())])
            places = []
            part = batch.column(own)[0].as_py() if batch.num_rows else None
            for g, leaf in zip(batch.column("g").to_pylist(), batch.column("leaf").to_pylist(), strict=True):
                if g != group:
                    if stack:
                        stack.finish(sizes.get(group, place))
                        place = 0
                    else:
                        place, sizes = index[part]
                    group, stack = g, Stack(lambda *x, g=g: rows.append((g, x[0], x[1], x[2], x[3], x[4])))
                places.append(place)
                stack.add(0, place, leaf)
                place += 1
            n = batch.num_rows
            more = {"level": pa.nulls(n, pa.int32()), "place": pa.array(places, pa.int64()), "edge": pa.nulls(n, pa.bool_()), "top": pa.nulls(n, pa.bool_())}
            yield pa.RecordBatch.from_arrays([more[f.name] if f.name in more else batch.column(f.name) for f in names], schema=names)
            if rows:
                yield nodes(names)
        if stack:
            stack.finish(sizes.get(group, place))
            if rows:
                yield nodes(names)

    out = settled(placed.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", level int, place long, edge boolean, top boolean"))
    found = out.where("level is not null").select("g", "level", "place", F.col("leaf").alias("node"), "edge", "top")
    nodes, roots = _merged(found, totals)
    return out.where("level is null").drop("level", "edge", "top"), nodes, roots


def _run(of: Column) -> Column:
    """The digests of a list of (place, node) in order, end to end."""
    return F.aggregate(F.sort_array(of), F.lit(b""), lambda a, x: F.concat(a, x["node"]))


def _merged(found: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The node records with those of runs that partitions cut, and the roots; each level's edges meet by their run."""
    edges = found.where("edge").select("g", "level", "place", "node")
    cut = settled(edges.join(small_or_plain(totals), "g"))
    most = cut.agg(F.max("total")).first()[0] or 0
    made, level, size = [], 0, most
    current = cut.where("level = 0").drop("level")
    while size > 1:
        grouped = current.groupBy("g", "total", F.shiftright("place", BITS).alias("place")).agg(_run(F.collect_list(F.struct("place", "node"))).alias("run"))
        level, size = level + 1, -(-size // FANOUT)
        merged = settled(grouped.select("g", "total", "place", F.unhex(F.sha2(F.lower(F.hex("run")).cast("binary"), 256)).alias("node")))
        last = F.col("total") <= F.lit(FANOUT**level)
        made.append(merged.select("g", F.lit(level).alias("level"), "place", "node", last.alias("top")))
        current = merged.where(~last).select("g", "place", "node", "total").unionByName(cut.where(F.col("level") == level).select("g", "place", "node", "total"))
    every = reduce(DataFrame.unionByName, made, found.drop("edge"))
    roots = settled(every.where("top").select("g", "level", "node").join(totals, "g"))
    return every.where("not top").drop("top"), roots


def paths(nodes: DataFrame, roots: DataFrame, lowest: int) -> DataFrame:
    """Rows (g, place, path) of the nodes at level `lowest`, or of the root where that is lower.

    A path holds a byte for the node's place in its run, one for the run's size and the run's digests, from the lowest
    level up. Each run takes the path of the node over it and hands it to its nodes.
    """
    byte = lambda c: F.unhex(F.lpad(F.hex(c), 2, "0"))
    top = roots.agg(F.max("level")).first()[0] or 0
    below = lambda c: roots.where(c).select("g", F.lit(0).cast("long").alias("place"), F.lit(b"").alias("path"))
    out = below(F.col("level") == top) if top > lowest else below(F.col("level") <= lowest)
    for level in range(top - 1, lowest - 1, -1):
        run = nodes.where(F.col("level") == level).groupBy("g", F.shiftright("place", BITS).alias("over")).agg(F.sort_array(F.collect_list(F.struct("place", "node"))).alias("of"))
        over = out.withColumnRenamed("place", "over")
        each = run.join(over, ["g", "over"]).select("g", "path", F.size("of").alias("n"), _run(F.col("of")).alias("run"), F.explode("of").alias("x"))
        own = each.select("g", "x.place", F.concat(byte(F.col("x.place").bitwiseAND(FANOUT - 1)), byte(F.col("n")), "run", "path").alias("path"))
        out = settled(own.unionByName(below(F.col("level") == level if level > lowest else F.col("level") <= level)))
    return out


def _unpacked(path: bytes) -> list[tuple[str, str]]:
    """What stands left and right of the node in each run of a path, as hexadecimal text."""
    out, at = [], 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        run = path[at + 2 : at + 2 + 32 * n].hex()
        out.append((run[: 64 * place], run[64 * place + 64 :]))
        at += 2 + 32 * n
    return out


def _text_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _split(run: list[str], k: int) -> tuple[str, str]:
    return "".join(run[:k]), "".join(run[k + 1 :])


def block_proofs(leaves: list[str], total: int, path: bytes) -> list[list[tuple[str, str]]]:
    """For each leaf of a block, what stands left and right on every level."""
    over = _unpacked(path)
    if total == 1:
        return [over]
    runs = [leaves[k : k + FANOUT] for k in range(0, len(leaves), FANOUT)]
    above = [_text_digest("".join(r)) for r in runs] if total > FANOUT else []
    out = []
    for k, run in enumerate(runs):
        rest = [_split(above, k), *over] if above else over
        out += [[_split(run, j), *rest] for j in range(len(run))]
    return out


def fold(leaf: str, proof: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in proof:
        leaf = _text_digest(left + leaf + right)
    return leaf


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = FIELDS, text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """Rows (id, leaf, subroot, root, proof_sha256, folded_root, verified), digests as hexadecimal text.

    proof_sha256 is the digest of the leaf's siblings, from the lowest level up, left to right. Where `tampered` holds, the
    root is folded from the leaf of the row with its text's A-Z in lower case, else from the leaf itself.
    """
    own = lambda text: leaf_digest([text if f == text_col else F.col(f"`{f}`") for f in fields])
    text = F.col(f"`{text_col}`").cast("string")
    changed = F.when(tampered, own(F.translate(text, UPPER, LOWER))) if tampered is not None else F.lit(None).cast("binary")
    source = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("-"))  # null before any other
    leaves, nodes, roots = forest(docs.select(source.alias("g"), F.col(f"`{id_col}`").alias("o"), own(text).alias("leaf"), changed.alias("changed")))
    tops, over, whole = forest(roots.select(F.lit("").alias("g"), F.col("g").alias("o"), F.col("node").alias("leaf"), "total"))
    above = tops.select("g", F.lit(0).alias("level"), "place", F.col("leaf").alias("node"))
    above = paths(above.unionByName(over.where("level > 0")), whole, 0)
    root = whole.first()
    named = tops.join(above.drop("g").withColumnRenamed("path", "up"), "place")
    named = settled(named.select(F.col("o").alias("g"), "total", F.col("leaf").alias("subroot"), "up", F.lit(bytes(root.node) if root else b"").alias("root")))
    blocks = leaves.groupBy("g", F.shiftright("place", BITS * INSIDE).alias("place")).agg(F.sort_array(F.collect_list(F.struct("place", "leaf", "changed", "o"))).alias("of"))
    blocks = blocks.join(paths(nodes, roots, INSIDE), ["g", "place"]).join(small_or_plain(named), "g").select("of.o", "of.leaf", "of.changed", "total", "path", "up", "subroot", "root")
    kind = dict(docs.select(F.col(f"`{id_col}`").alias("id")).dtypes)["id"]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                ids = row["o"].values
                hexed = [x.hex() for x in row["leaf"].as_py()]
                proofs = block_proofs(hexed, row["total"].as_py(), row["path"].as_py())
                up, subroot, root = _unpacked(row["up"].as_py()), row["subroot"].as_py().hex(), row["root"].as_py().hex()
                lists: list[list] = [[], [], []]
                for leaf, other, proof in zip(hexed, row["changed"].as_py(), proofs, strict=True):
                    whole = [*proof, *up]
                    end = fold(other.hex() if other else leaf, whole)
                    lists[0].append(_text_digest("".join([x for pair in whole for x in pair])))
                    lists[1].append(end)
                    lists[2].append(end == root)
                n = len(hexed)
                arrays = [ids, pa.array(hexed), pa.array([subroot] * n), pa.array([root] * n), pa.array(lists[0]), pa.array(lists[1]), pa.array(lists[2])]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return blocks.mapInArrow(run, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
