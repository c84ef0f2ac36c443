"""Chat formatting as a prefix tree: turns that conversations share from their start are emitted once.

A conversation is the sequence of its turns; a turn's key hashes it with all turns before it. Conversations sorted by
their key sequences stand in depth-first order of the tree, so each emits just the turns beyond its common prefix with
the one before it. The sort is a range partitioning by key and id, so that no tree and no group of equal conversations
has to fit one task; one pass sums up every partition, the driver strings the partitions' ends together, and a second
pass emits nodes with their place in the layout, their first position id, and their ancestors' intervals in the layout,
which are what a token may attend to besides the earlier tokens of its own node. A token is one code point.

The template marks a turn as `<|turn|>role\\ntext<|end|>\\n`. Inside roles and texts a backslash is doubled, and control
strings of this and other templates get a backslash after their first character; both are undone on reading back.

Defined cases: null roles and texts are empty; rows of one conversation go by turn (null first), then role and text, and
repeated rows are repeated turns; rows with a null conv_id are one conversation; equal conversations share all nodes;
other columns are ignored; no rows give no rows. Roles and texts of any length are formatted and read back whole; one
conversation is held in one task, being one output row. Conversations of equal turns stand in the order of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

TURN, END = "<|turn|>", "<|end|>"
CONTROL = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
WIDTH = 16
NODE = "struct<start: long, length: long, depth: int, position: long, role: string, segment: string, loss_start: long, loss_length: long, ancestors: array<struct<start: long, end: long>>>"


def escape(text: str, line: bool = False) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        if c in text:
            text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text.replace("\n", "\\\n") if line else text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def keys(turns: list[tuple[str, str]]) -> bytes:
    """The keys of all turns, end to end: WIDTH bytes each."""
    out, last = [], b""
    for role, text in turns:
        state = xxhash.xxh3_128(last)
        state.update(len(role := role.encode()).to_bytes(8, "big") + role + text.encode())
        last = state.digest()
        out.append(last)
    return b"".join(out)


def common(a: bytes, b: bytes) -> int:
    """Turns that two key sequences share from the start."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:  # keys chain, so equal keys mean equal prefixes
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[(mid - 1) * WIDTH : mid * WIDTH] == b[(mid - 1) * WIDTH : mid * WIDTH] else (low, mid - 1)
    return low


def ordered(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (id, key, turns), in depth-first order over the partitions; settled."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = turns.select(F.col(f"`{id_col}`").alias("id"), F.struct(F.col(f"`{turn_col}`").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).alias("t"))
    whole = rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    kind = whole.dtypes[0][1]
    shape = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                convs = [[tuple(t.values())[1:] for t in conv] for conv in part.column(1).to_pylist()]
                named = [[{"role": r, "text": x} for r, x in conv] for conv in convs]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(keys, convs), pa.binary()), pa.array(named, shape)], ["id", "key", "turns"])

    keyed = whole.mapInArrow(run, f"id {kind}, key binary, turns array<struct<role: string, text: string>>")
    return settled(keyed.repartitionByRange("key", "id").sortWithinPartitions("key", "id"))


def _segments(turns: list[dict]) -> list[tuple[str, str, int, int]]:
    """(role, segment, start of its text, length of its text) of each turn."""
    out = []
    for t in turns:
        head, body = f"{TURN}{escape(t['role'], True)}\n", escape(t["text"])
        out.append((t["role"], f"{head}{body}{END}\n", len(head), len(body)))
    return out


def _summaries(convs: DataFrame) -> dict[int, tuple]:
    """Of each partition: its first path, its last path, the depth up to which those are one, and all it emits."""

    def run(batches):
        first = last = b""
        lens0, path, cursor, one, any_row = [], [], 0, None, False
        for batch in batches:
            for key, turns in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lens = [len(s[1]) for s in _segments(turns)]
                if not any_row:
                    first, lens0, any_row, one, at = key, lens, True, len(lens), 0
                else:
                    at = common(last, key)
                    one = min(one, at)
                del path[at:]
                for n in lens[at:]:
                    path.append(cursor)
                    cursor += n
                last = key
        if any_row:
            cols = [[TaskContext.get().partitionId()], [first], [lens0], [last], [path], [one], [cursor]]
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], list("pflkson"))

    found = convs.mapInArrow(run, "p long, f binary, l array<long>, k binary, s array<long>, o long, n long")
    return {r.p: (bytes(r.f), r.l, bytes(r.k), r.s, r.o, r.n) for r in found.collect()}  # a row a partition


def _seeds(parts: dict[int, tuple]) -> dict[int, tuple[int, list[int], bytes]]:
    """For each partition: what to add to its own offsets, and the path that it inherits."""
    seeds, base, path, last = {}, 0, [], b""
    for p in sorted(parts):
        first, lens, end, starts, one, total = parts[p]
        shared = common(last, first)
        inherited = sum(lens[:shared])
        seeds[p] = (base - inherited, path[:shared], first)
        path = [path[d] if d < min(one, shared) else s + base - inherited for d, s in enumerate(starts)]
        base, last = base + total - inherited, end
    return seeds


def pack(convs: DataFrame) -> DataFrame:
    """Rows (id, path array<long>, nodes): the starts of a conversation's nodes, and those that it emits itself."""
    seeds = convs.sparkSession.sparkContext.broadcast(_seeds(_summaries(convs)))
    kind = convs.dtypes[0][1]
    gap = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    shape = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("depth", pa.int32()), ("position", pa.int64()), ("role", pa.string()), ("segment", pa.string()), ("loss_start", pa.int64()), ("loss_length", pa.int64()), ("ancestors", pa.list_(gap))])

    def run(batches):
        shift, path, last = seeds.value.get(TaskContext.get().partitionId(), (0, [], b""))
        path, cursor, at = list(path), None, len(path)
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                ids, paths, nodes = batch.column(0), [], []
                for key, turns in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    segments = _segments(turns)
                    if cursor is None:  # the first conversation goes on from the path of the partition before
                        cursor = shift + sum(len(s[1]) for s in segments[:at])
                    else:
                        at = common(last, key)
                    del path[at:]
                    own, gaps, position = [], [], 0
                    for d, (role, segment, text_at, text_len) in enumerate(segments):
                        if d >= at:
                            path.append(cursor)
                            cursor += len(segment)
                            loss = role == "assistant"
                            own.append({"start": path[d], "length": len(segment), "depth": d, "position": position, "role": role, "segment": segment, "loss_start": text_at if loss else None, "loss_length": text_len if loss else None, "ancestors": [dict(g) for g in gaps]})
                        position += len(segment)
                        if gaps and gaps[-1]["end"] == path[d]:
                            gaps[-1]["end"] += len(segment)
                        else:
                            gaps.append({"start": path[d], "end": path[d] + len(segment)})
                    paths.append(list(path))
                    nodes.append(own)
                    last = key
                yield pa.RecordBatch.from_arrays([ids, pa.array(paths, pa.list_(pa.int64())), pa.array(nodes, pa.list_(shape))], ["id", "path", "nodes"])

    return convs.mapInArrow(run, f"id {kind}, path array<long>, nodes array<{NODE}>")


def format_tree(turns: DataFrame, **cols) -> tuple[DataFrame, DataFrame]:
    """(nodes, members): the tree's nodes in one depth-first layout, and the path (id, depth, start) of each conversation."""
    packed = pack(ordered(turns, **cols))
    nodes = packed.select(F.explode("nodes").alias("n")).select("n.*")
    return nodes, packed.select("id", F.posexplode("path").alias("depth", "start"))


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (id, turns array<struct<depth, role, text, loss, length>>): the conversations, read from the layout."""
    body = r"(?s)^<\|turn\|>((?:[^\\\n]++|\\.)*+)\n(.*)<\|end\|>\n$"  # possessive, so that a long role takes no stack
    parsed = nodes.select(
        "start",
        unescape(F.regexp_extract("segment", body, 1)).alias("role"),
        unescape(F.regexp_extract("segment", body, 2)).alias("text"),
        unescape(F.substring(F.col("segment"), F.col("loss_start") + 1, F.col("loss_length"))).alias("loss"),
        F.length("segment").cast("long").alias("length"),
    )
    return members.join(parsed, "start").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text", "loss", "length"))).alias("turns"))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of conversations read back."""
    back = read_back(*format_tree(turns))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: F.coalesce(t["loss"], F.lit(""))), "")
    return back.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["length"]).alias("formatted_chars"),
    )
