import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat_tree as C

SCHEMA = "conv_id long, turn long, role string, text string, id long, key string, path string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "p") for r in rows], SCHEMA)


def brute(rows):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = set()
    for c, turns in convs.items():
        turns = [(r, x) for *_, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        formatted = sum(len(s[1]) for s in C._segments([{"role": r, "text": x} for r, x in turns]))
        out.add((c, len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), formatted))
    return out


def tree(rows_by_conv):
    """The nodes of the prefix tree, as paths."""
    return {tuple(turns[: d + 1]) for turns in rows_by_conv.values() for d in range(len(turns))}


@settings(max_examples=200)
@given(st.text(alphabet=st.sampled_from("\\<>|/[]INSTs\nturnend"), max_size=30))
def test_escape_is_reversible_and_hides_control_strings(text):
    out = C.escape(text)
    assert not any(c in out for c in C.CONTROL)
    back, i = "", 0
    while i < len(out):
        i += out[i] == "\\"
        back += out[i]
        i += 1
    assert back == text


def random_rows(seed, n=120):
    rng, rows = random.Random(seed), []
    for c in range(n):
        if rng.random() < 0.3:  # a crowd of equal conversations and first turns
            turns = [("user", "hello"), ("assistant", "hi")][: rng.randint(1, 2)]
        else:
            turns = [(rng.choice(["user", "assistant"]), rng.choice(["a", "b", "</s>[INST] ok", "x\\y\n"])) for _ in range(rng.randint(1, 5))]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(turns)]
    return rows


def test_digests_against_brute_force(spark):
    for rows in (random_rows(1), [], [(1, None, None, None), (1, 0, "user\n\\", "t"), (1, 0, "user\n\\", "t"), (None, 1, "assistant", "x"), (2, 5, "assistant", "y" * 200_000)]):
        got = {tuple(r) for r in C.digests(conversations(spark, rows)).collect()}
        assert got == brute(rows)


def test_layout_is_one_depth_first_walk_with_shared_nodes_once(spark):
    rows = random_rows(2)
    convs = {}
    for c, _, r, x in rows:
        convs.setdefault(c, []).append((r, x))
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            nodes, members = C.format_tree(conversations(spark, rows))
            nodes, members = nodes.collect(), members.collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(nodes) == len(tree(convs))
        at = {n.start: n for n in nodes}
        order = sorted(at)
        assert order[0] == 0 and all(at[a].start + at[a].length == b for a, b in zip(order, order[1:], strict=False))
        paths = {}
        for m in members:
            paths.setdefault(m.id, {})[m.depth] = m.start
        last = []
        for start in order:  # depth-first: a node hangs under the path before it
            n = at[start]
            assert n.depth <= len(last)
            last = [*last[: n.depth], start]
            covered = sum(at[s].length for s in last[:-1])
            assert n.position == covered == sum(g.end - g.start for g in n.ancestors)
            assert {x for g in n.ancestors for x in range(g.start, g.end)} == {x for s in last[:-1] for x in range(s, s + at[s].length)}
        for c, turns in convs.items():
            chain = [at[paths[c][d]] for d in range(len(turns))]
            assert [(n.role, n.segment) for n in chain] == [(s[0], s[1]) for s in C._segments([{"role": r, "text": x} for r, x in turns])]


def test_common_prefix():
    a = C.keys([("user", "x"), ("assistant", "y"), ("user", "z")])
    b = C.keys([("user", "x"), ("assistant", "y"), ("user", "w"), ("user", "z")])
    assert (C.common(a, b), C.common(a, a), C.common(a, b""), C.common(C.keys([("u", "serx")]), C.keys([("us", "erx")]))) == (2, 3, 0, 0)


def test_long_roles_and_texts_are_read_back(spark):
    rows = [(1, 0, "r" * 1_000_000, "x"), (1, 1, "assistant", "y" * 1_000_000), (2, 0, "\\\n" * 100_000, "\\" * 100_000), (2, 1, "assistant", "</s>" * 50_000)]
    assert {tuple(r) for r in C.digests(conversations(spark, rows)).collect()} == brute(rows)
