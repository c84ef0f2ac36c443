import hashlib
import random
import zlib

import pytest

from tessera.llm import merkle as M
from tessera.llm.queries import op11_merkle_manifest

from .helpers import empty, odd

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    fields = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields])


def tree(nodes):
    """The root of a list of digests, and for each the (left, right) siblings by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
        for i, p in enumerate(proofs):
            run, k = runs[at[i] // 16], at[i] % 16
            p.append(("".join(run[:k]), "".join(run[k + 1 :])))
            at[i] //= 16
        nodes = [H(*r) for r in runs]
    return nodes[0], proofs


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        own = sorted(((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text), r) for r in groups[s]), key=lambda x: x[:3])
        trees.append((own, *tree([x[2] for x in own])))
    root, tops = tree([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (own, subroot, proofs), top in zip(trees, tops, strict=True):
        for (_, _, leaf, r), proof in zip(own, proofs, strict=True):
            whole = proof + top
            text, end = r.text, leaf
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and text is not None:
                end = leaf_of(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
            for a, b in whole:
                end = H(a, end, b)
            out.append((r.doc_id, leaf, subroot, root, H(*[x for p in whole for x in p]), end, end == root))
    return sorted(out, key=str)


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 15, 16, 17, 255, 256, 257, 4096, 4097, 5000])
def test_stacks_of_any_cut_give_the_whole_tree(n):
    """Leaves dealt out to partitions in any way: nodes inside are right, and edges are just what the merge needs."""
    rng = random.Random(n)
    leaves = [hashlib.sha256(str(k).encode()).digest() for k in range(n)]
    want, level = {}, 0
    nodes = leaves
    while nodes:
        want |= {(level, k): x for k, x in enumerate(nodes)}
        if len(nodes) == 1:
            break
        nodes, level = [M.digest(nodes[k : k + 16]) for k in range(0, len(nodes), 16)], level + 1
    for _ in range(6):
        cuts = sorted({0, n, *(rng.randrange(n + 1) for _ in range(rng.randrange(6)))})
        found, edges = {}, {}
        for a, b in zip(cuts, cuts[1:], strict=False):
            def emit(level, place, node, edge, top):
                assert (level, place) not in found
                found[level, place] = node
                if edge:
                    edges[level, place] = node

            stack = M.Stack(emit)
            for k in range(a, b):
                stack.add(0, k, leaves[k])
            stack.finish(n)
        for (lv, place), node in dict(found).items():
            assert want[lv, place] == node
        for lv in range(level):  # merge as the joins do
            runs = {}
            for (at, place), node in edges.items():
                if at == lv:
                    runs.setdefault(place // 16, []).append((place, node))
            for place, run in runs.items():
                assert (lv + 1, place) not in found
                found[lv + 1, place] = edges[lv + 1, place] = M.digest([x for _, x in sorted(run)])
        assert {k: x for k, x in found.items() if k[0]} == {k: x for k, x in want.items() if k[0]}
        if len(cuts) == 2:
            assert not edges


def test_query_against_brute_force(spark, sf_dir):
    got = op11_merkle_manifest(spark, sf_dir)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert rows(got) == brute(docs)


def test_many_sources_and_one_of_a_third_of_all_rows(spark, tmp_path):
    rng = random.Random(2)
    made = [(k, rng.choice(("TEXT one", "text", "", None)), "en", "hot" if k % 3 == 0 else rng.choice((None, "", "é", "Z", "z\U0001f600", f"s{rng.randrange(400)}")), k) for k in range(6000)]
    rng.shuffle(made)
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(op11_merkle_manifest(spark, str(tmp_path))) == brute(docs.collect())


def test_few_rows(spark, tmp_path):
    for n in (1, 2):
        docs = spark.createDataFrame([(7 * k, "One", "en", "s" if k else None, None) for k in range(n)], "doc_id long, text string, lang string, source string, n_chars long")
        docs.write.parquet(f"{tmp_path}/{n}/documents.parquet")
        assert rows(op11_merkle_manifest(spark, f"{tmp_path}/{n}")) == brute(docs.collect())


def test_odd_rows(spark, tmp_path):
    docs = odd(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(op11_merkle_manifest(spark, str(tmp_path))) == brute(docs.collect())
    assert M.manifest(empty(spark)).count() == 0
