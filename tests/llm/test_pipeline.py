import base64

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tessera.llm import secret_scan

from .helpers import empty, odd
from .test_near_copies import brute_groups


def test_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows[name] = out.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(rows[name], docs.schema)
    kept = {n: {r.doc_id for r in x} for n, x in rows.items()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near-duplicates", "decontamination", "secret scan", "byte-level BPE"]
    judged = [(i, before[i]) for i in sorted(kept["quality rules"])]
    assert kept["near-duplicates"] == {i for (i, _), low in zip(judged, brute_groups(judged), strict=True) if low == i}
    assert kept["decontamination"] < kept["near-duplicates"] and kept["secret scan"] == kept["decontamination"] == kept["byte-level BPE"]
    assert all(not secret_scan.spans(r.text) and r.n_chars == len(r.text) for r in rows["secret scan"])
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}, special_tokens={})
    texts = {r.doc_id: r.text for r in rows["secret scan"]}
    assert all(r.ids == enc.encode_ordinary(texts[r.doc_id]) for r in rows["byte-level BPE"])
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.ids_sha256) for r in whole} == {(r.doc_id, r.ids_sha256) for r in rows["byte-level BPE"]}


def test_odd_rows_pass_every_stage(spark, sf_dir):
    for docs in (odd(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            out.collect()
            if name != "byte-level BPE":
                assert out.columns == docs.columns
