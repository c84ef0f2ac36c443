"""The corpus pipeline: quality rules, near-duplicates, decontamination, secret scans, then encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written and read
again in between. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, near_copies, quality_rules, secret_scan, spaced_seeds
from tessera.llm.common import remove, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; trusted are those labelled of quality and not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep_good(docs, labels.where("quality = 1 and toxic = 0").select("doc_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, at a similarity of 0.8 of five-word shingles, the document with the smallest doc_id stays."""
    return near_copies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return spaced_seeds.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars follows."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and of the bytes they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    ids_text = F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(ids_text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secrets),
    ("byte-level BPE", encoding),
]

#: XXH64 fingerprints, spaced seeds, guess costs and BPE merges are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over `documents`, each result written to the shared folder and read again.

    A result goes when the next stage has written its own; what the last stage reads stays with the session's checkpoints.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
            if k:
                remove(spark, f"{base}/{k - 1}")
    return docs
