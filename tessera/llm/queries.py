"""The registered queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_quality, bpe, chat_tree, context_mixing, language_id, merkle, periodic_runs, quality_rules, secret_scan, simhash_dedup, spaced_seeds, url_reputation, warc
from .common import remove, settled, shared_dir
from .oracles import ORACLES, chat_sql, reputation_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The fixed rules of op1; the longest that fits a host and path wins.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document whose number stands in its path: good if of quality and not toxic.

    risk_permille: the posterior probability, in thousandths, that fewer than half of the host's pages are good.
    """
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)).alias("good"))
    url = F.col("url")
    numbered = pages.select(url_reputation.host_of(url).alias("host"), F.expr("try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) as bigint)").alias("doc_id"))
    outcomes = numbered.join(labels, "doc_id").select("host", "good")
    return url_reputation.judge(pages, outcomes, RULES).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", F.round(1000 * F.col("risk")).cast("long").alias("risk_permille"))


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op2_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = attention_quality.train(docs, _table(spark, sf_dir, "labels").where(_remainder(3) != 1))
    found = attention_quality.score(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    return chat_tree.digests(turns.unionByName(spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(_remainder(5) != 0))
    found = language_id.identify(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (_remainder(5) == 0).alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    judged, name = quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"), labels.where("quality = 1 and toxic = 0").select("doc_id"))
    return judged.select("doc_id", *[f"{name}.{x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spaced_seeds.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(warc.records(_table(spark, sf_dir, "pages")), path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:x-page:(-?[0-9]+)', 1) as bigint)")

    def rows(back: DataFrame, kind: str, size, digest) -> DataFrame:
        return back.where(F.col("warc_type") == kind).select(number("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), F.lit(kind).alias("record_type"), number("refers_to").alias("refers_to"))

    responses = rows(warc.read(spark, path), "response", F.octet_length("payload").cast("long"), warc.base32_sha1(F.col("payload")))
    revisits = rows(warc.read(spark, path, payload=False), "revisit", F.col("declared_length"), F.substring_index("payload_digest", ":", -1))
    out = responses.unionByName(revisits)
    out = settled(out)  # a few columns a page, so that the archive need not stay
    remove(spark, path)
    return out


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = joined(F.filter("spans", lambda x: x["kind"] != "guess"))
    return found.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves by source, with the texts of one document in five tampered with when the root is folded again."""
    return merkle.manifest(_table(spark, sf_dir, "documents"), tampered=_remainder(5) == 0).withColumnRenamed("id", "doc_id")


def op12_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = context_mixing.score(_table(spark, sf_dir, "documents"), _remainder(5) == 1)
    return found.withColumnRenamed("id", "doc_id").drop("n_bytes")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text, in one text of ten of those that are made to repeat."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", periodic_runs.looped(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic_runs.digests(periodic_runs.runs_of(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_reputation, op2_attention_quality, op3_chat_tree, op4_language_id, op5_quality_rules, op6_simhash_dedup, op7_spaced_seeds, op8_warc, op9_byte_bpe, op10_secret_scan, op11_merkle_manifest, op12_context_mixing, op13_periodic_runs)}
ORACLES["op1_url_reputation"] = reputation_sql(url_reputation.TWO_LABELS, RULES, url_reputation.LIMIT, url_reputation.TAIL)
ORACLES["op3_chat_tree"] = chat_sql(chat_tree.CONTROL, "</s>[INST] ok [/INST]")
