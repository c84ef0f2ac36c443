"""Quality rules: fixed counts of a text, and a hashed n-gram log-likelihood ratio against a trusted target.

Everything here is DataFrame functions. Words and word pairs are hashed into `buckets` features; the target multinomial
is counted over the trusted documents and the raw one over all documents, both smoothed by one count a bucket. A
document's verdict is the mean over its features of log(target / raw), compared with a fixed threshold: no sampling.

Repeated windows are found by a 64-bit hash and then compared word by word, so different words never count as equal.

Defined cases: a null text has no words and fails the base rules, as an empty one does; a document without words scores
0; whole texts are judged, the longest too, in memory in proportion to their length; repeated rows are judged alike and
each counts in the raw multinomial; a mean equal to the threshold passes; a null id is never trusted; without trusted
documents every ratio is that of the smoothed raw counts alone, and so a constant minus their log; extra columns of any
name are kept by `judge`; no rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_or_plain

#: White space between words: \x20 and \x09-\x0D.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
BUCKETS = 10_000
#: Multiplies the first word's hash in a pair; times a 32-bit hash it stays far below 2 ** 63.
PAIR = 1_000_003
THRESHOLD = -0.12


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def text_counts(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols and n_dup_lines of a non-null text."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACE, "") != "")
    return {
        "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows of `window` words that occur twice or more in the array of words.

    Only texts in which the hash of some window repeats are sorted: first by hash, then what is left by the windows' own
    words. The positions are put in order again to add up what each window covers beyond the last.
    """

    def heads(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    def again(s: Column) -> Column:
        """Of an array sorted by x.h, the elements whose h is not alone."""
        return F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))

    def gaps(at: Column) -> Column:
        each = F.transform(at, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - x, F.lit(window))))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    def covered(wins: Column) -> Column:
        hashed = F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        exact = let(hashed, lambda s: F.sort_array(F.transform(again(s), lambda x: F.struct(F.slice(words, x["i"] + 1, window).alias("h"), x["i"].alias("i")))))
        return let(let(exact, lambda s: F.sort_array(F.transform(again(s), lambda x: x["i"]))), gaps)

    def count(wins: Column) -> Column:
        return F.when(F.size(F.array_distinct(wins)) == F.size(wins), F.lit(0).cast("long")).otherwise(covered(wins))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < window + 1, F.lit(0).cast("long")).otherwise(let(let(hashes, heads), count))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.crc32(w.cast("binary")))


def features(hashes: Column, buckets: int = BUCKETS) -> Column:
    """Feature numbers of the words and of the pairs of neighbouring words."""

    def both(h: Column) -> Column:
        one = F.transform(h, lambda x: (x % buckets).cast("int"))
        after = F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0)))
        return F.concat(one, F.transform(after, lambda x, i: ((F.get(h, i) * PAIR + x) % buckets).cast("int")))

    return let(hashes, both)


def weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> list[float]:
    """log(target / raw) of each feature, from counts over all documents; `trusted` holds the ids of the target's.

    The two counts of at most `buckets` rows are added up before the shuffle, so frequent words meet no single task.
    """
    ids = trusted.select(F.col(id_col).alias("__id")).where("__id is not null").distinct().withColumn("__t", F.lit(1))
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    marked = own.join(small_or_plain(ids), "__id", "left")
    each = marked.select(F.coalesce("__t", F.lit(0)).alias("t"), F.explode(features(word_hashes(words(F.coalesce("__text", F.lit("")))), buckets)).alias("f"))
    counts = each.groupBy("f").agg(F.count("*").alias("raw"), F.sum("t").alias("target")).collect()  # at most `buckets` rows
    raw, target = [1] * buckets, [1] * buckets
    for f, r, t in counts:
        raw[f] += r
        target[f] += t
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(t) - math.log(r) + shift for r, t in zip(raw, target, strict=True)]


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> tuple[DataFrame, str]:
    """The documents with a struct column of a name that they don't have, and that name.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.
    """
    logs = F.lit(weights(docs, trusted, id_col, text_col, buckets))
    name = fresh(docs, "quality_rules")
    field = lambda x: F.col(f"{name}.{x}")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    out = docs.withColumn(name, F.struct(*[v.alias(k) for k, v in text_counts(text).items()], words(text).alias("w")))
    total = F.aggregate(features(word_hashes(field("w")), buckets), F.lit(0.0), lambda a, f: a + F.get(logs, f))
    kept_counts = [field(x).alias(x) for x in ("word_chars", "n_symbols", "n_dup_lines")]
    out = out.withColumn(name, F.struct(F.size(field("w")).cast("long").alias("n_words"), *kept_counts, repeated_words(field("w")).alias("n_repeat_words"), total.alias("llr")))
    failed = (field("n_words") < 20) | (100 * field("n_repeat_words") > 30 * field("n_words"))
    llr = F.when(field("n_words") == 0, 0.0).otherwise(field("llr") / (2 * field("n_words") - 1))
    counts = [field(x).alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    out = out.withColumn(name, F.struct(*counts, failed.alias("base_failed"), llr.alias("llr"), (~failed & (llr >= threshold)).alias("kept")))
    return out, name


def keep_good(docs: DataFrame, trusted: DataFrame, **how) -> DataFrame:
    """The documents that pass, with their own columns.

    A filter on a deterministic column would be pushed below the projections and hold a copy of all their expressions for
    each use of a count, so the verdict is tied to the partition's number, which keeps it where it is computed once.
    """
    judged, name = judge(docs, trusted, **how)
    passed = F.col(f"{name}.kept") & (F.spark_partition_id() >= 0)
    return judged.withColumn(name, passed).where(F.col(name)).drop(name)
