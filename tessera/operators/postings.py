"""Search postings: which series hold which pieces of words, in which tier.

The catalog's search tiers are cut into pieces of two and three characters. A term's pieces pick the series that hold all
of them in one tier; only those series' texts are then looked at, to see whether the term itself stands there. Nothing
else of the catalog is read, whatever its size, and many queries go through together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .api import WEIGHTS

#: Characters of a piece; terms of two characters are their own piece.
PIECES = (2, 3)
TIERS = ("t1", "t2", "t3", "t4")


def pieces(text: Column, size: int) -> Column:
    """The distinct pieces of `size` characters."""
    n = F.length(text)
    return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def texts(tiered: DataFrame, key: str = "series_key") -> DataFrame:
    """(key, tier, text): one row a tier, from a catalog with its tiers."""
    each = F.array(*[F.struct(F.lit(i).alias("tier"), F.coalesce(F.col(t), F.lit("")).alias("text")) for i, t in enumerate(TIERS)])
    return tiered.select(F.col(key).alias("key"), F.explode(each).alias("x")).select("key", "x.*").where("text <> ''")


def postings(found: DataFrame) -> DataFrame:
    """(piece, key, tier) of texts(key, tier, text)."""
    both = F.concat(*[pieces(F.col("text"), n) for n in PIECES])
    return found.select(F.explode(both).alias("piece"), "key", "tier")


def terms(queries: DataFrame) -> DataFrame:
    """(qid, term, times): the terms of queries(qid, query): lower case, of two characters or more, with how often each comes."""
    low = F.translate(F.lower("query"), "'-", "  ")
    each = queries.select("qid", F.explode(F.filter(F.split(low, r"\s+"), lambda t: F.length(t) > 1)).alias("term"))
    return each.groupBy("qid", "term").agg(F.count("*").alias("times"))


def search(queries: DataFrame, index: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, key, score): each term counts the weight of the first tier that holds it, as often as the query has it."""
    asked = terms(queries)
    distinct = asked.select("term").distinct()
    own = F.when(F.length("term") == 2, F.array("term")).otherwise(pieces(F.col("term"), 3))
    wanted = distinct.select("term", F.explode(own).alias("piece"), F.size(own).alias("needs"))
    hits = wanted.join(index, "piece").groupBy("term", "key", "tier", "needs").agg(F.count("*").alias("has")).where("has = needs")
    sure = hits.join(found, ["key", "tier"]).where(F.contains("text", F.col("term"))).groupBy("term", "key").agg(F.min("tier").alias("tier"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("tier") + 1)
    return asked.join(sure, "term").groupBy("qid", "key").agg(F.sum(weight * F.col("times")).alias("score"))


def best(scored: DataFrame, catalog: DataFrame, limit: int) -> DataFrame:
    """The best `limit` of each query, by score, then observations, then key."""
    from pyspark.sql import Window

    ranked = scored.join(catalog.select(F.col("series_key").alias("key"), "n_obs"), "key")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("n_obs"), "key"))
    return ranked.withColumn("place", place).where(F.col("place") <= limit)
