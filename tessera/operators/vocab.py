"""Labels to vocabulary ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_label


def names(vocab: DataFrame, id_col: str, label_cols: list[str], alias_col: str | None, order: str) -> DataFrame:
    """(name, id, ord): every normalised label and alias; the first id in vocabulary order owns a name."""
    listed = F.array_compact(F.array(*[F.col(c) for c in label_cols]))
    if alias_col:
        listed = F.concat(listed, F.split(F.coalesce(F.col(alias_col), F.lit("")), r"\|"))
    each = vocab.select(F.col(id_col).alias("id"), F.col(order).alias("o"), F.posexplode(listed).alias("p", "label")).select(norm_label(F.col("label")).alias("name"), "id", F.struct("o", "p").alias("ord"))
    return each.where("name <> ''").groupBy("name").agg(F.min_by("id", "ord").alias("id"), F.min("ord").alias("ord"))


def _grams(words: Column, longest: int) -> Column:
    """The distinct runs of at most `longest` words, joined by spaces."""

    def of(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.size(words), F.lit(max(longest, 1)))), of)))


def quarantine(missed: DataFrame, label: str, dimension: str, source: str, ref: str, page: str, row: str, values: list[str]) -> DataFrame:
    """Labels that nothing knows, with all that a reader needs to place them: source, table, dimension, and in the context
    the page, the row and the values beside the label."""
    listed = F.array_join(F.array(*[F.coalesce(F.col(v).cast("string"), F.lit("None")) for v in values]), ", ")
    context = F.concat(F.lit("page"), F.col(page).cast("string"), F.lit(" y="), F.col(row).cast("string"), F.lit(" values=["), listed, F.lit("]"))
    return missed.select(F.col(source).alias("source_id"), F.col(ref).alias("source_ref"), F.lit(dimension).alias("dimension"), F.col(label).alias("raw_label"), context.alias("context"))


def match(labels: DataFrame, label: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels with `id`, labels without any).

    A normalised label that is a name takes its id; else the first name in vocabulary order that begins the label or
    stands in it as whole words; else the label is set aside. Each distinct label is matched once, by an equi-join of
    its runs of words with the names, so vocabularies may have any size.
    """
    own = labels.withColumn("norm", norm_label(F.col(label)))
    each = own.select("norm").distinct()
    exact = each.join(known.select(F.col("name").alias("norm"), "id"), "norm")
    rest = each.join(exact, "norm", "left_anti").where("norm <> ''")
    longest = known.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 0
    inside = rest.select("norm", F.explode(_grams(F.split("norm", " "), longest)).alias("name")).join(known, "name")
    loose = inside.groupBy("norm").agg(F.min_by("id", "ord").alias("id"))
    found = own.join(exact.unionByName(loose), "norm")
    return found.drop("norm"), own.join(exact.unionByName(loose).select("norm"), "norm", "left_anti").drop("norm")
