"""Idempotent upserts as set operations: new keys are appended, known ones are left, contradictions are set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled

# When a repeated value contradicts the stored one, and fields whose naming is escalated.
VALUE_TOLERANCE = 0.01
ESCALATED_FIELDS = ("barka", "maamoura_baraka")
DEFAULTS = {"calorific_basis": "NA", "basis_confidence": "stated", "extraction_method": "coordinate_map", "extraction_confidence": "normal", "data_status": "final"}


def first_of_each(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return batch.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def insert_or_ignore(stored: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows to append: the first of each key of the batch that is not stored; all others are ignored."""
    return first_of_each(batch.join(stored.select(key), key, "left_anti"), key, order)


def upsert(stored: DataFrame, batch: DataFrame, order: list[str], key: str = "upsert_key", value: str = "value", cell: str = "source_cell") -> tuple[DataFrame, DataFrame]:
    """(rows to append, collisions).

    A key of the batch that is stored, or comes a second time in it, adds nothing; it is a collision if its value is
    apart by more than VALUE_TOLERANCE and it comes from another cell. The first row of a key stays.
    """
    seen = stored.select(F.col(key), F.col(value).alias("kept_value"), F.col(cell).alias("kept_cell"))
    firsts = first_of_each(batch, key, order)
    fresh = firsts.join(seen.select(key), key, "left_anti")
    known = seen.unionByName(fresh.select(F.col(key), F.col(value).alias("kept_value"), F.col(cell).alias("kept_cell")))
    apart = ~F.col(value).eqNullSafe(F.col("kept_value")) & F.coalesce(F.abs(F.col(value) - F.col("kept_value")) > VALUE_TOLERANCE, F.lit(True))
    collisions = batch.join(known, key).where(apart & ~F.col(cell).eqNullSafe(F.col("kept_cell")))
    context = F.concat(F.lit("kept="), F.col("kept_value").cast("string"), F.lit(" at "), F.col("kept_cell"), F.lit("; new="), F.col(value).cast("string"), F.lit(" at "), F.col(cell))
    return fresh, collisions.select(key, value, cell, "kept_value", "kept_cell", F.lit("SERIES_KEY_COLLISION").alias("dimension"), context.alias("context"))


def with_defaults(batch: DataFrame) -> DataFrame:
    have = set(batch.columns)
    return batch.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v) for c, v in DEFAULTS.items()})


def escalate(batch: DataFrame, field: str = "field_id", note: str = "FN-FIELD-NAME") -> DataFrame:
    """Rows of fields with a disputed name are escalated once, with a reference and a footnote."""
    disputed = F.coalesce(F.col(field).isin(*ESCALATED_FIELDS, *[f"field.{x}" for x in ESCALATED_FIELDS]), F.lit(False)) & ~F.coalesce(F.col("is_escalated"), F.lit(False))
    notes = F.coalesce(F.col("footnotes"), F.array().cast("array<string>"))
    return batch.withColumns({
        "is_escalated": F.coalesce(F.col("is_escalated"), F.lit(False)) | disputed,
        "escalation_ref": F.when(disputed, "OQ-F2").otherwise(F.col("escalation_ref")),
        "footnotes": F.when(disputed, F.array_union(notes, F.array(F.lit(note)))).otherwise(notes),
    })


def with_ids(fresh: DataFrame, above: int, order: list[str], name: str = "observation_id") -> DataFrame:
    """Ids from `above` + 1 in load order.

    Rows are numbered inside range partitions and the partitions' sizes added up, so no single task sorts all rows.
    """
    placed = fresh.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    placed = settled(placed)  # the partitions must not be drawn anew between the two uses
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    if not before:
        return placed.drop("part", "nth").withColumn(name, F.lit(None).cast("long"))
    base = F.element_at(F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)]), F.col("part"))
    return placed.withColumn(name, (F.lit(above) + base + F.col("nth") + 1).cast("long")).drop("part", "nth")
