"""The catalog: one row a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The dimensions of a display name and the words before them.
NAMED = (("flow_id", "flow"), ("product_id", "product"), ("field_id", "field"), ("level_id", "level"), ("sector_id", "sector"), ("region_id", "region"), ("producer_id", "producer"), ("technology", "tech"), ("scope", "scope"), ("geography_scope", "geo"))


def display_name(indicator: Column, columns: dict[str, Column], basis: Column, unit: Column, period_type: Column, redevance: Column | None = None) -> Column:
    """A name that tells look-alike series apart: indicator, dimensions, basis, unit, period."""
    dims = [F.when(columns[c] != "", F.concat(F.lit(f"{word}="), F.substring_index(columns[c], ".", -1))) for c, word in NAMED if c in columns]
    if redevance is not None:
        dims.append(F.when(redevance != "", F.concat(F.lit("redevance="), F.substring_index(redevance, ".", -1))))
    inside = F.concat_ws(", ", *dims)
    parts = F.concat_ws(
        " ",
        F.when(inside != "", F.concat(F.lit("["), inside, F.lit("]"))),
        F.when((basis != "") & (basis != "NA"), F.concat(F.lit("basis "), basis)),
        F.concat(F.lit("("), unit, F.lit(")")),
        F.when(period_type == "ytd_cumulative", "year-to-date").when(period_type.isin("annual", "monthly"), period_type),
    )
    return F.concat_ws(" — ", indicator, parts)


#: The columns of the catalog as it is published, each with the column here that gives it.
PUBLISHED = {
    "series_id": "series_key", "display_name": "display_name", "aggregation_role": "aggregation_role", "definition": "definition", "unit": "unit_id",
    "calorific_basis": "calorific_basis", "basis_confidence": "basis_confidence", "period_type": "period_type", "flow": "flow_id", "product": "product_id", "sector": "sector_id",
    "region": "region_id", "field": "field_id", "level": "level_id", "producer": "producer_id", "technology": "technology", "scope": "scope", "geography_scope": "geography_scope",
    "redevance_toggle": "redevance_toggle_id", "is_total": "is_total", "n_obs": "n_obs", "first_year": "first_year", "last_year": "last_year", "n_sources": "n_sources",
    "families": "families", "templates": "templates", "confidence": "confidence", "escalated": "escalated",
}
#: Columns that each search tier holds, the most telling first.
TIERS = {"t1": ("indicator_id",), "t2": ("product_id", "field_id", "technology"), "t3": ("sector_id", "region_id", "level_id", "producer_id", "scope", "geography_scope", "calorific_basis"), "t4": ("flow_id", "definition", "families", "period_type")}


def published(found: DataFrame) -> DataFrame:
    """The catalog under its published columns; what the observations don't have is null."""
    return found.select(*[(F.col(c) if c in found.columns else F.lit(None).cast("string")).alias(name) for name, c in PUBLISHED.items()])


def tiers(found: DataFrame) -> DataFrame:
    """The catalog with its search tiers: the words of each tier's columns in lower case."""
    return found.withColumns({t: F.lower(F.concat_ws(" ", *[F.col(c) for c in columns if c in found.columns])) for t, columns in TIERS.items()})


def catalog(obs: DataFrame, indicator: str = "indicator_id") -> DataFrame:
    """One row a series: its qualifiers, years, counts and families; a repeated name gets its id behind it.

    Text maxima are lexicographic on purpose: the role shown is the largest, the confidence the smallest.
    """
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "/")
    keys = ["series_key", indicator, "unit_id", "calorific_basis", "period_type", *[c for c in (*[c for c, _ in NAMED], "basis_confidence", "redevance_toggle_id") if c in obs.columns]]
    templates = [joined("template_version").alias("templates")] if "template_version" in obs.columns else []
    rows = obs.groupBy(*keys).agg(
        F.max("aggregation_role").alias("aggregation_role"), F.bool_or("is_total").alias("is_total"), F.count("*").alias("n_obs"),
        F.min("ref_year").alias("first_year"), F.max("ref_year").alias("last_year"), F.countDistinct("source_id").alias("n_sources"),
        joined("report_type").alias("families"), F.min("extraction_confidence").alias("confidence"), F.bool_or("is_escalated").alias("escalated"), *templates,
    )
    name = display_name(F.col(indicator), {c: F.col(c) for c, _ in NAMED if c in obs.columns}, F.col("calorific_basis"), F.col("unit_id"), F.col("period_type"), F.col("redevance_toggle_id") if "redevance_toggle_id" in obs.columns else None)
    named = rows.withColumn("display_name", name)
    again = F.row_number().over(Window.partitionBy("display_name").orderBy("series_key")) > 1
    named = named.withColumn("display_name", F.when(again, F.concat(F.col("display_name"), F.lit("  «"), F.col("series_key"), F.lit("»"))).otherwise(F.col("display_name")))
    definition = F.concat(F.col(indicator), F.lit(". "), F.col("display_name"), F.lit(". Source families: "), F.col("families"), F.lit("; period_type="), F.col("period_type"), F.lit("; years "), F.col("first_year").cast("string"), F.lit("–"), F.col("last_year").cast("string"), F.lit(". Aggregation role: "), F.col("aggregation_role"), F.lit("."))
    return named.withColumn("definition", definition)
