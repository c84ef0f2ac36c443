"""Settling overlapping editions: precedence, views, reconciliation, and distrust of what does not add up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import REPORT_RANK, STATUS_RANK, ranked
from ..sources.shared import settled as kept
from ..sources.shared import small_or_plain

CELL = ("series_key", "period_start", "period_end")
#: What one printed table says of one period in one edition.
TABLE = ("source_id", "source_ref", "period_start", "period_end")
# Tolerances (least, share) of the log and of leaf sums.
LOG_TOLERANCE, SUM_TOLERANCE = (5.0, 0.02), (8.0, 0.05)
# By table the row that is its printed grand total, which all leaves must add up to.
GRAND_TOTALS = {
    "C-T14": "product_id = 'prod.petroleum_products_total'",
    "C-T15": "flow_id = 'flow.demand' and coalesce(scope, '') = '' and coalesce(level_id, '') = ''",
    "C-T16": "flow_id = 'flow.demand' and coalesce(scope, '') = '' and coalesce(level_id, '') = ''",
    "C-T20": "flow_id = 'flow.primary_production' and coalesce(producer_id, '') = '' and coalesce(technology, '') = '' and coalesce(scope, '') = ''",
    "C-T21": "flow_id = 'flow.sales' and coalesce(level_id, '') = '' and coalesce(geography_scope, '') = ''",
}


def precedence(obs: DataFrame, load: str = "load_key", published: str | None = None) -> DataFrame:
    """The observations with is_preferred and supersedes_id.

    In each cell the winner has the highest report type, then status, then the latest publication, then the earliest
    load. One shuffle by cell; the window needs no more than a cell's editions at a time.
    """
    late = [F.col(published).desc_nulls_last()] if published else []
    w = Window.partitionBy(*CELL).orderBy(ranked(F.col("report_type"), REPORT_RANK).desc(), ranked(F.col("data_status"), STATUS_RANK).desc(), *late, load, "observation_id")
    placed = obs.withColumns({"place": F.row_number().over(w), "winner": F.first("observation_id").over(w)})
    return placed.withColumns({"is_preferred": F.col("place") == 1, "supersedes_id": F.when(F.col("place") > 1, F.col("winner"))}).drop("place", "winner")


def series(settled: DataFrame) -> DataFrame:
    return settled.where("is_preferred")


def clean(view: DataFrame) -> DataFrame:
    """The default surface: without low confidence and escalated rows."""
    return view.where("extraction_confidence <> 'low' and not is_escalated")


def detail(settled: DataFrame) -> DataFrame:
    """Leaves of the preferred rows only."""
    return settled.where("is_preferred and not is_total")


def beyond(a, b, tolerance):
    """|a - b| over the larger of the least and the share of |b|."""
    return F.abs(a - b) > F.greatest(F.lit(tolerance[0]), tolerance[1] * F.abs(b))


def reconciliation_log(settled: DataFrame) -> DataFrame:
    """One row for each cell that several sources report, with what each says and how it was resolved.

    Of a source that reports a cell several times the last value, by observation_id, is listed.
    """
    listed = F.sort_array(F.collect_list(F.when(F.col("source_id").isNotNull(), F.struct("source_id", "observation_id", "value"))))
    last = lambda s: F.filter(s, lambda x, i: ~F.get(s, i + 1)["source_id"].eqNullSafe(x["source_id"]))
    pairs = F.transform(last(F.col("listed")), lambda x: F.struct(x["source_id"], x["value"]))
    cells = settled.where("value is not null").groupBy(*CELL, "ref_year", "period_type", "calorific_basis").agg(
        F.countDistinct("source_id").alias("n_sources"), F.max("value").alias("high"), F.min("value").alias("low"),
        listed.alias("listed"), F.max(F.when(F.col("is_preferred"), F.col("source_id"))).alias("winner"),
    )
    apart = F.col("high") - F.col("low") > F.greatest(F.lit(LOG_TOLERANCE[0]), LOG_TOLERANCE[1] * F.abs(F.col("high")))
    return cells.where("n_sources > 1").select(
        *CELL, "ref_year", "period_type", "calorific_basis", "n_sources", "high", "low",
        F.to_json(F.map_from_entries(pairs)).alias("values_json"),
        F.when(apart, F.concat(F.lit("precedence:"), F.col("winner"))).otherwise("agree").alias("resolution"),
        F.when(apart, "disagreement>tol").otherwise("within tolerance").alias("note"),
    )


def leaf_sums(obs: DataFrame, keys: list[str], amount: str = "amount") -> DataFrame:
    """(keys, leaves, total, n_leaf, n_grand): leaves against the grand total, in one aggregation."""
    return obs.groupBy(*keys).agg(
        F.sum(F.when(F.col("aggregation_role") == "leaf", F.col(amount))).alias("leaves"),
        F.max(F.when(F.col("aggregation_role") == "grand_total", F.col(amount))).alias("total"),
        F.count_if(F.col("aggregation_role") == "leaf").alias("n_leaf"),
        F.count_if(F.col("aggregation_role") == "grand_total").alias("n_grand"),
    )


def off_total(rows: DataFrame, totals: dict[str, str], amount: str = "value") -> DataFrame:
    """The groups of tables whose leaves miss a printed total: TABLE of each. `totals` pins the total's row by table."""
    own = rows.where(F.col("source_ref").isin(*totals) & F.col(amount).isNotNull())
    leaves = own.where("not is_total").groupBy(*TABLE).agg(F.sum(amount).alias("leaves"))
    pinned = reduce(lambda a, b: a | b, [(F.col("source_ref") == ref) & F.expr(where) for ref, where in totals.items()])
    printed = own.where(F.col("is_total") & pinned & (F.col(amount) != 0)).select(*TABLE, F.col(amount).alias("total"))
    off = printed.join(leaves, list(TABLE), "left").where(beyond(F.coalesce("leaves", F.lit(0)).cast("double"), F.col("total").cast("double"), SUM_TOLERANCE))
    return off.select(*TABLE).distinct()


def without_total(rows: DataFrame, tables: tuple[str, ...]) -> DataFrame:
    """The groups of some tables that have no grand total among their preferred rows."""
    own = rows.where(F.col("source_ref").isin(*tables) & F.col("is_preferred"))
    return own.groupBy(*TABLE).agg(F.count_if(F.col("aggregation_role") == "grand_total").alias("n")).where("n = 0").select(*TABLE)


def distrust(settled: DataFrame, totals: dict[str, str] = GRAND_TOTALS, whole: tuple[str, ...] = tuple(GRAND_TOTALS), amount: str = "value") -> DataFrame:
    """The observations with extraction_confidence low in every group of a table whose leaves miss a printed total, and in
    those of the tables in `whole` that have no grand total at all. Other tables stay as they are.

    The second test reads preferred rows only, so this comes after `precedence`.
    """
    if not totals and not whole:
        return settled
    bad = without_total(settled, whole) if whole else off_total(settled, totals, amount)
    if totals and whole:
        bad = bad.unionByName(off_total(settled, totals, amount)).distinct()
    joined = settled.join(small_or_plain(kept(bad.withColumn("bad", F.lit(True)))), list(TABLE), "left")
    return joined.withColumn("extraction_confidence", F.when(F.col("bad"), "low").otherwise(F.col("extraction_confidence"))).select(*settled.columns)
