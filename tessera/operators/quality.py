"""Data-quality rules as data: each is a query for the offending rows, over views of the model.

A rule that finds nothing passes; otherwise its outcome is its severity. Every rule is set-based, and rules of one kind
(null counts, domains) share one pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import settled

# Allowed enum members, columns that must be filled, and tolerances of the checks.
DOMAINS = {
    "period_type": ("annual", "ytd_cumulative", "monthly", "point_in_time"),
    "calorific_basis": ("PCI", "PCS", "NA", "GROSS", "NET"),
    "data_status": ("final", "provisional", "estimated", "revised"),
    "aggregation_role": ("leaf", "grand_total", "subtotal", "alternative_breakdown"),
    "extraction_confidence": ("normal", "low"),
    "report_type": ("bilan", "memento", "rapport", "conjoncture", "covid_bulletin"),
}
MANDATORY = ("observation_id", "indicator_id", "unit_id", "source_id", "period_type", "period_start", "period_end", "calorific_basis", "data_status", "series_key", "upsert_key")
FLAGS = ("is_total", "is_derived", "is_preferred", "is_escalated")


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    sql: str
    about: str


def unique(column: str, view: str = "bad") -> str:
    return f"select {column} as offender, count(*) as n from {view} group by {column} having count(*) > 1 or {column} is null"


def one_value(columns: tuple[str, ...], view: str = "bad") -> str:
    counts = ", ".join(f"count(distinct {c}) as n_{c}" for c in columns)
    return f"select series_key as offender, {counts} from {view} group by series_key having " + " or ".join(f"count(distinct {c}) > 1" for c in columns)


def null_counts(columns: tuple[str, ...], view: str = "bad") -> str:
    """One row a column with nulls, from one pass over the view."""
    sums = ", ".join(f"sum(case when {c} is null then 1 else 0 end) as n{i}" for i, c in enumerate(columns))
    arms = " union all ".join(f"select '{c}' as offender, cast(n{i} as bigint) as n from sums where n{i} > 0" for i, c in enumerate(columns))
    return f"with sums as (select {sums} from {view}) {arms}"


def outside(domains: dict[str, tuple[str, ...]], view: str = "bad") -> str:
    arms = (f"select '{c}' as domain, {c} as offender, count(*) as n from {view} where {c} not in ({', '.join(repr(x) for x in members)}) group by {c}" for c, members in domains.items())
    return " union all ".join(arms)


def orphans(column: str, view: str, parent: str, key: str) -> str:
    return f"select '{column}' as reference, {column} as offender, count(*) as n from {view} c where {column} is not null and not exists (select 1 from {parent} p where p.{key} = c.{column}) group by {column}"


def orphan_members(rows: DataFrame, references: dict[str, DataFrame]) -> DataFrame:
    """(reference, offender, n): members that rows refer to and that the dimension tables don't hold; `references` by column.

    One pass over the rows, whatever the number of references; only the distinct members are joined.
    """
    used = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("reference"), F.col(c).cast("string").alias("offender")) for c in references])).alias("r")).select("r.*")
    used = used.where("offender is not null").groupBy("reference", "offender").agg(F.count("*").alias("n"))
    known = reduce(DataFrame.unionByName, [ids.select(F.lit(c).alias("reference"), F.col(ids.columns[0]).cast("string").alias("offender")) for c, ids in references.items()])
    return used.join(known.distinct(), ["reference", "offender"], "left_anti")


def outside_members(rows: DataFrame, domains: dict[str, tuple[str, ...]]) -> DataFrame:
    """(domain, offender, n): enum members that are not known, from one pass over the rows."""
    wrong = [F.when(~F.col(c).isin(*members), F.struct(F.lit(c).alias("domain"), F.col(c).alias("offender"))) for c, members in domains.items()]
    return rows.select(F.explode(F.array_compact(F.array(*wrong))).alias("w")).select("w.*").groupBy("domain", "offender").agg(F.count("*").alias("n"))


def cycles(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(offender, length): the nodes that come back to themselves along their parents, however long the way.

    Pointer doubling: after k rounds each node knows who stands 2 ** k steps above it and the least node on the way. Nodes
    whose way ends at a root drop out as it does, so what stays leads into cycles; once 2 ** k is as many as stay, whoever
    is pointed at stands on a cycle, and the least node names it. A node has one parent; of several the least counts.
    """
    state = edges.where(F.col(child).isNotNull() & F.col(parent).isNotNull()).groupBy(F.col(child).cast("string").alias("node")).agg(F.min(F.col(parent).cast("string")).alias("above"))
    state = settled(state.select("node", "above", F.col("node").alias("least")))
    steps, left = 1, state.count()
    while left and steps < left:
        ends = state.select(F.col("node").alias("above"), F.col("above").alias("next"), F.col("least").alias("beyond"))
        state = settled(state.join(ends, "above").select("node", F.col("next").alias("above"), F.least("least", "beyond").alias("least")))
        steps, left = 2 * steps, state.count()
    state = settled(state.join(state.select(F.col("node").alias("above")).distinct(), "above", "left_semi"))  # a last step that ends
    on = state.select(F.col("above").alias("node")).distinct().join(state, "node").select("node", "least")
    sizes = on.groupBy("least").agg(F.count("*").alias("length"))
    return on.join(sizes, "least").select(F.col("node").alias("offender"), "length")


def trees(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(offender, length) of nodes on cycles, a node that is its own parent being one of length 1, and -1 for nodes whose parent is unknown."""
    known = edges.select(F.col(child).alias("__known")).distinct()
    dangling = edges.where(F.col(parent).isNotNull()).join(known, F.col(parent) == F.col("__known"), "left_anti")
    return cycles(edges, child, parent).unionByName(dangling.select(F.col(child).cast("string").alias("offender"), F.lit(-1).cast("long").alias("length")))


def run_frames(rules: dict[str, tuple[str, Callable[[], DataFrame]]]) -> list[tuple[str, str, int]]:
    """The same for rules that are frames: by name a severity and what makes the frame of offenders."""
    out = []
    for name, (severity, made) in rules.items():
        try:
            n = made().count()
            out.append((name, severity if n else "PASS", n))
        except Exception as error:
            out.append((name, f"ERROR: {str(error)[:200]}", 0))
    return out


def run(spark: SparkSession, rules: list[Rule], execute: Callable[[SparkSession, str], DataFrame]) -> list[tuple[str, str, int]]:
    """(rule, outcome, offending rows) of each rule; a rule that fails to run is an ERROR, and the others still run."""
    out = []
    for rule in rules:
        try:
            n = execute(spark, rule.sql).count()
            out.append((rule.name, rule.severity if n else "PASS", n))
        except Exception as error:
            out.append((rule.name, f"ERROR: {str(error)[:200]}", 0))
    return out
