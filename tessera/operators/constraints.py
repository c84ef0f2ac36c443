"""Declared constraints as rows: what every table of the star must keep, and one check of all of it.

A constraint is a row (name, table, kind, columns, detail, severity). Rows compile into few passes: all null, enum and row
checks of a table into one aggregation of counts, each uniqueness into one aggregation by its columns, and all references
of a table into one pass over the members that it uses, of which only the distinct ones meet the referenced keys. The same
rows say which of a batch's rows break a constraint, for the quarantine.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import small_or_plain

KINDS = ("not_null", "enum", "check", "unique", "reference")


@dataclass(frozen=True)
class Constraint:
    """`detail`: the members of an enum, the condition of a check (broken where it is false), `table.column` of a reference."""

    table: str
    kind: str
    columns: tuple[str, ...]
    detail: tuple[str, ...] = ()
    severity: str = "BLOCK"
    at_load: bool = True  # whether a row that breaks it is kept out, or only reported

    @property
    def name(self) -> str:
        return f"{self.table}.{'+'.join(self.columns)}.{self.kind}" + (f"[{self.detail[0]}]" if self.kind == "check" else "")


# The declared constraints of the star.
PERIOD_TYPES = ("annual", "ytd_cumulative", "monthly", "point_in_time")
ENUMS = {
    "calorific_basis": ("PCI", "PCS", "NA"),
    "basis_confidence": ("stated", "inferred", "na"),
    "aggregation_role": ("leaf", "grand_total", "subtotal", "alternative_breakdown"),
    "period_type": PERIOD_TYPES,
    "data_status": ("final", "provisional", "estimated", "revised"),
    "source_type": ("table", "chart_label"),
    "extraction_method": ("text_geometry", "coordinate_map", "ocr", "chart_label"),
    "extraction_confidence": ("normal", "low"),
}
FILLED = ("indicator_id", "unit_id", "calorific_basis", "basis_confidence", "is_total", "aggregation_role", "period_type", "period_start", "period_end", "data_status", "source_id", "source_type", "extraction_method", "extraction_confidence", "is_derived", "series_key", "upsert_key", "is_escalated")
REFERENCES = {"indicator_id": "indicator", "unit_id": "unit", "source_id": "source", "flow_id": "flow", "product_id": "product", "sector_id": "sector", "region_id": "region", "field_id": "field", "level_id": "level", "producer_id": "producer", "redevance_toggle_id": "redevance_toggle"}
CHECKS = ("period_start <= period_end",)
LATER_CHECKS = ("period_type <> 'ytd_cumulative' or ytd_cutoff_month is not null", "period_type <> 'point_in_time' or period_start = period_end")
TREES = ("flow", "product", "sector")


def declared(columns: tuple[str, ...] | None = None, enums: dict[str, tuple[str, ...]] | None = None) -> list[Constraint]:
    """The constraints of the observations and their dimensions, on the columns that there are; `enums` widens some."""
    has = lambda c: columns is None or c in columns
    out = [Constraint("observation", "not_null", (c,)) for c in ("observation_id", *FILLED) if has(c)]
    out += [Constraint("observation", "enum", (c,), members) for c, members in (ENUMS | (enums or {})).items() if has(c)]
    out += [Constraint("observation", "check", ("period",), (c,), at_load=c in CHECKS) for c in (*CHECKS, *LATER_CHECKS)]
    out += [Constraint("observation", "unique", (c,)) for c in ("observation_id", "upsert_key")]
    out += [Constraint("observation", "reference", (c,), (f"{t}.id",)) for c, t in REFERENCES.items() if has(c)]
    for t in dict.fromkeys(REFERENCES.values()):
        out += [Constraint(t, "not_null", ("id",)), Constraint(t, "unique", ("id",))]
    return out + [Constraint(t, "reference", ("parent",), (f"{t}.id",)) for t in TREES]


def _broken(c: Constraint) -> Column:
    """Whether a row breaks a null, enum or row check; an enum or a check on null is kept."""
    if c.kind == "not_null":
        return F.col(c.columns[0]).isNull()
    return F.coalesce(~F.col(c.columns[0]).isin(*c.detail) if c.kind == "enum" else ~F.expr(c.detail[0]), F.lit(False))


def _rows(named: list[tuple[str, Column]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(n).alias("constraint_name"), v.cast("long").alias("n")) for n, v in named])).alias("r")


def offences(tables: dict[str, DataFrame], constraints: list[Constraint]) -> DataFrame:
    """(constraint_name, n): how many rows, or keys of a uniqueness, break each constraint of the tables that there are."""
    found = []
    for name, rows in tables.items():
        own = [c for c in constraints if c.table == name]
        checks = [c for c in own if c.kind in ("not_null", "enum", "check")]
        if checks:
            found.append(rows.agg(*[F.count_if(_broken(c)).alias(f"c{i}") for i, c in enumerate(checks)]).select(_rows([(c.name, F.col(f"c{i}")) for i, c in enumerate(checks)])).select("r.*"))
        for c in own:
            if c.kind == "unique":
                again = rows.where(F.col(c.columns[0]).isNotNull()).groupBy(*c.columns).agg(F.count("*").alias("k")).where("k > 1")
                found.append(again.agg(F.count("*").alias("n")).select(F.lit(c.name).alias("constraint_name"), "n"))
        references = [c for c in own if c.kind == "reference" and c.detail[0].split(".")[0] in tables]
        if references:
            found.append(_orphans(rows, references, tables))
    return reduce(DataFrame.unionByName, found)


def _used(rows: DataFrame, references: list[Constraint]) -> DataFrame:
    """(constraint_name, member, n): the members that rows refer to, added up before they are shuffled."""
    each = F.array(*[F.struct(F.lit(c.name).alias("constraint_name"), F.col(c.columns[0]).cast("string").alias("member")) for c in references])
    return rows.select(F.explode(each).alias("r")).select("r.*").where("member is not null").groupBy("constraint_name", "member").agg(F.count("*").alias("n"))


def _known(references: list[Constraint], tables: dict[str, DataFrame]) -> DataFrame:
    keys = []
    for c in references:
        table, column = c.detail[0].split(".")
        keys.append(tables[table].select(F.lit(c.name).alias("constraint_name"), F.col(column).cast("string").alias("member")))
    return reduce(DataFrame.unionByName, keys).distinct()


def _orphans(rows: DataFrame, references: list[Constraint], tables: dict[str, DataFrame]) -> DataFrame:
    known = _known(references, tables).withColumn("known", F.lit(True))
    met = _used(rows, references).join(known, ["constraint_name", "member"], "left")
    sums = met.groupBy("constraint_name").agg(F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("n"))
    all_ = rows.sparkSession.createDataFrame([(c.name,) for c in references], "constraint_name string")
    return all_.join(F.broadcast(sums), "constraint_name", "left").select("constraint_name", F.coalesce("n", F.lit(0)).alias("n"))  # as many rows as constraints


def inventory(spark: SparkSession, constraints: list[Constraint]) -> DataFrame:
    """The constraints as a table (constraint_name, table_name, kind, columns, detail, severity)."""
    rows = [(c.name, c.table, c.kind, "+".join(c.columns), "|".join(c.detail), c.severity) for c in constraints]
    return spark.createDataFrame(rows, "constraint_name string, table_name string, kind string, columns string, detail string, severity string")


def check(tables: dict[str, DataFrame], constraints: list[Constraint]) -> DataFrame:
    """(constraint_name, table_name, kind, severity, n, outcome) of every constraint of the tables that there are."""
    spark = next(iter(tables.values())).sparkSession
    listed = inventory(spark, [c for c in constraints if c.table in tables and (c.kind != "reference" or c.detail[0].split(".")[0] in tables)])
    found = listed.join(offences(tables, constraints), "constraint_name")
    return found.select("constraint_name", "table_name", "kind", "severity", "n", F.when(F.col("n") > 0, F.col("severity")).otherwise("PASS").alias("outcome"))


def violations(constraints: list[Constraint], table: str = "observation", skip: tuple[str, ...] = ()) -> Column:
    """What a row itself breaks, as texts: `column is null`, `column=member`, or the condition."""
    own = [c for c in constraints if c.table == table and c.at_load and not set(c.columns) & set(skip)]
    said = {
        "not_null": lambda c: F.lit(f"{c.columns[0]} is null"),
        "enum": lambda c: F.concat(F.lit(f"{c.columns[0]}="), F.col(c.columns[0]).cast("string")),
        "check": lambda c: F.lit(f"not ({c.detail[0]})"),
    }
    return F.array_compact(F.array(*[F.when(_broken(c), said[c.kind](c)) for c in own if c.kind in said]))


def unknown_members(rows: DataFrame, tables: dict[str, DataFrame], constraints: list[Constraint], table: str = "observation") -> DataFrame:
    """The rows with `unknown`: the references `column->member` whose member the referenced table lacks.

    Only the distinct members in use meet the tables; what is missing goes back to the rows as a map if it is small, and by
    a join a reference otherwise.
    """
    references = [c for c in constraints if c.table == table and c.kind == "reference" and c.detail[0].split(".")[0] in tables and c.columns[0] in rows.columns]
    if not references:
        return rows.withColumn("unknown", F.array().cast("array<string>"))
    missing = _used(rows, references).join(_known(references, tables), ["constraint_name", "member"], "left_anti").select("constraint_name", "member")
    out = rows.withColumn("unknown", F.array().cast("array<string>"))
    for c in references:
        column = c.columns[0]
        gone = missing.where(F.col("constraint_name") == c.name).select(F.col("member").alias("__member"))
        out = out.join(small_or_plain(gone), F.col(column).cast("string") == F.col("__member"), "left")
        out = out.withColumn("unknown", F.when(F.col("__member").isNotNull(), F.array_append("unknown", F.concat(F.lit(f"{column}->"), F.col("__member")))).otherwise(F.col("unknown"))).drop("__member")
    return out
