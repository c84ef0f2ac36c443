"""One pass of ingestion: a batch of extracted rows goes into the stored star, and what it touches is settled again.

The store is a folder of Parquet tables. `observation` grows by the rows that each run appends, in folders by run, indicator
and period; a run that failed and is run again under its number overwrites its own folders only. `settled` and
`reconciliation` lie in folders by indicator and period, `catalog` in folders by indicator. A cell, a printed table's sum and
a line of the log never reach over a period, so a run's rows spread to the cells and tables of their own folders, and over
a table that several indicators share to those indicators' folders: these alone are read, settled and replaced, and of
the catalog the touched indicators' folders. `runs` holds a line a run, which gives the next ids. `quarantine` holds, by
run, the rows that break a declared constraint or refer to unknown members, and the values that contradict stored ones.
Loading a batch twice appends nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import keys
from ..sources.shared import remove
from ..sources.shared import settled as kept
from . import catalog, constraints, settle, upsert

#: The declared columns of an observation: the report type and load order of its source stand with it.
_COLUMNS = """observation_id bigint, indicator_id string, value double, value_raw string, unit_id string, calorific_basis string, basis_confidence string,
is_total boolean, aggregation_role string, period_type string, period_start date, period_end date, ytd_cutoff_month int, ref_year int, data_status string,
source_id string, source_page string, source_ref string, source_type string, template_version string, extraction_method string, extraction_confidence string, source_cell string,
flow_id string, product_id string, sector_id string, region_id string, field_id string, level_id string, producer_id string, technology string, regime string, scope string, geography_scope string,
redevance_toggle_id string, redevance_included boolean, is_derived boolean, derivation_note string, series_key string, upsert_key string, is_escalated boolean, escalation_ref string,
footnotes array<string>, report_type string, load_key bigint"""
_KINDS = {"bigint": LongType(), "int": IntegerType(), "double": DoubleType(), "string": StringType(), "boolean": BooleanType(), "date": DateType(), "array<string>": ArrayType(StringType())}
OBSERVATION = StructType([StructField(name, _KINDS[kind]) for name, kind in map(str.split, _COLUMNS.split(","))])
# What a row has that doesn't say, beside the defaults of an upsert.
ROW_DEFAULTS = {"is_total": False, "is_derived": False, "is_escalated": False, "aggregation_role": "leaf", "source_type": "table"}
#: What a row breaks by itself is looked at before it has an id; bases of other fields than energy stand beside the declared ones.
DECLARED = constraints.declared(tuple(f.name for f in OBSERVATION), {"calorific_basis": ("PCI", "PCS", "NA", "GROSS", "NET")})
#: Folders up to which they are named one by one when they are read; beyond, all are settled again.
FOLDERS = 5000


def conform(batch: DataFrame) -> DataFrame:
    """The batch with exactly the declared columns: defaults, keys and types; unknown columns are dropped."""
    have = set(batch.columns)
    rows = batch.withColumns({f.name: F.lit(None).cast(f.dataType) for f in OBSERVATION if f.name not in have})
    rows = upsert.escalate(upsert.with_defaults(rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in ROW_DEFAULTS.items()})))
    rows = rows.withColumn("series_key", keys.series_key())
    rows = rows.withColumn("upsert_key", keys.upsert_key(F.col("series_key"), F.col("period_start"), F.col("period_end"), F.col("source_id")))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in OBSERVATION])


def folder(start: Column, end: Column) -> Column:
    """The name of the folder that a period's rows lie in."""
    return F.concat_ws("_", keys.iso(start), keys.iso(end))


def reset(spark: SparkSession, root: str) -> None:
    """Empty tables of the declared schema, from which a rebuild starts."""
    for name in ("observation", "settled", "reconciliation", "catalog", "quarantine", "runs", "dimension"):
        remove(spark, f"{root}/{name}")
    spark.createDataFrame([], OBSERVATION).drop("indicator_id").write.parquet(f"{root}/observation/run=0/indicator_id=none/period=none")
    spark.createDataFrame([(0, 0, 0)], "run int, last_id long, appended long").write.parquet(f"{root}/runs/number=0")


def _placed(spark: SparkSession, root: str) -> DataFrame:
    fields = [*OBSERVATION.fields, StructField("run", IntegerType()), StructField("period", StringType())]
    return spark.read.schema(StructType(fields)).parquet(f"{root}/observation")


def _among(folders: list[tuple[str, str]]) -> Column:
    """Whether a row lies in one of the folders; periods are taken together by indicator, so that the scan is pruned."""
    by: dict[str, list[str]] = {}
    for indicator, period in folders:
        by.setdefault(indicator, []).append(period)
    out = F.lit(False)
    for indicator, periods in by.items():
        out = out | ((F.col("indicator_id") == indicator) & F.col("period").isin(*periods))
    return out


def observations(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """All stored observations, or those of the runs before one."""
    rows = _placed(spark, root)
    return (rows if before is None else rows.where(F.col("run") < before)).select(*OBSERVATION.names)


def _folders(rows: DataFrame) -> list[tuple[str, str]]:
    """The distinct folders of some rows: as many as there are indicators and periods."""
    return [(r[0], r[1]) for r in rows.select("indicator_id", "period").distinct().collect()]


def with_dimensions(spark: SparkSession, root: str, dimensions: dict[str, DataFrame]) -> None:
    """Store the members of dimension tables (id, and parent where there is one)."""
    for name, rows in dimensions.items():
        parent = F.col("parent").cast("string") if "parent" in rows.columns else F.lit(None).cast("string")
        rows.select(F.col("id").cast("string").alias("id"), parent.alias("parent")).write.mode("overwrite").parquet(f"{root}/dimension/table={name}")


def dimensions(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The stored dimension tables by name; none if nothing was stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/dimension")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return {}
    rows = spark.read.parquet(f"{root}/dimension")
    return {r[0]: rows.where(F.col("table") == r[0]).drop("table") for r in rows.select("table").distinct().collect()}


def ingest(
    spark: SparkSession, batch: DataFrame, root: str, run: int, order: list[str] = ("load_key", "upsert_key"), amount: str = "value",
    declared: list[constraints.Constraint] | None = None, totals: dict[str, str] = settle.GRAND_TOTALS, whole: tuple[str, ...] = tuple(settle.GRAND_TOTALS),
) -> dict[str, int]:
    """Load one batch as run number `run` (from 1) and settle what it touches; how many rows were appended and set aside,
    and how many folders of all were replaced.

    Loading is one join by upsert key with the folders that the batch has keys in, settling one shuffle by cell.
    """
    declared = DECLARED if declared is None else declared
    rows = conform(batch).withColumn("violations", constraints.violations(declared, skip=("observation_id",)))
    known = dimensions(spark, root)
    rows = constraints.unknown_members(kept(rows), known, declared) if known else rows.withColumn("unknown", F.array().cast("array<string>"))
    marked = kept(rows.withColumn("violations", F.concat("violations", "unknown")).drop("unknown").withColumn("period", folder(F.col("period_start"), F.col("period_end"))))
    good = marked.where(F.size("violations") == 0).drop("violations")
    goes_to, before = _folders(good), _folders(_placed(spark, root).where(F.col("run") == run))
    stored = _placed(spark, root).where(F.col("run") < run)
    stored = stored.where(_among(goes_to)) if len(goes_to) <= FOLDERS else stored
    fresh, collisions = upsert.upsert(stored, good, list(order))
    above = spark.read.parquet(f"{root}/runs").where(F.col("run") < run).agg(F.max("last_id")).first()[0]
    fresh = kept(upsert.with_ids(fresh.drop("observation_id"), above, list(order)).select(*OBSERVATION.names, "period"))
    aside = marked.where(F.size("violations") > 0).select("upsert_key", "source_id", "value", "source_cell", F.lit("CONSTRAINT").alias("dimension"), F.array_join("violations", "; ").alias("context"))
    aside = kept(aside.unionByName(collisions.select("upsert_key", F.lit(None).cast("string").alias("source_id"), "value", "source_cell", "dimension", "context")))
    aside.write.mode("overwrite").parquet(f"{root}/quarantine/run={run}")  # before the store grows, which would hide first values
    fresh.hint("rebalance", "indicator_id", "period").write.mode("overwrite").partitionBy("indicator_id", "period").parquet(f"{root}/observation/run={run}")
    n, last = fresh.agg(F.count("*"), F.max("observation_id")).first()
    spark.createDataFrame([(run, last or above, n)], "run int, last_id long, appended long").write.mode("overwrite").parquet(f"{root}/runs/number={run}")
    new = _folders(fresh)
    first = not _has(spark, f"{root}/settled")
    spread = None if first else touched(spark, root, fresh, new + before)
    if spread is None or len(spread) > FOLDERS or not set(before) <= set(new):  # the store is new, or an earlier attempt had more
        replaced = derive(spark, root, amount, totals, whole)
    else:
        replaced = derive(spark, root, amount, totals, whole, spread)
    return {"appended": n, "set_aside": aside.count(), "replaced": replaced}


def _has(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def touched(spark: SparkSession, root: str, fresh: DataFrame, folders: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The folders to settle again: those given, and where other indicators stand in the same printed tables as new rows.

    Only the folders of the new rows' periods are looked at, and of them the columns that name a table.
    """
    if not folders:
        return []
    tables = fresh.select(*settle.TABLE).distinct()
    near = _placed(spark, root).where(F.col("period").isin(*sorted({p for _, p in folders}))).select("indicator_id", "period", *settle.TABLE)
    shared = near.join(tables, [near[c].eqNullSafe(tables[c]) for c in settle.TABLE], "left_semi")
    return sorted({*folders, *_folders(shared)})


def derive(spark: SparkSession, root: str, amount: str = "value", totals: dict[str, str] = settle.GRAND_TOTALS, whole: tuple[str, ...] = tuple(settle.GRAND_TOTALS), folders: list[tuple[str, str]] | None = None) -> int:
    """Settle, downgrade and log the observations of some folders, or of all, and catalog their indicators; how many
    folders of the settled table were replaced."""
    if folders is not None and not folders:
        return 0
    mode = "static" if folders is None else "dynamic"

    def put(rows: DataFrame, name: str, *by: str) -> None:
        rows.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*by).parquet(f"{root}/{name}")

    rows = _placed(spark, root)
    rows = (rows if folders is None else rows.where(_among(folders))).select(*OBSERVATION.names)
    done = settle.distrust(kept(settle.precedence(rows)), totals, whole, amount).withColumn("period", folder(F.col("period_start"), F.col("period_end")))
    put(done, "settled", "indicator_id", "period")
    fields = StructType([*[f for f in done.schema.fields if f.name not in ("indicator_id", "period")], StructField("indicator_id", StringType()), StructField("period", StringType())])
    read = spark.read.schema(fields).parquet(f"{root}/settled")  # there may be no row
    again = read if folders is None else read.where(_among(folders))
    log = settle.reconciliation_log(again)
    put(log.withColumns({"indicator_id": F.substring_index("series_key", "|", 1), "period": folder(F.col("period_start"), F.col("period_end"))}), "reconciliation", "indicator_id", "period")
    indicators = None if folders is None else sorted({i for i, _ in folders})
    own = read if indicators is None else read.where(F.col("indicator_id").isin(*indicators))
    put(catalog.catalog(own), "catalog", "indicator_id")
    return len(_folders(again))


def settled_rows(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/settled")


def sizes(spark: SparkSession, root: str) -> dict[str, int]:
    """How many rows each table of the store has."""
    fields = "indicator_id string, period string, is_preferred boolean, extraction_confidence string, is_escalated boolean"
    own = spark.read.schema(fields).parquet(f"{root}/settled")
    out = own.agg(F.count("*").alias("observation"), F.count_if("is_preferred").alias("preferred"), F.count_if(F.col("extraction_confidence") == "low").alias("low_confidence"), F.count_if("is_escalated").alias("escalated")).first().asDict()
    aside = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/quarantine").count()
    rows = lambda name: spark.read.schema("series_key string, indicator_id string").parquet(f"{root}/{name}").count()
    return out | {"reconciliation": rows("reconciliation"), "series": rows("catalog"), "quarantine": aside}


def check(spark: SparkSession, root: str, declared: list[constraints.Constraint] | None = None) -> DataFrame:
    """Every declared constraint over the stored tables: (constraint_name, table_name, kind, severity, n, outcome)."""
    return constraints.check({"observation": observations(spark, root), **dimensions(spark, root)}, DECLARED if declared is None else declared)
