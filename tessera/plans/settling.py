"""Settling: precedence, reconciliation, sums, upserts, catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalog as cat
from ..operators import constraints, ingest, settle, upsert
from ..sources.shared import remove, settled, shared_dir
from .observations import duck_sql, run_sql, view
from .registry import query, sql_query

KEYS = "series_key, period_start, period_end"


@query(duck_sql(f"select {KEYS}, observation_id, source_id, value, calorific_basis, aggregation_role, data_status, period_type from v_series_clean"))
def w1_precedence(spark, sf_dir):
    return settle.clean(settle.series(settle.precedence(view(spark, sf_dir, "obs")))).select(*settle.CELL, "observation_id", "source_id", "value", "calorific_basis", "aggregation_role", "data_status", "period_type")


@query(duck_sql("select observation_id, is_preferred, supersedes_id from settled"))
def w2_supersedes(spark, sf_dir):
    return settle.precedence(view(spark, sf_dir, "obs")).select("observation_id", "is_preferred", "supersedes_id")


@query(duck_sql(f"select {KEYS}, observation_id, indicator_id, value from settled where is_preferred and not is_total"))
def v_series_detail(spark, sf_dir):
    return settle.detail(settle.precedence(view(spark, sf_dir, "obs"))).select(*settle.CELL, "observation_id", "indicator_id", "value")


@query(duck_sql(f"""select {KEYS}, ref_year, period_type, calorific_basis, count(distinct source_id) as n_sources, max(value) as high, min(value) as low,
  case when max(value) - min(value) > greatest(5.0, 0.02 * abs(max(value))) then 'precedence:' || max(case when is_preferred then source_id end) else 'agree' end as resolution,
  case when max(value) - min(value) > greatest(5.0, 0.02 * abs(max(value))) then 'disagreement>tol' else 'within tolerance' end as note
from settled where value is not null group by {KEYS}, ref_year, period_type, calorific_basis having count(distinct source_id) > 1"""))
def m9_reconciliation(spark, sf_dir):
    return settle.reconciliation_log(settle.precedence(view(spark, sf_dir, "obs"))).drop("values_json")


_GROUP = ["source_id", "period_start", "period_end", "calorific_basis"]
_SHAKEN = "select o.*, case when observation_id % 97 = 0 then amount * 3 else amount end as shaken from {} o"


@query(duck_sql(f"""with s as ({_SHAKEN.format("obs")})
select source_id, period_start, period_end, calorific_basis,
  cast(sum(case when aggregation_role = 'leaf' then shaken end) as double) as leaves, cast(max(case when aggregation_role = 'grand_total' then shaken end) as double) as total,
  count(*) filter (where aggregation_role = 'leaf') as n_leaf, count(*) filter (where aggregation_role = 'grand_total') as n_grand
from s group by all"""))
def a11_rollup_completeness(spark, sf_dir):
    sums = settle.leaf_sums(run_sql(spark, sf_dir, _SHAKEN.format("obs")), _GROUP, "shaken")
    return sums.select(*_GROUP, F.col("leaves").cast("double").alias("leaves"), F.col("total").cast("double").alias("total"), "n_leaf", "n_grand")


#: Printed tables of the fixture, an edition and a basis each, of which some pin their grand total and some can't do without one.
PINNED = {ref: "product_id is null and region_id is null" for ref in ("T1/GROSS", "T1/NET", "T2/GROSS", "T3/GROSS", "T3/NET")}
WHOLE = ("T1/GROSS", "T3/GROSS", "T3/NET", "T4/NET")
#: Rows by table, with leaves that are too large and years without a grand total.
_TABLES = "select o.*, source_ref || '/' || calorific_basis as table_ref, case when observation_id % 97 = 0 and not is_total then amount * 3 else amount end as shaken from {} o where not (aggregation_role = 'grand_total' and ref_year % 3 = 0 and prio in (3, 4, 5))"
_GROUPED = "source_id, table_ref, period_start, period_end"


def _low_sql(rows: str) -> str:
    """CTEs `off` and `partial` over a relation: the tables whose leaves miss a pinned total, and those without a grand total."""
    return f"""leafs as (select {_GROUPED}, sum(shaken) as leaves from {rows} where not is_total and shaken is not null group by all
), off as (
  select {_GROUPED} from {rows} left join leafs using ({_GROUPED}) where is_total and shaken <> 0 and product_id is null and region_id is null and table_ref in {tuple(PINNED)}
    and abs(coalesce(leaves, 0) - shaken) > greatest(8.0, 0.05 * abs(shaken))
), partial as (
  select {_GROUPED} from {rows} where is_preferred and table_ref in {WHOLE} group by all having count(*) filter (where aggregation_role = 'grand_total') = 0
), bad as (select * from off union select * from partial)"""


@query(duck_sql(f"""with s as ({_TABLES.format("settled")}), {_low_sql("s")}
select s.observation_id, case when b.source_id is not null then 'low' else s.extraction_confidence end as extraction_confidence from s left join bad b using ({_GROUPED})"""))
def m6_downgrade(spark, sf_dir):
    """Tables whose leaves miss a pinned total, or that have no grand total though they should; other tables stay as they are."""
    rows = run_sql(spark, sf_dir, _TABLES.format("settled")).withColumn("source_ref", F.col("table_ref"))
    return settle.distrust(rows, PINNED, WHOLE, "shaken").select("observation_id", "extraction_confidence")


#: All orders as two batches, two neighbours a key: the stored ones, and a replay with new keys, equal repeats, and values that differ.
_STORED = "select 'k' || cast(o_orderkey - o_orderkey % 2 as {t}) as upsert_key, o_totalprice as value, 'c' || cast(o_custkey % 50 as {t}) as source_cell, o_orderkey from orders where o_orderkey % 6 = 2"
_BATCH = "select 'k' || cast(o_orderkey - o_orderkey % 2 as {t}) as upsert_key, case when o_orderkey % 5 = 0 then o_totalprice + 1 else o_totalprice end as value, 'c' || cast((o_custkey + case when o_orderkey % 2 = 0 then 1 else 0 end) % 50 as {t}) as source_cell, o_orderkey from orders"
_FIRSTS = f"""with stored as ({_STORED.format(t="varchar")}), batch as ({_BATCH.format(t="varchar")}),
firsts as (select * from (select *, row_number() over (partition by upsert_key order by o_orderkey, value, source_cell) as nth from batch) where nth = 1),
fresh as (select * exclude (nth) from firsts where upsert_key not in (select upsert_key from stored)),
known as (select upsert_key, value as kept_value, source_cell as kept_cell from stored union all select upsert_key, value, source_cell from fresh)"""
_ORDER = ["o_orderkey", "value", "source_cell"]


def _upserted(spark, sf_dir):
    return upsert.upsert(run_sql(spark, sf_dir, _STORED.format(t="string")), run_sql(spark, sf_dir, _BATCH.format(t="string")), _ORDER)


@query(_FIRSTS + " select * from fresh")
def m1_upsert(spark, sf_dir):
    return _upserted(spark, sf_dir)[0]


@query(_FIRSTS + " select b.upsert_key, b.value, b.source_cell, k.kept_value, k.kept_cell, 'SERIES_KEY_COLLISION' as dimension from batch b join known k using (upsert_key) where abs(b.value - k.kept_value) > 0.01 and b.source_cell <> k.kept_cell")
def m1_collisions(spark, sf_dir):
    return _upserted(spark, sf_dir)[1].drop("context")


@query(_FIRSTS + " select count(*) as appended_again from fresh where upsert_key not in (select upsert_key from known)")
def m1_idempotent(spark, sf_dir):
    fresh, _ = _upserted(spark, sf_dir)
    stored = run_sql(spark, sf_dir, _STORED.format(t="string")).unionByName(fresh)
    return upsert.upsert(stored, run_sql(spark, sf_dir, _BATCH.format(t="string")), _ORDER)[0].agg(F.count("*").alias("appended_again"))


@query("select o_orderkey, o_custkey, o_totalprice, 1000 + row_number() over (order by o_orderkey, o_custkey, o_totalprice) as observation_id from orders")
def m4_ids(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    return upsert.with_ids(rows, 1000, ["o_orderkey", "o_custkey", "o_totalprice"])


_FIELD = "select p_partkey, case when p_size % 10 = 1 then 'barka' when p_size % 10 = 2 then 'field.maamoura_baraka' else p_brand end as field_id, p_size % 20 = 1 as is_escalated"


@query(f"""with p as ({_FIELD} from part)
select p_partkey, field_id, is_escalated or field_id in ('barka', 'field.maamoura_baraka') as is_escalated,
  case when field_id in ('barka', 'field.maamoura_baraka') and not is_escalated then 'OQ-F2' end as escalation_ref,
  case when field_id in ('barka', 'field.maamoura_baraka') and not is_escalated then 'FN-FIELD-NAME' else '' end as notes,
  'NA' as calorific_basis, 'normal' as extraction_confidence from p""")
def m2_m3_escalate_defaults(spark, sf_dir):
    rows = run_sql(spark, sf_dir, _FIELD + ", cast(null as string) as escalation_ref, cast(null as array<string>) as footnotes, cast(null as string) as calorific_basis from part")
    out = upsert.with_defaults(upsert.escalate(rows))
    return out.select("p_partkey", "field_id", "is_escalated", "escalation_ref", F.array_join("footnotes", "|").alias("notes"), "calorific_basis", "extraction_confidence")


@query("""with stored as (select distinct c_mktsegment || '/' || cast(c_nationkey as varchar) as key from customer where c_nationkey % 4 = 0), batch as (select c_mktsegment || '/' || cast(c_nationkey as varchar) as key, c_custkey from customer)
select key, min(c_custkey) as c_custkey from batch where key not in (select key from stored) group by key""")
def m7_insert_or_ignore(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat_ws("/", "c_mktsegment", "c_nationkey").alias("key"), "c_custkey", "c_nationkey")
    return upsert.insert_or_ignore(rows.where("c_nationkey % 4 = 0").select("key").distinct(), rows.select("key", "c_custkey"), "key", ["c_custkey"])

_CATALOG = """select series_key, indicator_id, unit_id, calorific_basis, period_type, max(aggregation_role) as aggregation_role, bool_or(is_total) as is_total, count(*) as n_obs,
  min(ref_year) as first_year, max(ref_year) as last_year, count(distinct source_id) as n_sources, string_agg(distinct report_type, '/' order by report_type) as families,
  min(extraction_confidence) as confidence, bool_or(is_escalated) as escalated,
  indicator_id || ' — [' || concat_ws(', ', 'flow=' || split_part(flow_id, '.', 2), case when product_id is not null then 'product=' || split_part(product_id, '.', 2) end,
    case when region_id is not null then 'region=' || region_id end, case when scope is not null then 'scope=' || scope end, 'geo=' || geography_scope) || '] basis ' || calorific_basis || ' (' || unit_id || ') ' || period_type as display_name
from settled group by all"""


#: The catalog with its definition and dimensions, for the search and the published form.
CATALOG_SQL = _CATALOG.replace("from settled group by all", ", flow_id, product_id, region_id, scope, geography_scope from settled group by series_key, indicator_id, unit_id, calorific_basis, period_type, flow_id, product_id, region_id, scope, geography_scope")
DEFINED_SQL = f"select *, indicator_id || '. ' || display_name || '. Source families: ' || families || '; period_type=' || period_type || '; years ' || first_year || '–' || last_year || '. Aggregation role: ' || aggregation_role || '.' as definition from ({CATALOG_SQL})"


@query(duck_sql(f"""select series_key as series_id, display_name, aggregation_role, definition, unit_id as unit, calorific_basis, case calorific_basis when 'NET' then 'inferred' else 'stated' end as basis_confidence, period_type, flow_id as flow, product_id as product,
  cast(null as varchar) as sector, region_id as region, cast(null as varchar) as field, cast(null as varchar) as level, cast(null as varchar) as producer, cast(null as varchar) as technology, scope, geography_scope, cast(null as varchar) as redevance_toggle,
  is_total, n_obs, first_year, last_year, n_sources, families, replace(families, '/', '-v1/') || '-v1' as templates, confidence, escalated from ({DEFINED_SQL})"""))
def m10_catalog(spark, sf_dir):
    obs = settle.precedence(view(spark, sf_dir, "obs"))
    obs = obs.withColumns({"basis_confidence": F.when(F.col("calorific_basis") == "NET", "inferred").otherwise("stated"), "template_version": F.concat("report_type", F.lit("-v1"))})
    return cat.published(cat.catalog(obs))


_LOADED = "observation_id % 419 <> 0"
_RANKS = "case report_type when 'bilan' then 3 when 'memento' then 2 when 'rapport' then 2 when 'conjoncture' then 1 else 0 end desc, case data_status when 'final' then 3 when 'revised' then 2 when 'provisional' then 1 else 0 end desc, observation_id"
#: What a store holds after all rows that keep the constraints are loaded: winners of cells, and confidence by tables.
_STORE = f"""taken as (select * from ({_TABLES.format("obs")}) where {_LOADED}
), placed as (
  select *, row_number() over (partition by {KEYS} order by {_RANKS}) = 1 as is_preferred, first_value(upsert_key) over (partition by {KEYS} order by {_RANKS}) as winner from taken
), {_low_sql("placed")}, store as (
  select p.*, case when b.source_id is not null then 'low' else extraction_confidence end as confidence from placed p left join bad b using ({_GROUPED})
), stored_cells as (select {KEYS}, count(distinct source_id) as n_sources from taken where value is not null group by {KEYS})"""


def _batch(spark, sf_dir):
    """All observations as a batch, some without their unit; a table is an edition and a basis."""
    rows = run_sql(spark, sf_dir, _TABLES.format("obs"))
    return rows.withColumns({"unit_id": F.when(F.expr(_LOADED), F.col("unit_id")), "source_ref": F.col("table_ref"), "value": F.col("shaken").cast("double"), "source_cell": F.concat_ws("|", "table_ref", "observation_id"), "load_key": F.col("observation_id")})


def _store(spark) -> str:
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    ingest.reset(spark, root)
    return root


@query(duck_sql(f"""with {_STORE} select 'observation' as table_name, (select count(*) from store) as n union all select 'preferred', (select count(*) from store where is_preferred)
union all select 'low_confidence', (select count(*) from store where confidence = 'low') union all select 'reconciliation', (select count(*) from stored_cells where n_sources > 1)
union all select 'series', (select count(distinct series_key) from store) union all select 'quarantine', (select count(*) from ({_TABLES.format("obs")})) - (select count(*) from store) union all select 'appended_again', 0"""))
def b1_ingest_run(spark, sf_dir):
    """A batch with rows that break a constraint, loaded into an empty store and then once more."""
    root, batch = _store(spark), _batch(spark, sf_dir)
    ingest.ingest(spark, batch, root, 1, totals=PINNED, whole=WHOLE)
    sizes = ingest.sizes(spark, root)
    again = ingest.ingest(spark, batch, root, 2, totals=PINNED, whole=WHOLE)
    rows = [(k, sizes[k]) for k in ("observation", "preferred", "low_confidence", "reconciliation", "series", "quarantine")] + [("appended_again", again["appended"])]
    remove(spark, root)
    return spark.createDataFrame(rows, "table_name string, n long")


@query(duck_sql(f"with {_STORE} select upsert_key, is_preferred, case when not is_preferred then winner end as superseded_by, confidence from store"))
def b2_incremental_settling(spark, sf_dir):
    """An edition of one year comes after all others: only what it touches is settled again, and the store is as if all had come at once."""
    root, batch = _store(spark), _batch(spark, sf_dir)
    late = "ref_year = 1998 and source_id = 'ed_3'"
    ingest.ingest(spark, batch.where(f"not ({late})"), root, 1, totals=PINNED, whole=WHOLE)
    ingest.ingest(spark, batch.where(late), root, 2, totals=PINNED, whole=WHOLE)
    rows = ingest.settled_rows(spark, root)
    winners = rows.select(F.col("observation_id").alias("supersedes_id"), F.col("upsert_key").alias("superseded_by"))
    out = settled(rows.join(winners, "supersedes_id", "left").select("upsert_key", "is_preferred", "superseded_by", F.col("extraction_confidence").alias("confidence")))
    remove(spark, root)
    return out


@query(duck_sql(f"""with named as (
  select 'observation.unit_id.not_null' as constraint_name, count(*) as set_aside from obs where not {_LOADED}
  union all select 'observation.product_id.reference', count(*) from obs where product_id = 'prod.small' union all select 'observation.region_id.reference', count(*) from obs where region_id = 'asia'
  union all select 'observation.data_status.enum', count(*) from obs where observation_id % 37 = 0 union all select 'observation.period.check[period_start <= period_end]', count(*) from obs where observation_id % 41 = 0
) select constraint_name, set_aside, 0::bigint as left_in_store from named"""))
def b3_store_constraints(spark, sf_dir):
    """The declared constraints, foreign keys among them, at load and over the stored tables: what was set aside by each."""
    root = _store(spark)
    obs = view(spark, sf_dir, "obs")
    batch = obs.withColumns({
        "unit_id": F.when(F.expr(_LOADED), F.col("unit_id")), "data_status": F.when(F.expr("observation_id % 37 = 0"), "guessed").otherwise(F.col("data_status")),
        "period_end": F.when(F.expr("observation_id % 41 = 0"), F.date_sub("period_start", 1)).otherwise(F.col("period_end")), "source_cell": F.col("source_ref"), "load_key": F.col("observation_id"),
    })
    members = {t: obs.select(F.col(c).alias("id")).where("id is not null and id not in ('prod.small', 'asia')").distinct() for c, t in constraints.REFERENCES.items() if c in ("indicator_id", "source_id", "flow_id", "product_id", "region_id")}
    ingest.with_dimensions(spark, root, members | {"unit": spark.createDataFrame([("cur",)], "id string")})
    ingest.ingest(spark, batch, root, 1)
    context = spark.read.parquet(f"{root}/quarantine").select(F.explode(F.split("context", "; ")).alias("x"))
    said = {"observation.unit_id.not_null": "unit_id is null", "observation.product_id.reference": "product_id->prod.small", "observation.region_id.reference": "region_id->asia", "observation.data_status.enum": "data_status=guessed", "observation.period.check[period_start <= period_end]": "not (period_start <= period_end)"}
    names = spark.createDataFrame(list(said.items()), "constraint_name string, x string")
    aside = names.join(context.where("x not like '%->%' or x in ('product_id->prod.small', 'region_id->asia')"), "x", "left").groupBy("constraint_name").agg(F.count("x").alias("set_aside"))
    found = ingest.check(spark, root).select("constraint_name", F.col("n").alias("left_in_store"))
    out = settled(aside.join(found, "constraint_name"))
    remove(spark, root)
    return out


@query(duck_sql(f"select * exclude (flow_id, product_id, region_id, scope, geography_scope) from ({_CATALOG.replace('from settled group by all', ', flow_id, product_id, region_id, scope, geography_scope from settled group by series_key, indicator_id, unit_id, calorific_basis, period_type, flow_id, product_id, region_id, scope, geography_scope')})"))
def a1_catalog(spark, sf_dir):
    out = cat.catalog(settle.precedence(view(spark, sf_dir, "obs")))
    return out.select("series_key", "indicator_id", "unit_id", "calorific_basis", "period_type", "aggregation_role", "is_total", "n_obs", "first_year", "last_year", "n_sources", "families", "confidence", "escalated", "display_name")
