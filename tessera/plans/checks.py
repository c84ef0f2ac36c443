"""Data-quality rules over the model with planted defects, so that rules have something to find."""

from __future__ import annotations

from functools import reduce

from ..operators import constraints
from ..operators import quality as q
from ..sources.shared import settled
from .observations import duck_sql, register, run_sql, view
from .registry import query, sql_query

#: The settled observations with defects by row number: repeated ids and keys, wrong enums, nulls, swapped periods.
BAD = """bad as (
  select case when observation_id % 401 = 0 then 1 when observation_id % 409 = 0 then null else observation_id end as observation_id, case when observation_id % 431 = 0 then 'gone' else indicator_id end as indicator_id,
    case when observation_id % 3 = 0 then 'flow.export' when observation_id % 3 = 1 then 'flow.local' when observation_id % 433 = 0 then 'flow.gone' else flow_id end as flow_id, product_id, region_id,
    case when observation_id % 269 = 0 then 'sec.x' else sector_id end as sector_id, case when observation_id % 271 = 0 then 'field.gone' else field_id end as field_id, case when observation_id % 277 = 0 then 'lvl.hp' else level_id end as level_id,
    case when observation_id % 281 = 0 then 'prod.gone' else producer_id end as producer_id, case when observation_id % 293 = 0 then 'gone' when redevance_included then 'incl' else 'excl' end as redevance_toggle_id,
    case when observation_id % 419 = 0 then null else unit_id end as unit_id, case when observation_id % 199 < 60 then 'ed_9' else source_id end as source_id, source_ref, report_type,
    case when observation_id % 211 = 0 then 'ytd_cumulative' when observation_id % 223 = 0 then 'weekly' else period_type end as period_type,
    case when observation_id % 227 = 0 then period_end else period_start end as period_start, case when observation_id % 227 = 0 then period_start else period_end end as period_end,
    case when observation_id % 229 = 0 then 'NCV' else calorific_basis end as calorific_basis, ytd_cutoff_month, data_status,
    case when observation_id % 233 = 0 then 'branch' else aggregation_role end as aggregation_role, case when observation_id % 239 = 0 then null else is_total end as is_total, is_derived, case when observation_id % 263 = 0 then not is_preferred else is_preferred end as is_preferred, is_escalated,
    extraction_confidence, ref_year, case when observation_id % 241 = 0 then null when observation_id % 251 = 0 then value * 0.9 else value end as value, case when observation_id % 482 = 0 then ' ' else 'raw' end as value_raw, amount,
    case when observation_id % 251 = 0 then series_key || '|' else series_key end as series_key, case when observation_id % 257 = 0 then 'twice' else upsert_key end as upsert_key,
    scope, geography_scope, redevance_included, supersedes_id
  from settled
)"""


#: What a rule's finding means; and every rule: its texts over the planted table, by name.
SEVERITY = {"c4_multi_source": "INFO", "c5_december": "INFO", "c8_editions": "INFO", "qa_2_3_dead_members": "ADVISE", "qa_6_2_null_values": "ADVISE", "qa_10_1_redevance": "ADVISE", "qa_10_2_templates": "ADVISE"}
RULES: dict[str, tuple[str, str]] = {}


def severity(name: str) -> str:
    return SEVERITY.get(name, "BLOCK" if name.startswith("qa_") else "FAIL")


def planted(text: str) -> str:
    """A rule's text with the planted table in front of its own WITH."""
    low = text.lstrip().lower()
    if low.startswith("with recursive "):
        return f"with recursive {BAD}, " + text.lstrip()[15:]
    return f"with {BAD}, " + text.lstrip()[5:] if low.startswith("with ") else f"with {BAD} {text}"


def rule(name: str, sql: str, duck: str | None = None) -> None:
    """Register a rule over `bad` as a query of its own and for the report."""
    RULES[name] = (sql, duck or sql)
    sql_query(name, planted(sql), planted(duck or sql))


GAS = "('GROSS', 'NET')"
PAIR = "series_key, period_start, period_end"

# Validation checks
rule("c6_one_period_type", q.one_value(("period_type",)))
rule("c6b_one_unit_basis", q.one_value(("unit_id", "calorific_basis")))
rule("c2_twin_bands", """select a.observation_id, b.observation_id as twin_id, round(b.value / a.value, 6) as ratio from bad a join bad b on a.indicator_id = b.indicator_id and a.source_id = b.source_id and a.product_id = b.product_id
  and a.region_id is not distinct from b.region_id and coalesce(a.scope, '') = coalesce(b.scope, '') and a.period_start = b.period_start and a.period_end = b.period_end
where a.calorific_basis = 'GROSS' and b.calorific_basis = 'NET' and a.value > 5 and abs(b.value / a.value - 0.95) > case when a.value <= 15 then 0.15 when a.value < 40 then 0.06 else 0.03 end""")
rule("c2b_table_pair", "select a.observation_id, b.observation_id as other_id from bad a join bad b on a.product_id = b.product_id and a.region_id = b.region_id and a.ref_year = b.ref_year and a.calorific_basis = b.calorific_basis where a.source_ref = 'T3' and b.source_ref = 'T4' and b.value > 5 and abs(a.value / b.value - 1) > case when b.value <= 30 then 0.12 else 0.04 end")
rule("c1_balance", "select ref_year, source_id, cast(sum(case when region_id = 'asia' then amount when region_id = 'africa' then - amount else 0 end) as double) as net, cast(sum(case when region_id = 'europe' then amount else 0 end) as double) as printed from bad where aggregation_role = 'leaf' and source_id = 'ed_1' group by ref_year, source_id having abs(sum(case when region_id = 'asia' then amount when region_id = 'africa' then - amount else 0 end) - sum(case when region_id = 'europe' then amount else 0 end)) > greatest(5, 0.02 * abs(sum(case when region_id = 'europe' then amount else 0 end)))")
rule("c3_carriers", "select ref_year, source_id, calorific_basis, cast(sum(case when aggregation_role = 'leaf' then amount end) as double) as carriers, cast(max(case when aggregation_role = 'grand_total' then amount end) as double) as total from bad group by ref_year, source_id, calorific_basis having abs(sum(case when aggregation_role = 'leaf' then amount end) - max(case when aggregation_role = 'grand_total' then amount end)) > greatest(5, 0.02 * max(case when aggregation_role = 'grand_total' then amount end))")
rule("c10_clean_sums", "select source_id, ref_year, calorific_basis, cast(sum(case when aggregation_role = 'leaf' then amount end) as double) as leaves, cast(max(case when aggregation_role = 'grand_total' then amount end) as double) as total from bad where extraction_confidence <> 'low' group by source_id, ref_year, calorific_basis having abs(sum(case when aggregation_role = 'leaf' then amount end) - max(case when aggregation_role = 'grand_total' then amount end)) > greatest(8, 0.05 * max(case when aggregation_role = 'grand_total' then amount end))")
rule("c11_overcount", f"select {PAIR.split(',')[1]}, region_id, calorific_basis, cast(sum(case when aggregation_role = 'leaf' then amount end) as double) as leaves from bad where is_preferred group by period_start, region_id, calorific_basis having sum(case when aggregation_role = 'leaf' then amount end) > 1.15 * max(case when aggregation_role = 'subtotal' then amount end)")
rule("c12_one_grand_total", "select ref_year, calorific_basis, scope, count(*) filter (where aggregation_role = 'grand_total') as n_grand from bad where is_preferred group by ref_year, calorific_basis, scope having count(*) filter (where not is_total) > 0 and count(*) filter (where aggregation_role = 'grand_total') <> 1")
rule("c7_language", "select b.observation_id, b.source_id from bad b join (select 'ed_' || cast(r_regionkey + 1 as varchar(9)) as source_id, r_regionkey = 4 as not_canonical from region) s on b.source_id = s.source_id where s.not_canonical")
rule("c9_core_filled", f"select observation_id, series_key from bad where value is null or unit_id is null or source_id is null or period_type is null or calorific_basis not in {GAS}")
rule("c6c_ytd_annual", "select series_key from bad where period_type = 'annual' intersect select series_key from bad where period_type = 'ytd_cumulative'")
rule("c4_multi_source", f"select {PAIR}, count(distinct source_id) as n_sources, max(value) - min(value) as spread from bad where value is not null group by {PAIR} having count(distinct source_id) > 1 and max(value) - min(value) > greatest(5, 0.02 * abs(max(value)))")
rule("c5_december", "select y.ref_year, count(*) as pairs, count(*) filter (where abs(y.value - a.value) <= greatest(5.0, 0.05 * abs(a.value))) as agreeing from ytd y join obs a on y.source_id = a.source_id and y.product_id = a.product_id and y.region_id = a.region_id and y.calorific_basis = a.calorific_basis and y.ref_year = a.ref_year where y.ytd_cutoff_month = 12 group by y.ref_year")
rule("c8_editions", "select count(*) as editions from (select distinct source_id, ref_year from ytd) e")

# Structural checks
rule("qa_1_1_ids", q.unique("observation_id"))
rule("qa_1_2_upsert_keys", q.unique("upsert_key"))
rule("qa_1_3_key_definition", "select observation_id, upsert_key from bad where upsert_key is distinct from series_key || '#' || cast(period_start as varchar(10)) || '#' || cast(period_end as varchar(10)) || '#' || source_id")
rule("qa_1_4_cells", f"select {PAIR}, source_id, count(*) as n from bad group by {PAIR}, source_id having count(*) > 1")
rule("qa_1_5_pipes", "select observation_id, length(series_key) - length(replace(series_key, '|', '')) as pipes from bad where length(series_key) - length(replace(series_key, '|', '')) <> 15")
#: The dimension table of each reference of an observation; some lack members that observations use.
_DIMENSIONS = {
    "indicator_id": "select 'order_revenue' as id", "unit_id": "select 'cur' as id", "source_id": "select distinct source_id as id from settled", "flow_id": "select 'flow.sales' as id union all select 'flow.export' union all select 'flow.local'",
    "product_id": "select distinct 'prod.' || lower(p_type) as id from part where p_type <> 'SMALL'", "sector_id": "select 'sec.y' as id", "region_id": "select lower(r_name) as id from region where r_regionkey <> 2", "field_id": "select 'field.x' as id",
    "level_id": "select 'lvl.hp' as id", "producer_id": "select 'prod.steg' as id", "redevance_toggle_id": "select 'incl' as id union all select 'excl'",
}
_ORPHANS = " union all ".join(q.orphans(c, "bad", f"({ids})", "id") for c, ids in _DIMENSIONS.items())


@query(duck_sql(planted(_ORPHANS)))
def qa_2_1_fact_references(spark, sf_dir):
    """All eleven references in one pass."""
    return q.orphan_members(run_sql(spark, sf_dir, planted("select * from bad")), {c: run_sql(spark, sf_dir, ids) for c, ids in _DIMENSIONS.items()})


RULES["qa_2_1_fact_references"] = (_ORPHANS, _ORPHANS)
_SATELLITES = """with notes as (select 'FN-1' as id), links as (select observation_id, 'FN-' || cast(ref_year % 3 as varchar(3)) as footnote_id from bad where is_escalated), quarantine as (select distinct source_id from bad where extraction_confidence = 'low'),
  projects as (select n_name, case n_regionkey when 4 then 'nowhere' else lower(r_name) end as region_id from nation join region on n_regionkey = r_regionkey) """ + " union all ".join((
    q.orphans("footnote_id", "links", "notes", "id"), q.orphans("observation_id", "links", "(select observation_id as id from settled where observation_id % 3 <> 0)", "id").replace("observation_id as offender", "cast(observation_id as varchar(20)) as offender"),
    q.orphans("source_id", "quarantine", "(select distinct source_id as id from settled)", "id"), q.orphans("region_id", "projects", "(select lower(r_name) as id from region)", "id"),
    q.orphans("supersedes_id", "bad", "(select observation_id as id from settled where observation_id % 7 <> 0)", "id").replace("supersedes_id as offender", "cast(supersedes_id as varchar(20)) as offender"),
))
rule("qa_2_2_satellites", _SATELLITES)
rule("qa_2_3_dead_members", "select lower(n_name) as member from nation n where not exists (select 1 from bad b where b.region_id = lower(n.n_name))")
#: Parts in rings of one type and size, of any length, with tails into them, loops, unknown parents and chains to a root.
_TREE = """with p as (select p_partkey, p_size, row_number() over (partition by p_type, p_size % 3 order by p_partkey) as r, count(*) over (partition by p_type, p_size % 3) as n, first_value(p_partkey) over (partition by p_type, p_size % 3 order by p_partkey) as first_key,
  lead(p_partkey) over (partition by p_type, p_size % 3 order by p_partkey) as next_key from part)
select 'p' || cast(p_partkey as varchar(20)) as child, case when p_size = 7 then 'p' || cast(p_partkey as varchar(20)) when p_size = 11 then 'gone' when p_size % 3 = 0 and next_key is null then null else 'p' || cast(coalesce(next_key, first_key) as varchar(20)) end as parent from p"""
_CYCLES = f"""with recursive tree as ({_TREE}), walk as (select child as origin, parent as node from tree where parent is not null union select w.origin, e.parent from walk w join tree e on w.node = e.child where e.parent is not null),
  back as (select origin from walk where node = origin) select w.origin as offender, count(*) as length from walk w join back using (origin) group by w.origin
  union all select child, -1 from tree t where parent is not null and not exists (select 1 from tree p where p.child = t.parent)"""


@query(_CYCLES)
def qa_3_1_trees(spark, sf_dir):
    """Cycles of any length by pointer doubling, loops, and parents that are unknown."""
    return q.trees(run_sql(spark, sf_dir, _TREE))


_SAME_GROUP = "p.source_id = c.source_id and p.ref_year = c.ref_year and p.calorific_basis = c.calorific_basis and p.scope is not distinct from c.scope"
#: A child and its parent as leaves of one group would be added up twice. Products stand in a binary tree by the order of their names.
_TREES = {"qa_3_2_product_siblings": ("product_id", "ranks as (select product_id, dense_rank() over (order by product_id) as r from (select distinct product_id from settled where product_id is not null) x), edges as (select a.product_id as child, b.product_id as parent from ranks a join ranks b on b.r = floor(a.r / 2))"),
          "qa_3_3_flow_siblings": ("flow_id", "edges as (select 'flow.export' as child, 'flow.sales' as parent union all select 'flow.local', 'flow.sales')")}
for _name, (_column, _edges) in _TREES.items():
    rule(_name, f"with {_edges}, leaves as (select source_id, ref_year, calorific_basis, scope, {_column}, count(*) as n from bad where not is_total group by source_id, ref_year, calorific_basis, scope, {_column}) select c.source_id, c.ref_year, c.calorific_basis, c.{_column} as child, p.{_column} as parent, c.n * p.n as n from leaves c join edges e on c.{_column} = e.child join leaves p on p.{_column} = e.parent and {_SAME_GROUP}")
rule("qa_4_1_detail_totals", "select observation_id from bad where is_preferred and is_total and aggregation_role = 'leaf' union all select observation_id from bad where is_preferred and is_total is null")
rule("qa_4_2_detail_preferred", "with detail as (select observation_id from settled where is_preferred and not is_total) select d.observation_id from detail d join bad b on b.observation_id = d.observation_id where not b.is_preferred")
RULES["qa_5_1_domains"] = (q.outside(q.DOMAINS), q.outside(q.DOMAINS))


@query(duck_sql(planted(q.outside(q.DOMAINS))))
def qa_5_1_domains(spark, sf_dir):
    """All enum columns in one pass."""
    return q.outside_members(run_sql(spark, sf_dir, planted("select * from bad")), q.DOMAINS)


rule("qa_5_2_mixed_keys", q.one_value(("period_type", "calorific_basis", "unit_id")))
rule("qa_5_3_twin_keys", "select series_key from bad where calorific_basis = 'GROSS' intersect select series_key from bad where calorific_basis <> 'GROSS' union all (select series_key from bad where period_type = 'annual' intersect select series_key from bad where period_type <> 'annual')")
rule("qa_5_4_periods", "select sum(case when period_start > period_end then 1 else 0 end) as swapped, sum(case when period_type = 'ytd_cumulative' and ytd_cutoff_month is null then 1 else 0 end) as no_cutoff, sum(case when period_type = 'point_in_time' and period_start <> period_end then 1 else 0 end) as no_point from bad", "select sum(case when period_start > period_end then 1 else 0 end)::bigint as swapped, sum(case when period_type = 'ytd_cumulative' and ytd_cutoff_month is null then 1 else 0 end)::bigint as no_cutoff, sum(case when period_type = 'point_in_time' and period_start <> period_end then 1 else 0 end)::bigint as no_point from bad")
rule("qa_6_1_mandatory", q.null_counts(q.MANDATORY))
rule("qa_6_2_null_values", "select observation_id, value_raw from bad where value is null and trim(value_raw) = ''")
rule("qa_6_3_flags", q.null_counts(q.FLAGS))
rule("qa_8_1_quarantine", "with quarantine as (select observation_id, case when observation_id % 7 = 0 then '' else 'value=' || cast(ref_year as varchar(4)) end as context from bad where extraction_confidence = 'low') select observation_id, context from quarantine where context not like '%value=%'")
rule("qa_8_2_conflicts", f"select {PAIR}, source_id, count(distinct value) as n_values from bad group by {PAIR}, source_id having count(distinct value) > 1")
rule("qa_9_3_clean_leaks", "select count(*) filter (where extraction_confidence = 'low') as low, count(*) filter (where is_escalated) as escalated from (select * from bad where is_preferred and extraction_confidence <> 'low') v")
rule("qa_10_1_redevance", "select b.observation_id, b.redevance_included, d.included from bad b join (select 'GROSS' as basis, true as included union all select 'NET', true) d on b.calorific_basis = d.basis where b.redevance_included is distinct from d.included")
rule("qa_10_2_templates", "select b.source_id, b.report_type, d.template, count(*) as n from bad b join (select 'ed_' || cast(r_regionkey + 1 as varchar(9)) as source_id, case r_regionkey when 0 then 'bilan' else 'memento' end as template from region) d on b.source_id = d.source_id where b.report_type <> d.template group by b.source_id, b.report_type, d.template")

#: The declared constraints that the planted table has columns for, and dimension tables with defects of their own.
_DECLARED = [c for c in constraints.declared(("observation_id", "indicator_id", "unit_id", "calorific_basis", "is_total", "aggregation_role", "period_type", "period_start", "period_end", "ytd_cutoff_month", "data_status", "source_id", "extraction_confidence", "is_derived", "series_key", "upsert_key", "is_escalated", "flow_id", "product_id", "region_id", "sector_id", "field_id"), {"calorific_basis": ("GROSS", "NET")})]
_MEMBERS = {
    "flow": "select 'flow.sales' as id, cast(null as varchar(20)) as parent union all select 'flow.export', 'flow.sales' union all select 'flow.local', 'flow.nowhere'", "product": "select distinct 'prod.' || lower(p_type) as id, 'prod.' || lower(p_type) as parent from part where p_type <> 'SMALL'",
    "region": "select lower(r_name) as id, cast(null as varchar(20)) as parent from region where r_regionkey <> 2 union all select 'asia', null", "unit": "select 'cur' as id, cast(null as varchar(20)) as parent union all select null, null", "source": "select distinct source_id as id, cast(null as varchar(20)) as parent from settled",
}


def _constraint_sql(c: constraints.Constraint) -> str | None:
    """What breaks a constraint, counted by SQL of its own; None where a table is missing."""
    rows = {"observation": "bad"} | {t: f"dim_{t}" for t in _MEMBERS}
    if c.table not in rows or c.kind == "reference" and c.detail[0].split(".")[0] not in rows:
        return None
    t, col = rows[c.table], c.columns[0]
    count = {
        "not_null": f"select count(*) as n from {t} where {col} is null",
        "enum": f"select count(*) as n from {t} where {col} not in ({', '.join(repr(m) for m in c.detail)})",
        "check": f"select count(*) as n from {t} where not ({c.detail[0] if c.detail else ''})",
        "unique": f"select count(*) as n from (select {col} from {t} where {col} is not null group by {col} having count(*) > 1) x",
        "reference": f"select count(*) as n from {t} x where {col} is not null and not exists (select 1 from {rows.get(c.detail[0].split('.')[0]) if c.detail else ''} d where d.id = x.{col})",
    }[c.kind]
    name = c.name.replace("'", "''")
    return f"select '{name}' as constraint_name, '{c.kind}' as kind, n, case when n > 0 then '{c.severity}' else 'PASS' end as outcome from ({count}) q"


@query(duck_sql(f"with {BAD}, " + ", ".join(f"dim_{t} as ({sql})" for t, sql in _MEMBERS.items()) + " " + " union all ".join(filter(None, map(_constraint_sql, _DECLARED)))))
def p9_constraints(spark, sf_dir):
    """Every declared constraint over the planted table and its dimensions, from the registry."""
    tables = {"observation": run_sql(spark, sf_dir, planted("select * from bad"))} | {t: run_sql(spark, sf_dir, sql) for t, sql in _MEMBERS.items()}
    return constraints.check(tables, _DECLARED).select("constraint_name", "kind", "n", "outcome")


_VIEWS = ("obs", "ytd", "settled", "v_series", "v_series_clean")
_QUALIFIERS = ("calorific_basis", "period_type", "scope", "geography_scope", "aggregation_role", "data_status", "extraction_confidence", "is_escalated", "is_derived", "unit_id")


def _columns(spark, sf_dir):
    return {v: run_sql(spark, sf_dir, f"select * from {v}").dtypes for v in _VIEWS}


@query(duck_sql(" union all ".join(f"select '{v}' as view_name, count(*) as n from {v}" for v in _VIEWS)))
def qa_9_1_views(spark, sf_dir):
    """Every view resolves; how many rows each shows."""
    return reduce(lambda a, b: a.unionByName(b), [run_sql(spark, sf_dir, f"select '{v}' as view_name, count(*) as n from {v}") for v in _VIEWS])


@query(" union all ".join(f"select '{v}' as view_name, column_name as qualifier from (describe {duck_sql(f'select * from {v}')}) where column_name in {_QUALIFIERS}" for v in ("v_series", "v_series_clean")))
def qa_9_2_qualifiers(spark, sf_dir):
    """The qualifier columns that the two views show."""
    have = _columns(spark, sf_dir)
    shown = [(v, x) for v in ("v_series", "v_series_clean") for x in _QUALIFIERS if x in {c for c, _ in have[v]}]
    return spark.createDataFrame(shown, "view_name string, qualifier string")


@query("select table_name, bool_or(column_name = 'edge_type') as has_edge_type from information_schema.columns where table_name in ('part', 'nation') group by table_name")
def qa_3_4_edge_type(spark, sf_dir):
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").columns for t in ("part", "nation")}
    return spark.createDataFrame([(t, "edge_type" in c) for t, c in tables.items()], "table_name string, has_edge_type boolean")


def _report_sql() -> str:
    found = RULES | {"qa_3_1_trees": ("", _CYCLES)}
    arms = [f"select '{name}' as rule_name, '{severity(name)}' as severity, (select count(*) from ({planted(duck)}) x) as n" for name, (_, duck) in found.items()]
    return f"select rule_name, severity, case when n > 0 then severity else 'PASS' end as outcome, n from ({' union all '.join(arms)}) r"


@query(duck_sql(_report_sql()))
def qa_7_1_report(spark, sf_dir):
    """All rules over the planted table: severity, outcome and how much each finds.

    The model's views and the planted table are settled once, so that no rule derives them anew.
    """
    for name in ("obs", "ytd", "settled"):
        settled(view(spark, sf_dir, name)).createOrReplaceTempView(name)
    register(spark, sf_dir, " ".join(sql for sql, _ in RULES.values()))
    settled(spark.sql(f"with {BAD} select * from bad")).createOrReplaceTempView("bad")
    rules = [q.Rule(name, severity(name), sql, "") for name, (sql, _) in RULES.items()]
    found = [*q.run(spark, rules, lambda s, sql: s.sql(sql)), *q.run_frames({"qa_3_1_trees": (severity("qa_3_1_trees"), lambda: qa_3_1_trees(spark, sf_dir))})]
    for name in ("obs", "ytd", "settled", "bad"):
        spark.catalog.dropTempView(name)
    return spark.createDataFrame([(n, severity(n), o, k) for n, o, k in found], "rule_name string, severity string, outcome string, n long")
