"""Projections, filters, joins, aggregations, ranking and set operations over the model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import api, quality, settle
from .observations import duck_sql, run_sql, table, view
from .registry import query, sql_query

#: Values are rounded where they are sums or ratios of doubles.
CELL = "series_key, period_start, period_end"

# Scans, projections and filters
sql_query("s1_bound_scan", "select observation_id, value from obs where source_id = 'ed_1' and ref_year >= 1996")
_HERE = ("series_key, indicator_id as indicator, value, unit_id, calorific_basis, cast(null as varchar) as basis_confidence, period_type, period_start, period_end, ref_year, data_status, flow_id, product_id, sector_id, region_id, field_id, level_id, producer_id, technology, regime, scope, geography_scope, redevance_included, "
         "is_derived, is_total, aggregation_role, cast(null as varchar) as source_type, cast(null as varchar) as confidence, cast(null as varchar) as extraction_method, extraction_confidence, is_escalated, report_type, cast(null as varchar) as version, cast(null as varchar) as template_version, source_id, cast(null as varchar) as source_page, source_ref, cast(null as varchar) as source_cell")  # fmt: skip


@query(duck_sql(f"select {_HERE} from v_series"))
def p1_projection(spark, sf_dir):
    """The 38 columns that go with every value, as the interface shows them."""
    return api.values(view(spark, sf_dir, "v_series"))


sql_query("p4_membership", "select observation_id from obs where data_status not in ('provisional', 'estimated') and report_type in ('bilan', 'memento')")
sql_query("p5_in_subquery", "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
sql_query("p6_exists", "select c_custkey, c_name from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderpriority = '1-URGENT')")
sql_query("p7_scalar_subquery", "select c_custkey, (select count(distinct o_orderpriority) from orders o where o.o_custkey = c.c_custkey) as priorities from customer c")
sql_query("p8_prefixes", "select p_partkey, startswith(lower(p_name), 'a') as begins, contains(lower(p_name), 're') as holds from part", "select p_partkey, starts_with(lower(p_name), 'a') as begins, contains(lower(p_name), 're') as holds from part")


@query(duck_sql("select observation_id, value from settled where is_preferred and extraction_confidence <> 'low' and not is_escalated and period_type = 'annual' and ref_year between 1996 and 1999 and data_status not in ('provisional', 'estimated')"))
def p2_dynamic_filter(spark, sf_dir):
    which = api.conditions(period_type="annual", start_year=1996, end_year=1999, exclude=("provisional", "estimated"))
    return api.surface(settle.precedence(view(spark, sf_dir, "obs"))).where(which).select("observation_id", "value")


@query(duck_sql("""select 'clean' as surface, count(*) as n from v_series where extraction_confidence <> 'low' and not is_escalated union all
select 'low', count(*) from v_series where not is_escalated union all select 'escalated', count(*) from v_series where extraction_confidence <> 'low' union all select 'both', count(*) from v_series"""))
def p3_surface(spark, sf_dir):
    rows = settle.precedence(view(spark, sf_dir, "obs"))
    each = [api.surface(rows, low, esc).agg(F.lit(name).alias("surface"), F.count("*").alias("n")) for name, low, esc in (("clean", False, False), ("low", True, False), ("escalated", False, True), ("both", True, True))]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


@query(duck_sql("""select series_key, value, strftime(period_start, '%Y-%m-%d') as period_start, strftime(period_end, '%Y-%m-%d') as period_end, cast(null as int) as ytd_cutoff_month,
  product_id, source_id, concat_ws('|', case when extraction_confidence = 'low' then 'LOW_CONFIDENCE' end, case when is_escalated then 'ESCALATED' end, case when data_status <> 'final' then 'DATA_STATUS=' || data_status end) as warnings
from v_series"""))
def p10_envelope(spark, sf_dir):
    out = api.envelope(settle.series(settle.precedence(view(spark, sf_dir, "obs"))))
    return out.select("series_key", "value", "period_start", "period_end", "ytd_cutoff_month", F.col("dimensions.product_id").alias("product_id"), F.col("provenance.source_id").alias("source_id"), F.array_join("warnings", "|").alias("warnings"))


# Joins
sql_query("j1_star", "select n_name, r_name, c_mktsegment, count(*) as n, cast(sum(cast(o_totalprice as decimal(14, 2))) as double) as revenue from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by n_name, r_name, c_mktsegment")
sql_query("j2_bridge", "with links as (select observation_id, 'FN-' || report_type as footnote_id from obs where extraction_confidence = 'low' union all select observation_id, 'FN-ESC' from obs where is_escalated), notes as (select distinct footnote_id, 'note on ' || footnote_id as body from links) select l.observation_id, l.footnote_id, n.body from links l join notes n on l.footnote_id = n.footnote_id")
sql_query("j3_twin_ratio", """select a.observation_id, b.observation_id as twin_id, round(b.value / a.value, 6) as ratio, case when a.value <= 5 then 'skip' when abs(b.value / a.value - 0.95) <= case when a.value <= 15 then 0.15 when a.value < 40 then 0.06 else 0.03 end then 'in band' else 'off band' end as outcome
from obs a join obs b on a.indicator_id = b.indicator_id and a.source_id = b.source_id and a.product_id is not distinct from b.product_id and a.region_id is not distinct from b.region_id and a.flow_id is not distinct from b.flow_id
  and a.scope is not distinct from b.scope and a.period_start = b.period_start and a.period_end = b.period_end where a.calorific_basis = 'GROSS' and b.calorific_basis = 'NET' and a.value > 0""")
sql_query("j4_rowwise", """select a.product_id, a.region_id, a.ref_year, round(b.value / a.value, 6) as ratio from obs a join obs b on a.product_id = b.product_id and a.region_id = b.region_id and a.ref_year = b.ref_year and a.calorific_basis = b.calorific_basis
where a.source_ref = 'T1' and b.source_ref = 'T2' and a.value > 5 and abs(b.value / a.value - 1) > case when a.value <= 30 then 0.12 else 0.04 end""")
sql_query("j5_period_pairs", """select y.observation_id, a.observation_id as annual_id, abs(y.value - a.value) <= greatest(5.0, 0.05 * abs(a.value)) as agrees
from ytd y join obs a on y.indicator_id = a.indicator_id and y.flow_id is not distinct from a.flow_id and y.product_id is not distinct from a.product_id and y.region_id is not distinct from a.region_id
  and y.calorific_basis = a.calorific_basis and y.unit_id = a.unit_id and y.scope is not distinct from a.scope and y.geography_scope is not distinct from a.geography_scope and y.source_id = a.source_id and y.ref_year = a.ref_year
where y.ytd_cutoff_month = 12 and a.aggregation_role = 'leaf'""")
sql_query("j6_parent_child", """with tree as (select distinct 'prod.' || lower(p_type) || '/' || p_brand as child, 'prod.' || lower(p_type) as parent from part),
seen as (select distinct 'prod.' || lower(p_type) || '/' || p_brand as node, p_size from part where p_size <= 5 union all select distinct 'prod.' || lower(p_type), p_size from part where p_size in (2, 4))
select c.p_size, c.node as child, p.node as parent from seen c join tree t on c.node = t.child join seen p on p.node = t.parent and p.p_size is not distinct from c.p_size""")
sql_query("j7_orphans", "select l_orderkey, l_partkey from lineitem l where not exists (select 1 from (select * from part where p_size > 10) p where p.p_partkey = l.l_partkey)")
sql_query("j8_drift", "select s.source_id, s.report_type, d.report_type as expected, count(*) as n from obs s join (select 'ed_' || cast(prio as varchar(9)) as source_id, case prio when 1 then 'bilan' when 2 then 'rapport' when 3 then 'rapport' else 'conjoncture' end as report_type from (select distinct prio from obs) q) d on s.source_id = d.source_id where s.report_type is distinct from d.report_type group by s.source_id, s.report_type, d.report_type")

# Aggregations
sql_query("a2_having", "select o_custkey, count(*) as n, max(o_totalprice) as top from orders group by o_custkey having n > 12 and max(o_totalprice) > 1000")
sql_query("a3_group_all", "select c_mktsegment, c_nationkey, count(*) as n from customer group by all")
sql_query("a4_bool_or", "select o_custkey, bool_or(o_orderstatus = 'P') as any_pending, bool_and(o_totalprice > 1000) as all_large from orders group by o_custkey")
sql_query("a5_filtered", "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as final, count(*) filter (where o_orderstatus <> 'F') as open from orders group by o_orderpriority")
sql_query("a6_string_agg", "select region_id, array_join(array_sort(collect_set(report_type)), '/') as families from obs group by region_id", "select region_id, string_agg(distinct report_type, '/' order by report_type) as families from obs group by region_id")
sql_query("a7_struct_list", f"select {CELL}, to_json(array_sort(collect_list(struct(source_id, data_status)))) as listed from obs group by {CELL}", f"select {CELL}, cast(to_json(list({{'source_id': source_id, 'data_status': data_status}} order by source_id, data_status)) as varchar) as listed from obs group by {CELL}")
sql_query("a8_enum_minmax", "select product_id, max(aggregation_role) as role, min(extraction_confidence) as confidence from obs group by product_id")
sql_query("a9_pivot", "select ref_year, source_id, max(case when calorific_basis = 'GROSS' then value end) as gross, max(case when calorific_basis = 'NET' then value end) as net from obs where aggregation_role = 'grand_total' group by ref_year, source_id")
sql_query("a10_distinct", "select distinct report_type, data_status, aggregation_role from obs")
sql_query("a12_overcount", f"""with s as (select *, case when observation_id % 89 = 0 then amount * 9 else amount end as shaken from obs)
select source_id, ref_year, calorific_basis, cast(sum(case when aggregation_role = 'leaf' then shaken end) as double) as leaves, cast(max(case when aggregation_role = 'grand_total' then amount end) as double) as total
from s group by source_id, ref_year, calorific_basis having sum(case when aggregation_role = 'leaf' then shaken end) > max(case when aggregation_role = 'grand_total' then amount end) * 1.15""")
sql_query("a13_structure", "select source_id, ref_year, calorific_basis, count(*) filter (where aggregation_role = 'grand_total') as n_grand from obs where not (aggregation_role = 'grand_total' and ref_year = 1997) group by source_id, ref_year, calorific_basis having count(*) filter (where aggregation_role = 'leaf') > 0 and count(*) filter (where aggregation_role = 'grand_total') <> 1")
sql_query("a14_balance", """select product_id, ref_year, calorific_basis, cast(coalesce(sum(case when region_id = 'asia' then amount end), 0) + coalesce(sum(case when region_id = 'europe' then amount end), 0) - coalesce(sum(case when region_id = 'africa' then amount end), 0) as double) as balance,
  cast(coalesce(sum(case when region_id = 'america' then amount end), 0) as double) as printed from obs where aggregation_role = 'leaf' group by product_id, ref_year, calorific_basis
having abs(coalesce(sum(case when region_id = 'asia' then amount end), 0) + coalesce(sum(case when region_id = 'europe' then amount end), 0) - coalesce(sum(case when region_id = 'africa' then amount end), 0) - coalesce(sum(case when region_id = 'america' then amount end), 0)) > greatest(5, 0.02 * abs(coalesce(sum(case when region_id = 'america' then amount end), 0)))""")
sql_query("a15_carriers", "select source_id, ref_year, calorific_basis, cast(sum(case when aggregation_role = 'leaf' then amount else 0 end) as double) as carriers, cast(sum(case when aggregation_role = 'grand_total' then amount else 0 end) as double) as everything from obs group by source_id, ref_year, calorific_basis")
sql_query("a_role_rollup", "select region_id, product_id, aggregation_role, calorific_basis, cast(sum(amount) as double) as total from obs group by region_id, product_id, aggregation_role, calorific_basis")
sql_query("a16_mode_rates", "select mode, round(avg(hit), 6) as rate, round(var_pop(hit), 6) as variance, count(*) as n from (select explode(split(concat_ws(',', event_type, case when value > 50 then 'large' end), ',')) as mode, case when value > 25 then 1.0D else 0.0D end as hit from events) group by mode", "select mode, round(avg(hit), 6) as rate, round(var_pop(hit), 6) as variance, count(*) as n from (select unnest(string_split(concat_ws(',', event_type, case when value > 50 then 'large' end), ',')) as mode, case when value > 25 then 1.0::double else 0.0::double end as hit from events) group by mode")

# Ranking, sets, recursion
sql_query("w4_order_by", "select o_orderkey, round(o_totalprice / (o_custkey + 1), 6) as ratio from orders order by ratio desc, o_orderkey")
sql_query("w5_topk", "select p_partkey, p_name, p_size from part order by p_size desc, p_retailprice desc, p_partkey limit 50")
sql_query("w6_probe", "select exists (select 1 from obs where extraction_confidence = 'low') as has_low, exists (select 1 from obs where value < 0) as has_negative")
sql_query("w7_intersect", "select series_key from obs where ref_year = 1995 intersect select series_key from obs where ref_year = 2001")
sql_query("w8_union_all", "select n_name as name, 'nation' as kind from nation union all select r_name, 'region' from region")
#: Customers in rings of one nation and segment, each pointing at the next, and the first half of them in chains that end.
_RINGS = """with c as (select c_custkey, c_nationkey, lead(c_custkey) over (partition by c_nationkey, c_mktsegment order by c_custkey) as next_key, first_value(c_custkey) over (partition by c_nationkey, c_mktsegment order by c_custkey) as first_key from customer)
select cast(c_custkey as varchar(20)) as child, cast(case when c_nationkey % 2 = 0 then next_key else coalesce(next_key, first_key) end as varchar(20)) as parent from c"""


@query(f"""with recursive edges as ({_RINGS}), walk as (select child as origin, parent as node from edges where parent is not null union select w.origin, e.parent from walk w join edges e on w.node = e.child where e.parent is not null),
back as (select origin from walk where node = origin) select w.origin as offender, count(*) as length from walk w join back using (origin) group by w.origin""")
def w10_cycles(spark, sf_dir):
    """Members of cycles of any length, in logarithmically many rounds."""
    return quality.cycles(run_sql(spark, sf_dir, _RINGS))
