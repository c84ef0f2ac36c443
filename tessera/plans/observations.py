"""The test tables projected onto the observation model, as one SQL text that Spark and DuckDB both run.

An observation is the revenue of a product type in a region and year, as one edition (order priority) reports it, gross
and net. ROLLUP adds subtotals per region and grand totals, tagged by role. Money is summed in decimals, so the result
does not depend on the order of rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_LINES = """
types as (
  select p_type, dense_rank() over (order by p_type) as tcode from (select distinct p_type from part) d
), lines as (
  select 'prod.' || lower(p.p_type) as product_id, lower(r.r_name) as region_id, t.tcode, r.r_regionkey + 1 as rcode,
    year(l.l_shipdate) as ref_year, month(l.l_shipdate) as ref_month, cast(substr(o.o_orderpriority, 1, 1) as int) as prio,
    case o.o_orderstatus when 'F' then 3 when 'P' then 1 else 0 end as status_rank, l.l_orderkey,
    cast(l.l_extendedprice as decimal(18, 4)) as gross,
    cast(cast(l.l_extendedprice as decimal(12, 2)) * (1 - cast(l.l_discount as decimal(4, 2))) as decimal(18, 4)) as net
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey join part p on l.l_partkey = p.p_partkey
    join types t on p.p_type = t.p_type join supplier s on l.l_suppkey = s.s_suppkey
    join nation n on s.s_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey
)"""

#: Columns that both period types share, over c: the cell, b: its basis.
_COLUMNS = """
    'order_revenue' as indicator_id, 'flow.sales' as flow_id, c.product_id, cast(null as {text}) as sector_id, c.region_id,
    cast(null as {text}) as field_id, cast(null as {text}) as level_id, cast(null as {text}) as producer_id,
    cast(null as {text}) as technology, cast(null as {text}) as regime,
    case when c.prio = 5 then 'flash_only' end as scope, 'incl_exports' as geography_scope, b.basis = 'NET' as redevance_included,
    b.basis as calorific_basis, 'cur' as unit_id, c.ref_year, c.prio, c.status_rank, c.load_key,
    case c.prio when 1 then 'bilan' when 2 then 'memento' when 3 then 'rapport' when 4 then 'conjoncture' else 'covid_bulletin' end as report_type,
    case c.status_rank when 3 then 'final' when 1 then 'provisional' else 'estimated' end as data_status,
    'ed_' || cast(c.prio as {text}) as source_id, 'T' || cast(c.prio as {text}) as source_ref,
    cast(case b.basis when 'NET' then c.net else c.gross end as double) as value,
    case b.basis when 'NET' then c.net else c.gross end as amount,
    case when c.load_key % 11 = 0 then 'low' else 'normal' end as extraction_confidence,
    c.load_key % 17 = 0 as is_escalated"""

_KEY = """
    indicator_id || '|' || flow_id || '|' || coalesce(product_id, '') || '|' || coalesce(sector_id, '') || '|' || coalesce(region_id, '') || '|' ||
    coalesce(field_id, '') || '|' || coalesce(level_id, '') || '|' || coalesce(producer_id, '') || '|' || calorific_basis || '|' || unit_id || '|' ||
    period_type || '|' || case when redevance_included then 'True' when not redevance_included then 'False' else '' end || '|' ||
    coalesce(scope, '') || '|' || coalesce(technology, '') || '|' || coalesce(regime, '') || '|' || coalesce(geography_scope, '')"""

_OBS = """
cells as (
  select ref_year, prio, region_id, product_id,
    case when grouping(product_id) = 0 then max(tcode) else 0 end as tcode, case when grouping(region_id) = 0 then max(rcode) else 0 end as rcode,
    case when grouping(product_id) = 0 then 'leaf' when grouping(region_id) = 0 then 'subtotal' else 'grand_total' end as aggregation_role,
    sum(gross) as gross, sum(net) as net, max(status_rank) as status_rank, min(l_orderkey) as load_key
  from lines group by ref_year, prio, rollup(region_id, product_id)
), bases as (
  select 'GROSS' as basis, 1 as bcode union all select 'NET', 2
), rows0 as (
  select (((cast(c.ref_year as bigint) * 10 + c.prio) * 100 + c.tcode) * 100 + c.rcode) * 10 + b.bcode as observation_id,
    c.aggregation_role, c.aggregation_role <> 'leaf' as is_total, false as is_derived, 'annual' as period_type,
    make_date(c.ref_year, 1, 1) as period_start, make_date(c.ref_year, 12, 31) as period_end, cast(null as int) as ytd_cutoff_month,{columns}
  from cells c cross join bases b
), obs as (
  select *, {key} as series_key, {key} || '#' || cast(period_start as {text}) || '#' || cast(period_end as {text}) || '#' || source_id as upsert_key from rows0
)"""

_YTD = """
months as (
  select ref_year, prio, region_id, product_id, max(tcode) as tcode, max(rcode) as rcode, ref_month, sum(gross) as gross, sum(net) as net,
    max(status_rank) as status_rank, min(l_orderkey) as load_key
  from lines group by ref_year, prio, region_id, product_id, ref_month
), running as (
  select ref_year, prio, region_id, product_id, tcode, rcode, ref_month, status_rank, load_key,
    sum(gross) over (partition by ref_year, prio, region_id, product_id order by ref_month rows between unbounded preceding and current row) as gross,
    sum(net) over (partition by ref_year, prio, region_id, product_id order by ref_month rows between unbounded preceding and current row) as net
  from months
), bases_y as (
  select 'GROSS' as basis, 1 as bcode union all select 'NET', 2
), ytd0 as (
  select (((((cast(c.ref_year as bigint) * 10 + c.prio) * 100 + c.tcode) * 100 + c.rcode) * 10 + b.bcode) * 100 + c.ref_month) as observation_id,
    'leaf' as aggregation_role, false as is_total, false as is_derived, 'ytd_cumulative' as period_type, make_date(c.ref_year, 1, 1) as period_start,
    make_date(c.ref_year, c.ref_month, case c.ref_month when 2 then 28 when 4 then 30 when 6 then 30 when 9 then 30 when 11 then 30 else 31 end) as period_end,
    cast(c.ref_month as int) as ytd_cutoff_month,{columns}
  from running c cross join bases_y b
), ytd as (
  select *, {key} as series_key, {key} || '#' || cast(period_start as {text}) || '#' || cast(period_end as {text}) || '#' || source_id as upsert_key from ytd0
)"""

#: The default surface: the winner of each cell by report type, status, then the earliest load.
_SETTLED = """
ranked as (
  select o.*, row_number() over (partition by series_key, period_start, period_end order by
      case report_type when 'bilan' then 3 when 'memento' then 2 when 'rapport' then 2 when 'conjoncture' then 1 else 0 end desc,
      case data_status when 'final' then 3 when 'revised' then 2 when 'provisional' then 1 else 0 end desc, load_key, observation_id) as place,
    first_value(observation_id) over (partition by series_key, period_start, period_end order by
      case report_type when 'bilan' then 3 when 'memento' then 2 when 'rapport' then 2 when 'conjoncture' then 1 else 0 end desc,
      case data_status when 'final' then 3 when 'revised' then 2 when 'provisional' then 1 else 0 end desc, load_key, observation_id) as winner
  from obs o
), settled as (
  select *, place = 1 as is_preferred, case when place > 1 then winner end as supersedes_id from ranked
), v_series as (
  select * from settled where is_preferred
), v_series_clean as (
  select * from v_series where extraction_confidence <> 'low' and not is_escalated
)"""

_PARTS = (("lines", _LINES, ("types", "lines")), ("obs", _OBS, ("cells", "bases", "rows0", "obs")), ("ytd", _YTD, ("ytd",)), ("settled", _SETTLED, ("settled", "v_series", "v_series_clean", "ranked")))
_NEEDS = {"lines": (), "obs": ("lines",), "ytd": ("lines",), "settled": ("lines", "obs")}


def with_views(sql: str, text: str) -> str:
    """`sql` with the definitions of the model's views that it names in front; `text` is the dialect's string type."""
    names = set(re.findall(r"\w+", sql))
    wanted = {part for part, _, gives in _PARTS if names & set(gives)}
    wanted |= {x for part in wanted for x in _NEEDS[part]}
    found = [body.format(columns=_COLUMNS.format(text=text), key=_KEY, text=text) if part != "lines" else body for part, body, _ in _PARTS if part in wanted]
    if not found:
        return sql
    own = re.match(r"\s*with\s+(recursive\s+)?", sql, re.I)
    recursive = "recursive " if own and own[1] else ""
    return f"with {recursive}" + ",".join(found) + (", " + sql[own.end() :] if own else "\n" + sql)


def register(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Temporary views of the tables that `sql` names."""
    for name in set(re.findall(r"\w+", sql)) & set(_TABLES):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    full = with_views(sql, "string")
    register(spark, sf_dir, full)
    return spark.sql(full)


def duck_sql(sql: str) -> str:
    return with_views(sql, "varchar")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of the model: lines, obs, ytd, settled, v_series or v_series_clean."""
    return run_sql(spark, sf_dir, f"select * from {name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
