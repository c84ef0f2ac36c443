"""The semantic interface as set queries: search, retrieval, guarded comparison, conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import api, catalog, evaluate, postings, requests, settle
from ..sources.shared import settled
from .observations import duck_sql, run_sql, table, view
from .registry import query, sql_query
from .settling import DEFINED_SQL

#: Attributes of the model's series.
_TIERS = """select series_key, indicator_id, period_type, geography_scope, scope, calorific_basis, unit_id, max(aggregation_role) as aggregation_role, count(*) as n_obs, 'order revenue umsatz' as t1, lower(coalesce(replace(product_id, '.', ' '), '')) as t2,
  lower(coalesce(region_id, '') || ' ' || coalesce(scope, '') || ' ' || geography_scope || ' ' || calorific_basis) as t3, 'sales annual orders' as t4 from {view} group by series_key, indicator_id, product_id, region_id, scope, geography_scope, calorific_basis, unit_id, period_type"""
_TERMS = "Asia large-net sales order zzz"
_WORDS = ["asia", "large", "net", "sales", "order", "zzz"]
_WEIGHT = " + ".join(f"case when contains(t1, '{w}') then 8 when contains(t2, '{w}') then 4 when contains(t3, '{w}') then 2 when contains(t4, '{w}') then 1 else 0 end" for w in _WORDS)


@query(duck_sql(f"""with d as ({DEFINED_SQL}), c as (select series_key, n_obs, lower(indicator_id) as t1, lower(coalesce(product_id, '')) as t2, lower(concat_ws(' ', region_id, scope, geography_scope, calorific_basis)) as t3, lower(concat_ws(' ', flow_id, definition, families, period_type)) as t4 from d)
select series_key, cast({_WEIGHT} as int) as score, n_obs from c where {_WEIGHT} > 0 order by 2 desc, n_obs desc, series_key limit 15"""))
def t1_search(spark, sf_dir):
    """The best fifteen, as the store answers over the product's own catalog."""
    store = _store(spark, sf_dir)
    found = store.search_series(_TERMS)
    store.catalog.unpersist()
    return spark.createDataFrame([(r["series_key"], r["score"], r["n_obs"]) for r in found["series"]], "series_key string, score int, n_obs long")


_DOC_TIERS = "select doc_id as id, lower(lang) as t1, lower(source) as t2, lower(text) as t3, cast(n_chars as {t}) as t4 from documents"


@query(f"with d as ({_DOC_TIERS.format(t='varchar')}) select id, cast(" + " + ".join(f"case when contains(t1, '{w}') then 8 when contains(t2, '{w}') then 4 when contains(t3, '{w}') then 2 when contains(t4, '{w}') then 1 else 0 end" for w in ("en", "src1", "that", "token", "99")) + " as int) as score from d")
def t1_score_documents(spark, sf_dir):
    terms = text.terms(F.lit("en SRC1 that token 99 x"))
    return api.tier_scores(run_sql(spark, sf_dir, _DOC_TIERS.format(t="string")), terms).select("id", "score")


def _store(spark, sf_dir) -> api.Store:
    rows = settle.precedence(view(spark, sf_dir, "obs"))
    return api.Store(spark, rows, catalog.catalog(rows))


@query(duck_sql(f"select series_key, n_obs from ({DEFINED_SQL}) where contains(lower(display_name), 'region=asia')"))
def t2_list(spark, sf_dir):
    """All series whose name holds the text, as the store lists them."""
    store = _store(spark, sf_dir)
    found = store.list_series("region=asia", limit=1 << 20)
    store.catalog.unpersist()
    return spark.createDataFrame([(r["series_key"], r["n_obs"]) for r in found["series"]], "series_key string, n_obs long")


#: A query for each region, part type and size word, and pairs of them; pieces of words count too.
_QUERIES = "select 'r' || cast(r_regionkey as {t}) as qid, r_name || ' sales' as query from region union all select 't' || cast(p_partkey as {t}), p_type || ' ' || substr(p_name, 1, 5) || ' net NET' from part union all select 'n' || cast(n_nationkey as {t}), substr(n_name, 1, 2) || ' order_rev' from nation"
_TERM_SQL = f"""with d as ({DEFINED_SQL}), c as (select series_key as key, lower(indicator_id) as t1, lower(coalesce(product_id, '')) as t2, lower(concat_ws(' ', region_id, scope, geography_scope, calorific_basis)) as t3, lower(concat_ws(' ', flow_id, definition, families, period_type)) as t4 from d),
q as ({_QUERIES.format(t="varchar")}), terms as (select qid, term, count(*) as times from (select qid, unnest(string_split_regex(translate(lower(query), chr(39) || '-', '  '), '\\s+')) as term from q) where length(term) > 1 group by qid, term),
hits as (select term, key, case when contains(t1, term) then 8 when contains(t2, term) then 4 when contains(t3, term) then 2 when contains(t4, term) then 1 else 0 end as w from (select distinct term from terms) x, c)
select t.qid, h.key, sum(t.times * h.w)::bigint as score from terms t join hits h on t.term = h.term where h.w > 0 group by t.qid, h.key"""


@query(duck_sql(_TERM_SQL))
def t1_postings(spark, sf_dir):
    """Thousands of queries through the postings, against a scan of all tiers."""
    rows = settle.precedence(view(spark, sf_dir, "obs"))
    found = settled(postings.texts(catalog.tiers(catalog.catalog(rows))))
    return postings.search(run_sql(spark, sf_dir, _QUERIES.format(t="string")), settled(postings.postings(found)), found)


#: Requests for every series, by flags and years that the customer asking sets, and for series that are unknown or not covered.
_REQUESTS = """with s as (select series_key, row_number() over (order by series_key) as k, count(*) over () as n from (select distinct series_key from obs) d),
c as (select c_custkey as rid, case when c_custkey % 17 = 0 then 'nothing ' || c_name when c_custkey % 19 = 0 then 'crude Oil Price ' || c_name end as other, c_custkey % 5 = 0 as include_low, c_custkey % 7 < 2 as include_escalated, c_custkey % 3 = 0 as exclude_provisional,
  case when c_custkey % 4 < 2 then 1994 + c_custkey % 6 end as start_year, case when c_custkey % 4 in (1, 2) then 1996 + c_custkey % 5 end as end_year, case when c_custkey % 11 = 0 then 'monthly' when c_custkey % 2 = 0 then 'annual' end as period_type from customer)
select c.rid, coalesce(c.other, s.series_key) as series_id, c.period_type, cast(c.start_year as int) as start_year, cast(c.end_year as int) as end_year, c.include_low, c.include_escalated, c.exclude_provisional from c join s on s.k = c.rid % s.n + 1"""


@query(duck_sql(f"""with asked as ({_REQUESTS}), live as (select * from settled where is_preferred), met as (
  select a.rid, a.series_id, o.observation_id, o.value, (a.include_low or o.extraction_confidence <> 'low') and (a.include_escalated or not o.is_escalated) as shown
  from asked a left join live o on o.series_key = a.series_id and (a.period_type is null or o.period_type = a.period_type) and (a.start_year is null or o.ref_year >= a.start_year) and (a.end_year is null or o.ref_year <= a.end_year)
    and (not a.exclude_provisional or o.data_status not in ('provisional', 'estimated'))
), sums as (select rid, series_id, count(observation_id) filter (where shown) as n, count(observation_id) as hidden, sum(value) filter (where shown) as total from met group by all), known as (select distinct series_key from settled)
select rid, case when n > 0 then 'ok' when k.series_key is not null then 'empty_in_scope' when contains(lower(series_id), 'oil price') then 'out_of_scope' else 'unknown_series' end as status, n,
  case when n = 0 and k.series_key is not null then hidden end as hidden_by_default, case when k.series_key is null and contains(lower(series_id), 'oil price') then 'crude_price' end as family, round(coalesce(total, 0), 2) as total
from sums left join known k on k.series_key = sums.series_id"""))
def t3_requests(spark, sf_dir):
    """Every customer asks for a series: all answers, and the three kinds of empty, from one plan."""
    rows = settle.precedence(view(spark, sf_dir, "obs"))
    found = requests.series(run_sql(spark, sf_dir, _REQUESTS), rows, rows.select("series_key").distinct(), [("oil price", "crude_price", False)])
    total = F.round(F.aggregate("observations", F.lit(0.0), lambda a, o: a + F.coalesce(o["value"], F.lit(0.0))), 2)
    return found.select("rid", "status", "n", "hidden_by_default", "family", total.alias("total"))


_FAMILIES = [("oil price", "crude_price"), ("thth", "fx_rate"), ("ther", "trade"), ("blog", "refining")]


@query("select page_id, case " + " ".join(f"when contains(lower(url), '{p}') then '{f}'" for p, f in _FAMILIES) + " end as family from pages")
def t12_deferred(spark, sf_dir):
    low = F.lower(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", text.first_rule([(low.contains(p), f) for p, f in _FAMILIES]).alias("family"))


@query(duck_sql("with x as (select unnest(['calorific_basis', 'period_type', 'geography_scope', 'scope', 'unit_id']) as attribute, unnest([calorific_basis, period_type, geography_scope, scope, unit_id]) as value from v_series) select attribute, array_to_string(list_sort(list(distinct coalesce(nullif(value, ''), 'NA'))), ',') as vals from x group by attribute having count(distinct coalesce(nullif(value, ''), 'NA')) > 1"))
def t13_twin_warnings(spark, sf_dir):
    return api.twin_conflicts(view(spark, sf_dir, "v_series")).select("attribute", F.array_join("values", ",").alias("vals"))


@query(duck_sql("with g as (select * from (values ('calorific_basis', 'NET', 'GROSS'), ('calorific_basis', 'PCI', 'PCS'), ('scope', 'flash_only', 'all|market'), ('unit_id', 'NET', 'x')) v(attribute, token, never_sum_with)), used as (select distinct unnest(['calorific_basis', 'scope', 'aggregation_role']) as attribute, unnest([calorific_basis, scope, aggregation_role]) as token from v_series) select g.attribute, g.token, never_sum_with from g join used u on u.attribute = g.attribute and u.token = g.token"))
def t14_glossary(spark, sf_dir):
    glossary = spark.createDataFrame([("calorific_basis", "NET", "GROSS"), ("calorific_basis", "PCI", "PCS"), ("scope", "flash_only", "all|market"), ("unit_id", "NET", "x")], "attribute string, token string, never_sum_with string")
    return api.glossary_of(view(spark, sf_dir, "v_series"), glossary).select("attribute", "token", "never_sum_with")


_ONE = "order_revenue|flow.sales|prod.large||asia||||GROSS|cur|annual|False||||incl_exports"


@query(duck_sql(f"select series_key, value, ref_year, source_id from v_series_clean where series_key = '{_ONE}' and ref_year >= 1996"))
def t3_series(spark, sf_dir):
    rows = api.surface(settle.precedence(view(spark, sf_dir, "obs"))).where(api.conditions(_ONE, start_year=1996))
    return api.envelope(rows).select("series_key", "value", "ref_year", F.col("provenance.source_id").alias("source_id"))


@query(duck_sql(f"select series_key, value, cast(month(period_end) as int) as ytd_cutoff_month from ytd where ref_year = 1998 and ytd_cutoff_month = 6 and region_id = 'asia' and source_id = 'ed_2'"))
def t4_observation(spark, sf_dir):
    rows = view(spark, sf_dir, "ytd").where(api.conditions(start_year=1998, end_year=1998)).where("region_id = 'asia' and source_id = 'ed_2'")
    return api.envelope(rows).where("ytd_cutoff_month = 6").select("series_key", "value", "ytd_cutoff_month")


@query(duck_sql("""with notes as (select series_key, 'FN-' || report_type as footnote_id from obs where extraction_confidence = 'low' union all select series_key, 'FN-ESC' from obs where is_escalated), asked as (select distinct series_key from obs union all select 'series of ' || n_name from nation)
select a.series_key as series_id, case when min(o.series_key) is null then 'unknown_series' else 'ok' end as status, min(o.ref_year) as first_year, max(o.ref_year) as last_year,
  case when min(o.series_key) is not null then coalesce((select string_agg(distinct footnote_id, '/' order by footnote_id) from notes n where n.series_key = a.series_key), '') end as notes,
  case when min(o.calorific_basis) = 'NET' then 'never with GROSS' when min(o.series_key) is not null then '' end as glossary
from asked a left join obs o on o.series_key = a.series_key group by a.series_key"""))
def t5_describe(spark, sf_dir):
    """Every series described with its footnotes and glossary, and some that are unknown."""
    obs = view(spark, sf_dir, "obs")
    notes = obs.select("observation_id", F.explode(F.array_compact(F.array(F.when(F.col("extraction_confidence") == "low", F.concat(F.lit("FN-"), "report_type")), F.when(F.col("is_escalated"), "FN-ESC")))).alias("footnote_id")).withColumn("text", F.concat(F.lit("note "), "footnote_id"))
    glossary = spark.createDataFrame([("calorific_basis", "NET", "never with GROSS"), ("calorific_basis", "PCI", "x")], "attribute string, token string, definition string")
    asked = obs.select("series_key").distinct().unionByName(table(spark, sf_dir, "nation").select(F.concat(F.lit("series of "), "n_name").alias("series_key")))
    found = requests.describe(asked.select(F.xxhash64("series_key").alias("rid"), F.col("series_key").alias("series_id")), catalog.catalog(settle.precedence(obs)), obs, notes, glossary)
    joined = lambda c, field: F.array_join(F.transform(c, lambda x: x[field]), "/")
    return found.select("series_id", "status", F.col("series.first_year").alias("first_year"), F.col("series.last_year").alias("last_year"), joined("footnotes", "footnote_id").alias("notes"), joined("glossary", "definition").alias("glossary"))


#: Pairs of series to compare: those of one product and region, and each leaf with the totals of its region and basis.
_PAIRS = """select a.series_key as one, b.series_key as other from {s} a join {s} b on a.product_id is not distinct from b.product_id and a.region_id is not distinct from b.region_id where a.series_key < b.series_key
  union all select a.series_key, b.series_key from {s} a join {s} b on a.region_id = b.region_id and a.calorific_basis = b.calorific_basis where a.product_id is not null and b.product_id is null""".format(s="(select distinct series_key, product_id, region_id, calorific_basis from obs)")
_COMPARED = f"""with s as ({_TIERS.format(view="v_series")}), roles as (select series_key, array_agg(distinct aggregation_role) as r from v_series group by series_key),
p as ({_PAIRS}),
j as (select p.one, p.other, a.period_type is distinct from b.period_type or coalesce(nullif(a.geography_scope, ''), 'NA') <> coalesce(nullif(b.geography_scope, ''), 'NA') or coalesce(nullif(a.scope, ''), 'NA') <> coalesce(nullif(b.scope, ''), 'NA') or a.calorific_basis <> b.calorific_basis or a.unit_id <> b.unit_id as twins,
  a.indicator_id = b.indicator_id and coalesce(a.period_type, '') = coalesce(b.period_type, '') and coalesce(a.geography_scope, '') = coalesce(b.geography_scope, '') as together, ra.r as r1, rb.r as r2
  from p join s a on p.one = a.series_key join s b on p.other = b.series_key join roles ra on ra.series_key = p.one join roles rb on rb.series_key = p.other)"""
_STATUS = "case when together and ({has}(r1, 'grand_total') or {has}(r2, 'grand_total') or {has}(r1, 'subtotal') or {has}(r2, 'subtotal') or (({has}(r1, 'leaf') or {has}(r2, 'leaf')) and ({has}(r1, 'alternative_breakdown') or {has}(r2, 'alternative_breakdown')))) then 'refused_aggregation' when twins then 'refused_incompatible' else 'compared' end"


@query(duck_sql(_COMPARED + f" select one, other, {_STATUS.format(has='list_contains')} as status from j"))
def t6_compare_guard(spark, sf_dir):
    return api.compare_pairs(run_sql(spark, sf_dir, _PAIRS), view(spark, sf_dir, "v_series"))


@query(duck_sql("select indicator_id, period_type, geography_scope, array_to_string(list_sort(list(distinct aggregation_role)), ',') as roles, 'grand_total' as reason from v_series group by indicator_id, period_type, geography_scope"))
def t6_role_conflicts(spark, sf_dir):
    live = view(spark, sf_dir, "v_series")
    chosen = live.select("series_key", "indicator_id", "period_type", "geography_scope").distinct()
    found = api.role_conflicts(chosen, live)
    return found.select("indicator_id", "period_type", "geography_scope", F.array_join("roles", ",").alias("roles"), "reason")


@query(duck_sql("select series_key, period_start, count(*) as n_values from (select distinct series_key, period_start, period_end, source_id, value from settled) v group by series_key, period_start, period_end having count(distinct source_id) > 1 and max(value) - min(value) > greatest(5.0, 0.02 * abs(max(value)))"))
def t7_conflicts(spark, sf_dir):
    log = settle.reconciliation_log(settle.precedence(view(spark, sf_dir, "obs"))).where("note = 'disagreement>tol'")
    return log.select("series_key", "period_start", F.size(F.map_keys(F.from_json("values_json", "map<string, double>"))).cast("long").alias("n_values"))


_FACTORS = [("GWh", "ktep", 0.086, "", "electricity"), ("ktep", "GWh", 11.63, "", "electricity"), ("PCI", "PCS", 1.1111111111, "PCI->PCS", "natural gas"), ("PCS", "PCI", 0.9, "PCI->PCS", "natural gas"), ("baril", "m3", 0.159, "", "volume"), ("t_x", "tep", 1.03, "", "crude oil quality"), ("t_x", "tep", 1.02, "", "crude oil MAP")]
#: Every line asks for a conversion of its quantity, between units and in a scope that its numbers pick.
_PAIRS_ASKED = ["ktep-pci>ktep-pcs", "ktep-pcs>ktep-pci", "GWh>ktep", "kt>GWh", "x>x", "t_x>tep", "ktep>GWh", "PCS>PCI", "baril>m3"]
_SCOPES_ASKED = [None, "Natural_Gas", "electricity", "banana", "crude oil MAP", "volume", ""]
_ASKED = "select l_quantity as value, case l_partkey % 9 {pairs} end as pair, case l_suppkey % 7 {scopes} end as scope from lineitem".format(
    pairs=" ".join(f"when {i} then '{p}'" for i, p in enumerate(_PAIRS_ASKED)), scopes=" ".join(f"when {i} then " + ("null" if s is None else f"'{s}'") for i, s in enumerate(_SCOPES_ASKED)))
_FACTOR_VALUES = ", ".join(f"('{a}', '{b}', {f}, '{c}', '{s}')" for a, b, f, c, s in _FACTORS)


@query(f"""with asked as (select value, split_part(pair, '>', 1) as from_unit, split_part(pair, '>', 2) as to_unit, scope from ({_ASKED})), f as (select * from (values {_FACTOR_VALUES}) v(a, b, factor, basis, fs)),
q as (select *, case from_unit when 'ktep-pci' then 'PCI' when 'ktep-pcs' then 'PCS' else from_unit end as qf, case to_unit when 'ktep-pci' then 'PCI' when 'ktep-pcs' then 'PCS' else to_unit end as qt from asked),
k as (select distinct from_unit, to_unit, scope, qf, qt, qf <> from_unit or qt <> to_unit as aliased, coalesce(case lower(replace(nullif(scope, ''), '_', ' ')) when 'natural gas' then 'natural gas' else nullif(scope, '') end, case when qf <> from_unit or qt <> to_unit then 'natural gas' end) as qs from q),
n as (select k.*, count(f.a) as hits, max(f.factor) as factor, max(f.basis) as basis from k left join f on f.a = k.qf and f.b = k.qt and (k.qs is null or f.fs = k.qs) group by all),
r as (select *, case when from_unit = to_unit then 'ok' when hits = 0 then 'no_factor' when hits > 1 then 'ambiguous' else 'ok' end as status from n)
select q.from_unit, q.to_unit, q.scope, r.status, count(*) as requests, round(sum(case when r.status = 'ok' then q.value * case when q.from_unit = q.to_unit then 1 else r.factor end end)::double, 4) as result, r.status = 'ok' and q.from_unit <> q.to_unit and (contains(coalesce(r.basis, ''), '->') or aliased) as basis_change
from q join r on q.from_unit = r.from_unit and q.to_unit = r.to_unit and q.scope is not distinct from r.scope group by all""")
def t9_convert(spark, sf_dir):
    pair = F.split("pair", ">")
    asked = run_sql(spark, sf_dir, _ASKED).select("value", pair[0].alias("from_unit"), pair[1].alias("to_unit"), "scope")
    factors = spark.createDataFrame(_FACTORS, "from_unit string, to_unit string, factor double, calorific_basis string, scope string")
    found = api.conversions(asked, factors)
    return found.groupBy("from_unit", "to_unit", "scope", "status", "basis_change").agg(F.count("*").alias("requests"), F.round(F.sum("result"), 4).alias("result"))


_UNIT_VALUES = ", ".join(f"('conversion', '{a}', '{b}', '{s}', {f})" for a, b, f, _, s in _FACTORS)


@query(f"select 'unit' as kind, p_brand as unit, min(p_type) as quantity_kind, cast(null as varchar) as to_unit, cast(null as varchar) as scope, cast(null as double) as factor from part group by p_brand union all select kind, a, null, b, s, cast(f as double) from (values {_UNIT_VALUES}) v(kind, a, b, s, f)")
def t8_units(spark, sf_dir):
    units = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("unit_code")).agg(F.min("p_type").alias("quantity_kind"))
    return api.unit_rows(units, spark.createDataFrame(_FACTORS, "from_unit string, to_unit string, factor double, calorific_basis string, scope string"))


@query(duck_sql("select 'product_id' as dimension, product_id as member from obs where product_id is not null group by product_id union all select 'region_id', region_id from obs where region_id is not null group by region_id union all select '*', 'product_id=' || count(distinct product_id) from obs union all select '*', 'region_id=' || count(distinct region_id) from obs union all select 'x', 'error'"))
def t10_dimensions(spark, sf_dir):
    """Members of two dimensions, the counts of all, and a name that is none, as the store answers."""
    store = _store(spark, sf_dir)
    rows = [(d, m) for d in ("product_id", "region_id") for m in store.list_dimensions(d)["members"]]
    rows += [("*", f"{k}={n}") for k, n in store.list_dimensions()["dimensions"].items() if k in ("product_id", "region_id")]
    rows.append(("x", store.list_dimensions("x")["status"]))
    store.catalog.unpersist()
    return spark.createDataFrame(rows, "dimension string, member string")


_GLOSSARY = "select r_name as attribute, n_name as token, 'of ' || r_name as definition, case n_nationkey % 3 when 0 then 'all' when 1 then 'all|' || lower(n_name) else r_name || '|x|' || n_name end as never_sum_with from nation join region on n_regionkey = r_regionkey"


@query(f"with g as ({_GLOSSARY}) select attribute, token, unnest(string_split(never_sum_with, '|')) as never_with from g")
def t11_glossary(spark, sf_dir):
    """The whole glossary, attribute by attribute, as the store gives it."""
    store = api.Store(spark, view(spark, sf_dir, "obs"), view(spark, sf_dir, "obs").select("series_key"), glossary=run_sql(spark, sf_dir, _GLOSSARY))
    names = [r[0] for r in table(spark, sf_dir, "region").select("r_name").distinct().collect()]
    rows = [(g["attribute"], g["token"], w) for name in names for g in store.get_scope_glossary(name)["glossary"] for w in g["never_sum_with"]]
    return spark.createDataFrame(rows, "attribute string, token string, never_with string")



_LEAF, _NET, _TOTAL = _ONE, _ONE.replace("GROSS", "NET").replace("False", "True"), "order_revenue|flow.sales|||||||GROSS|cur|annual|False||||incl_exports"
_QUESTIONS = [
    evaluate.Case("series", "get_series", (_LEAF,), {}, {"status": "ok", "n": 0, "observations.0.calorific_basis": "GROSS"}),
    evaluate.Case("all of it", "get_series", (_LEAF,), {"include_low": True, "include_escalated": True}, {"n": 0}),
    evaluate.Case("a year", "get_observation", (_LEAF, 1996), {"include_low": True, "include_escalated": True}, {"observations.0.value": 0.0}),
    evaluate.Case("no such year", "get_series", (_LEAF,), {"start_year": 3000}, {"status": "empty_in_scope"}),
    evaluate.Case("no such series", "get_series", ("nothing",), {}, {"status": "unknown_series"}),
    evaluate.Case("not covered", "get_series", ("crude oil price",), {}, {"status": "out_of_scope", "family": "crude_price"}),
    evaluate.Case("gross with net", "compare", ([_LEAF, _NET],), {}, {"status": "refused_incompatible", "incompatible_on.calorific_basis.n": 2}, "adversarial"),
    evaluate.Case("part with total", "compare", ([_LEAF, _TOTAL],), {}, {"status": "refused_aggregation"}, "adversarial"),
    evaluate.Case("made-up factor", "convert_units", (1.0, "GWh", "barrels"), {}, {"status": "no_factor"}, "adversarial"),
    evaluate.Case("writing", "query", ("drop table observation",), {}, {"status": "error: PermissionError"}, "adversarial"),
]


@query(duck_sql(f"""with one as (select * from v_series where series_key = '{_LEAF}'), n as (select count(*) filter (where extraction_confidence <> 'low' and not is_escalated) as shown, count(*) as live, max(value) filter (where ref_year = 1996) as v from one)
select 'series' as name, 'status' as path, 'ok' as got from n union all select 'series', 'n', cast(shown as varchar) from n union all select 'series', 'observations.0.calorific_basis', 'GROSS' from n union all select 'all of it', 'n', cast(live as varchar) from n
union all select 'a year', 'observations.0.value', cast(round(v, 2) as varchar) from n union all select * from (values ('no such year', 'status', 'empty_in_scope'), ('no such series', 'status', 'unknown_series'), ('not covered', 'status', 'out_of_scope'), ('not covered', 'family', 'crude_price'),
('gross with net', 'status', 'refused_incompatible'), ('gross with net', 'incompatible_on.calorific_basis.n', '2'), ('part with total', 'status', 'refused_aggregation'), ('made-up factor', 'status', 'no_factor'), ('writing', 'status', 'error: PermissionError')) v(a, b, c)"""))
def e1_evaluation(spark, sf_dir):
    """What the interface answers to retrieval and adversarial cases. Each case asks several times, so the tables are settled once."""
    rows = settled(settle.precedence(view(spark, sf_dir, "obs")))
    factors = spark.createDataFrame(_FACTORS, "from_unit string, to_unit string, factor double, calorific_basis string, scope string")
    store = api.Store(spark, rows, catalog.catalog(rows), factors=factors, deferred=[("oil price", "crude_price", False)])
    found = evaluate.run(spark, store, _QUESTIONS)
    store.close()
    value = F.col("path") == "observations.0.value"
    return found.select("name", "path", F.when(value, text.decimal_text(F.col("got").try_cast("double"))).otherwise(F.col("got")).alias("got"))


#: Golden cases of parts and answers of five runs by the lines that sell them: right, near, off, or none.
_CASES = "select 't' || cast(p_partkey as {t}) as task, x.path, case x.path when 'value' then cast(p_retailprice as {t}) when 'unit' then p_brand when 'any' then '*' else '-' end as expected, case when p_size % 3 = 0 then 'adversarial' else 'retrieval' end as layer, p_size % 6 = 0 as gating, case when p_size % 2 = 0 then 'basis|period' else 'scope' end as modes from part join (select 'value' as path union all select 'unit' union all select 'any' union all select 'nothing') x on true"
_ANSWERS = "select 't' || cast(p_partkey as {t}) as task, r.run, x.path, case x.path when 'value' then cast(p_retailprice * (1 + (p_partkey * r.run % 7) * 0.004) as {t}) when 'unit' then case when (p_partkey + r.run) % 9 = 0 then 'other' else p_brand end when 'any' then 'x' else case when (p_partkey + r.run) % 8 = 0 then 'made up' end end as got from part join (select 1 as run union all select 2 union all select 3 union all select 4 union all select 5) r on true join (select 'value' as path union all select 'unit' union all select 'any' union all select 'nothing') x on not (x.path = 'any' and p_partkey % 5 = 0)"
_GRADED = f"""cases as ({_CASES.format(t="varchar")}), answers as ({_ANSWERS.format(t="varchar")}), graded as (
  select c.task, r.run, c.path, c.layer, c.gating, c.modes, case c.expected when '*' then a.got is not null when '-' then a.got is null else case when c.path = 'value' then coalesce(abs(a.got::double - c.expected::double) <= greatest(1.0, 0.01 * greatest(abs(a.got::double), abs(c.expected::double))), false) else coalesce(a.got = c.expected, false) end end as passed
  from cases c join (select distinct task, run from answers) r on r.task = c.task left join answers a on a.task = c.task and a.run = r.run and a.path = c.path)"""


def _graded(spark, sf_dir):
    cases = run_sql(spark, sf_dir, _CASES.format(t="string")).withColumn("modes", F.split("modes", r"\|"))
    return evaluate.graded(cases, run_sql(spark, sf_dir, _ANSWERS.format(t="string")))


@query(f"""with {_GRADED}, each as (select task, layer, gating, run, avg(passed::int) as score from graded group by all)
select task, layer, count(*) as runs, round(avg(score), 6) as mean, round(var_pop(score), 6) as variance, not gating or min(score) = 1 as gate_open from each group by task, layer, gating""")
def a16_runs(spark, sf_dir):
    """Golden cases as a table, five runs of answers: mean and variance by task, and gates."""
    return evaluate.over_runs(_graded(spark, sf_dir)).withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 6)})


@query(f"""with {_GRADED}, each as (select unnest(string_split(modes, '|')) as mode, passed, layer from graded)
select mode, count(*) as n, count(*) filter (where passed) as passed, string_agg(distinct layer, '/' order by layer) as layers, round(count(*) filter (where passed) / count(*), 3) as pass_rate from each group by mode""")
def a16_failure_modes(spark, sf_dir):
    return evaluate.by_mode(_graded(spark, sf_dir)).withColumn("layers", F.array_join("layers", "/"))
