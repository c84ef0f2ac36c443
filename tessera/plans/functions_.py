"""Scalar functions over real and trap inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, text
from .observations import duck_sql, run_sql, table, view
from .registry import query

_LETTERS = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ"
_BASES = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def _norm(c: str) -> str:
    """DuckDB for a normalised label."""
    return f"trim(regexp_replace(regexp_replace(lower(translate(coalesce({c}, ''), '{_LETTERS}', '{_BASES}')), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"select doc_id, {_norm('text')} as label from documents")
def f2_norm_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.norm_label(F.col("text")).alias("label"))


@query("select doc_id, strip_accents(text) as plain from documents")
def f1_strip_accents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_accents("text").alias("plain"))


_TRAPS = ["4 702", "0,3", "-291", "-", "_", "—", "", " ", "1,234.5", "1,234,567", "1d", "1f", "1_000", "1e3", "12.", ".5", "abc", "+7", "1 518", "--3", "5%"]
_NUMBERS = "select replace(cast(cast(o_totalprice as decimal(12, 2)) as {t}), '.', ',') as printed from orders union all select printed from (values " + ", ".join(f"('{x}')" for x in _TRAPS) + ") v(printed)"


@query(f"""with n as ({_NUMBERS.format(t="varchar")}), b as (select printed, replace(trim(printed), ' ', '') as bare from n),
d as (select *, case when contains(bare, ',') and contains(bare, '.') then replace(bare, ',', '') else replace(bare, ',', '.') end as dotted from b)
select printed, case when regexp_matches(dotted, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') then try_cast(dotted as double) end as number,
  regexp_matches(regexp_replace(printed, '[,.%+ -]', '', 'g'), '^[0-9]+$') as numeric_like from d""")
def f3_parse_number(spark, sf_dir):
    rows = run_sql(spark, sf_dir, _NUMBERS.format(t="string"))
    return rows.select("printed", text.parse_number(F.col("printed")).alias("number"), text.looks_numeric(F.col("printed")).alias("numeric_like"))


@query(duck_sql("select observation_id, series_key as own_key, upsert_key as own_upsert from obs"))
def f5_keys(spark, sf_dir):
    obs = view(spark, sf_dir, "obs").drop("series_key", "upsert_key")
    key = keys.series_key()
    return obs.select("observation_id", key.alias("own_key"), keys.upsert_key(key, F.col("period_start"), F.col("period_end"), F.col("source_id")).alias("own_upsert"))


_ROLE = """select c_custkey, c_custkey % 7 <> 0 as is_total, case c_custkey % 5 when 0 then 'flow.demand' when 1 then 'flow.export' when 2 then 'flow.primary_production' end as flow,
  case c_custkey % 11 when 0 then 'prod.gasoil' when 1 then 'prod.gasoline_ssp' when 2 then 'prod.fuel_oil' end as product, case c_custkey % 13 when 0 then 'prod.steg' end as producer,
  case c_custkey % 3 when 0 then 'lvl.hp' end as level, case c_custkey % 6 when 0 then 'non_power' when 1 then 'market_local' end as scope,
  case c_custkey % 4 when 0 then 'exports_only' end as geography, c_custkey % 17 = 0 as is_grand from customer"""


@query(f"""with r as ({_ROLE}) select c_custkey, case when not is_total then 'leaf' when is_grand then 'grand_total' when level is not null and flow = 'flow.demand' then 'alternative_breakdown'
  when scope = 'non_power' and flow = 'flow.demand' then 'subtotal' when scope in ('market_local', 'available_local') then 'alternative_breakdown'
  when flow in ('flow.exchanges_transfers', 'flow.export', 'flow.import') then 'alternative_breakdown' when geography = 'exports_only' then 'alternative_breakdown'
  when product is not null then 'subtotal' when producer = 'prod.steg' then 'subtotal' else 'grand_total' end as role from r""")
def f6_role(spark, sf_dir):
    r = run_sql(spark, sf_dir, _ROLE)
    c = F.col
    return r.select("c_custkey", keys.aggregation_role(c("is_total"), c("flow"), c("product"), c("producer"), c("level"), c("scope"), c("geography"), c("is_grand")).alias("role"))


_MANIFEST = """select o_orderkey, case o_orderkey % 5 when 0 then 'Bilan' when 1 then 'Memento' when 2 then 'Conjoncture' when 3 then 'Bulletin-COVID' else 'Other' end as family,
  case when o_orderkey % 7 = 0 then null when o_orderkey % 2 = 0 then cast(year(o_orderdate) as {t}) else cast(year(o_orderdate) as {t}) || '-' || lpad(cast(month(o_orderdate) as {t}), 2, '0') end as period,
  case o_orderkey % 3 when 0 then 'v_2024' when 1 then '' end as version, case o_orderkey % 4 when 0 then 'ar' when 1 then 'en' when 2 then 'fr' else 'multi' end as language,
  case when o_orderkey % 10 = 0 then 'x/Rapport_Bilan_1.pdf' else 'x/f.pdf' end as path from orders"""


@query(f"""with m as ({_MANIFEST.format(t="varchar")}) select o_orderkey, case family when 'Bilan' then case when contains(path, 'Rapport_Bilan') then 'rapport' else 'bilan' end when 'Memento' then 'memento' when 'Conjoncture' then 'conjoncture' when 'Bulletin-COVID' then 'covid_bulletin' else 'other' end
  || '_' || replace(coalesce(period, 'undated'), '-', '_') || case when coalesce(version, '') <> '' then '_v2024' else '' end || case when language in ('ar', 'en') then '_' || language else '' end as source_id,
  case when regexp_matches(period, '^[0-9]{{4}}-[0-9]{{2}}$') then cast(substr(period, 6, 2) as int) end as cutoff from m""")
def f7_source_id(spark, sf_dir):
    m = run_sql(spark, sf_dir, _MANIFEST.format(t="string"))
    return m.select("o_orderkey", keys.source_id(F.col("family"), F.col("period"), F.col("version"), F.col("language"), F.col("path")).alias("source_id"), keys.period_cutoff(F.col("period")).alias("cutoff"))


@query(duck_sql("""select observation_id, strftime(period_end, '%Y-%m-%d') as ends, case when period_type = 'ytd_cumulative' then cast(month(period_end) as int) end as cutoff,
  concat_ws('|', case when extraction_confidence = 'low' then 'LOW_CONFIDENCE' end, case when is_escalated then 'ESCALATED' end, case when is_derived then 'DERIVED' end, case when data_status <> 'final' then 'DATA_STATUS=' || data_status end) as warned from ytd"""))
def f9_f10_cutoff_warnings(spark, sf_dir):
    ytd = view(spark, sf_dir, "ytd")
    return ytd.select("observation_id", keys.iso(F.col("period_end")).alias("ends"), keys.ytd_cutoff(F.col("period_type"), F.col("period_end")).alias("cutoff"), F.array_join(keys.warnings(F.col("extraction_confidence"), F.col("is_escalated"), F.col("is_derived"), F.col("data_status")), "|").alias("warned"))


_LABELS = "select n_nationkey, case when n_nationkey % 3 = 0 then '' when n_nationkey % 3 = 1 then 'fr ' || n_name end as fr, case when n_nationkey % 2 = 0 then 'en ' || n_name end as en, n_name as id from nation"


@query(f"with l as ({_LABELS}) select n_nationkey, coalesce(nullif(fr, ''), nullif(en, ''), id) as french, coalesce(nullif(en, ''), nullif(fr, ''), id) as english from l")
def f11_labels(spark, sf_dir):
    rows = run_sql(spark, sf_dir, _LABELS)
    labels = {"fr": F.col("fr"), "en": F.col("en")}
    return rows.select("n_nationkey", text.label("fr", labels, F.col("id")).alias("french"), text.label("en", labels, F.col("id")).alias("english"))


_SYNONYMS = {"the": "article definite", "au": "zu an", "ion": "suffix noun"}


@query("select p_partkey, p_name || coalesce(' ' || nullif(concat_ws(' ', " + ", ".join(f"case when contains(p_name, '{k}') then '{v}' end" for k, v in _SYNONYMS.items()) + "), ''), '') as expanded from part")
def f13_dialect(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.expand(F.col("p_name"), _SYNONYMS).alias("expanded"))


#: Free scope words, as customers write them: in capitals, with signs for spaces, with what is not known behind them.
_SCOPES = ["Natural_Gas", "NATURAL-GAS", " gaz  ", "Pétrole brut", "crude/oil", "élec", "Électricité", "volume", "product tep/t", "banana", "", "produits pétroliers", "Power"]
_SCOPE_ROWS = "select c_custkey, case when c_custkey % 3 = 0 then ' ' when c_custkey % 7 = 0 then '__' else '' end || case c_custkey % 13 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(_SCOPES)) + " end || case when c_custkey % 5 = 0 then '/' when c_custkey % 11 = 0 then ' ' || c_mktsegment else '' end as s from customer"


@query("with k as (select c_custkey, s, trim(regexp_replace(translate(lower(trim(s)), 'éèêà_-/', 'eeea   '), ' +', ' ', 'g')) as scope_key from (" + _SCOPE_ROWS + ")) select c_custkey, s, scope_key, case scope_key " + " ".join(f"when '{k}' then '{v}'" for k, v in text.SCOPES.items()) + " end as scope from k")
def f14_scope_norm(spark, sf_dir):
    rows = run_sql(spark, sf_dir, _SCOPE_ROWS)
    return rows.select("c_custkey", "s", text.scope_key(F.col("s")).alias("scope_key"), text.canonical_scope(F.col("s")).alias("scope"))


@query("select event_id, try_cast(json_extract_string(case when event_id % 50 = 0 then null else props end, '$.k') as varchar) as k, case when event_id % 50 <> 0 then len(json_keys(props)) end as n_keys from events")
def f15_json_read(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("p", F.when(F.col("event_id") % 50 == 0, "not json {").otherwise(F.col("props")))
    return events.select("event_id", F.get_json_object("p", "$.k").alias("k"), F.json_object_keys(F.when(F.col("event_id") % 50 != 0, F.col("p"))).alias("n")).select("event_id", "k", F.when(F.col("n").isNotNull(), F.size("n").cast("long")).alias("n_keys"))


@query(duck_sql("select region_id, ref_year, cast(json_group_object(source_id, data_status) as varchar) as built from (select region_id, ref_year, source_id, max(data_status) as data_status from obs where region_id is not null group by all order by source_id) group by region_id, ref_year"))
def f16_json_build(spark, sf_dir):
    each = view(spark, sf_dir, "obs").where("region_id is not null").groupBy("region_id", "ref_year", "source_id").agg(F.max("data_status").alias("data_status"))
    return each.groupBy("region_id", "ref_year").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source_id", "data_status"))))).alias("built"))


@query("select o_orderkey, coalesce(cast(length(o_orderpriority) as varchar), '') || '/' || replace(trim(o_orderpriority), '-', ' ') as shown, o_orderstatus is distinct from 'F' as unsettled from orders where o_orderpriority like '%I%' and o_orderpriority not like '1%'")
def f17_sql_scalars(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").like("%I%") & ~F.col("o_orderpriority").like("1%"))
    return o.select("o_orderkey", F.concat(F.coalesce(F.length("o_orderpriority").cast("string"), F.lit("")), F.lit("/"), F.replace(F.trim("o_orderpriority"), F.lit("-"), F.lit(" "))).alias("shown"), (~F.col("o_orderstatus").eqNullSafe("F")).alias("unsettled"))


@query("select l_orderkey, l_partkey, coalesce(abs(l_extendedprice - l_quantity * 1000) <= greatest(1.0, 0.01 * greatest(abs(l_extendedprice), abs(l_quantity * 1000))), false) as near from lineitem")
def f18_approx(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_partkey", text.approx(F.col("l_extendedprice"), F.col("l_quantity") * 1000).alias("near"))
