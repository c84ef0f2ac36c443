"""Extraction over token grids made from the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import extraction as ex
from ..operators import pages, tables, vocab
from ..sources import words
from ..sources.shared import remove, settled, shared_dir
from .functions_ import _norm
from .observations import duck_sql, run_sql, table, view
from .registry import query, sql_query

#: A page of words: each part is one, on a grid of rows 12 apart with a jitter, at uneven places.
_WORDS = """select p_partkey, p_partkey % 40 as page, cast(12 * (p_size % 9) + (p_partkey % 3) * 0.02 as double) as y, cast((p_partkey * 37) % 500 as double) as x0, cast((p_partkey * 37) % 500 + 8 + p_size % 7 as double) as x1, p_name as text from part"""
_ANCHORS = [(0, "real", 60.0), (1, "a", 150.0), (2, "b", 240.0), (3, "c", 330.0), (4, "var", 420.0)]


@query(f"""with w as ({_WORDS}) select page, round(y, 1) as line_y, string_agg(text, ' ' order by x0, text) as line from w group by page, round(y, 1)""")
def x1_lines(spark, sf_dir):
    return ex.lines(run_sql(spark, sf_dir, _WORDS))


@query(f"with w as ({_WORDS}) select p_partkey from w where abs(y - 48) <= 6")
def x2_band(spark, sf_dir):
    return ex.band(run_sql(spark, sf_dir, _WORDS), 48.0, 6.0).select("p_partkey")


@query(f"""with w as ({_WORDS}), l as (select page, round(y, 1) as line_y, string_agg(text, ' ' order by x0, text) as line from w group by page, round(y, 1)) select page, min(line_y) as line_y from l where contains(lower(line), 'small') group by page""")
def x3_find_row(spark, sf_dir):
    return ex.find_row(ex.lines(run_sql(spark, sf_dir, _WORDS)), "Small")


_ASSIGNED = f"""with w as ({_WORDS}), a as (select * from (values {", ".join(f"({o}, '{c}', {x})" for o, c, x in _ANCHORS)}) v(ord, col, x)),
d as (select w.*, a.col, abs((x0 + x1) / 2 - a.x) as d, row_number() over (partition by p_partkey order by abs((x0 + x1) / 2 - a.x), a.ord) as nth from w cross join a), near as (select * from d where nth = 1 and d <= 27)"""


def _anchored(spark, sf_dir):
    anchors = spark.createDataFrame(_ANCHORS, "ord int, column string, x double")
    return ex.nearest_anchor(run_sql(spark, sf_dir, _WORDS), anchors)


@query(_ASSIGNED + " select p_partkey, col as column_name from near")
def x4_nearest_anchor(spark, sf_dir):
    return _anchored(spark, sf_dir).select("p_partkey", F.col("column").alias("column_name"))


@query(_ASSIGNED + " select page, round(y, 1) as line_y, col as column_name, string_agg(text, '' order by x0, text) as cell from near group by all")
def x5_concat(spark, sf_dir):
    words = _anchored(spark, sf_dir).withColumn("line_y", F.round("y", 1))
    return ex.cells(words, ["page", "line_y"]).withColumnRenamed("column", "column_name")


@query("""with g as (select event_id, user_id, epoch(ts) as secs, lag(epoch(ts)) over (partition by user_id order by epoch(ts), event_id) as before from events)
select event_id, sum(case when secs - before > 3600 then 1 else 0 end) over (partition by user_id order by secs, event_id rows unbounded preceding)::bigint as cluster from g""")
def x6_gap_sessionise(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return ex.clusters(events, ["user_id"], "at", "at", 3600.0, ["event_id"]).select("event_id", "cluster")


@query(f"""with w as ({_WORDS}), g as (select *, lag(x1) over (partition by page order by x0, p_partkey) as before from w), c as (select *, sum(case when x0 - before > 14 then 1 else 0 end) over (partition by page order by x0, p_partkey rows unbounded preceding) as cluster from g)
select page, cluster::bigint as cluster, (min(x0) + max(x1)) / 2 as centre from c group by page, cluster""")
def x6_column_centres(spark, sf_dir):
    runs = ex.clusters(run_sql(spark, sf_dir, _WORDS), ["page"], "x0", "x1", ex.COLUMN_GAP, ["p_partkey"])
    return runs.groupBy("page", "cluster").agg(((F.min("x0") + F.max("x1")) / 2).alias("centre"))


_HEADS = """select o_orderkey as page, cast(o_orderkey % 4 + 3 as int) as n_columns, cast(o_orderkey % 6 + 1 as int) as number, cast(year(o_orderdate) as int) as real_year, cast(case when o_orderkey % 5 = 0 then null else month(o_orderdate) end as int) as cutoff from orders"""
_ROLES = "case when n_columns >= 5 then ['real', 'a', 'b', 'c', 'var', 'tcam'][number] when n_columns = 4 then ['real', 'b', 'c', 'var'][number] else ['real', 'b', 'c'][number] end"


@query(f"""with h as ({_HEADS}), r as (select *, {_ROLES} as role, [real_year - 2, real_year, real_year + 1] as ytd from h),
y as (select *, case role when 'real' then real_year when 'a' then ytd[1] when 'b' then ytd[2] when 'c' then ytd[3] end as year, coalesce(cutoff, 4) as m from r)
select page, role, case when year is not null then case role when 'real' then 'annual' else 'ytd_cumulative' end end as period_type, make_date(year, 1, 1) as period_start,
  case when role = 'real' then make_date(year, 12, 31) else make_date(year, m, [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m]) end as period_end, year as ref_year, case when year is not null and role <> 'real' then m end as cutoff_month from y""")
def x9_period_map(spark, sf_dir):
    h = run_sql(spark, sf_dir, _HEADS).withColumn("role", ex.column_role(F.col("n_columns"), F.col("number")))
    years = F.array(F.col("real_year") - 2, F.col("real_year"), F.col("real_year") + 1)
    h = h.withColumn("p", ex.period(F.col("role"), F.col("real_year"), years, F.col("cutoff"), F.col("n_columns")))
    return h.select("page", "role", *[f"p.{c}" for c in ("period_type", "period_start", "period_end", "ref_year")], F.col("p.cutoff").alias("cutoff_month"))


@query("""with l as (select o_custkey as page, o_orderkey as line_y, 'fin ' || case when o_orderkey % 2 = 0 then '2019 2020 ' else '' end || cast(2000 + o_orderkey % 5 as varchar) as line from orders),
c as (select *, len(regexp_extract_all(line, '\\b(20\\d\\d)\\b')) as n from l), b as (select page, arg_max(line, n * 1000000 - line_y) as line from c group by page),
y as (select page, list_transform(regexp_extract_all(line, '\\b(20\\d\\d)\\b'), lambda v: v::int) as ytd from b),
o as (select c.page, min(v::int) as real_year from (select page, unnest(regexp_extract_all(line, '\\b(20\\d\\d)\\b')) as v from c) c join y on y.page = c.page where not list_contains(y.ytd, v::int) group by c.page)
select y.page, array_to_string(y.ytd, ',') as ytd_years, o.real_year from y left join o using (page)""")
def x8_header_years(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    line = F.concat(F.lit("fin "), F.when(F.col("o_orderkey") % 2 == 0, "2019 2020 ").otherwise(""), (2000 + F.col("o_orderkey") % 5).cast("string"))
    found = ex.header_years(o.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("line_y"), line.alias("line")))
    return found.select("page", F.array_join(F.col("ytd_years").cast("array<string>"), ",").alias("ytd_years"), "real_year")


@query("""with recursive y as (select distinct user_id % 200 as page, hour(ts) * 60.0 + minute(ts) as y from events), walk as (select page, min(y) as y from y group by page
  union all select w.page, min(y.y) from walk w join y on y.page = w.page and y.y - w.y > 3 group by w.page) select page, cast(y as double) as y from walk""")
def x10_greedy_dedupe(spark, sf_dir):
    """What is kept depends on the order of rows; in SQL a walk from each kept row to the next."""
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 200).alias("page"), (F.hour("ts") * 60.0 + F.minute("ts")).alias("y"))
    return ex.collapse_rows(events, ["page"])


@query("""with r as (select o_custkey as page, cast(o_orderkey % 997 as double) as y from orders), a as (select page, y, max(case when abs(y - 100) <= 60 then 1 else 0 end) over (partition by page order by y) as begun from r),
g as (select *, case when y - lag(y) over (partition by page order by y) > 90 then 1 else 0 end as broken from a where begun = 1), s as (select *, sum(broken) over (partition by page order by y rows unbounded preceding) as cuts from g) select page, y from s where cuts = 0""")
def x10_contiguous(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), (F.col("o_orderkey") % 997).cast("double").alias("y"))
    return ex.contiguous(rows, ["page"], F.lit(100.0), gap=90.0, first=60.0).select("page", "y")


@query("select l_suppkey, list_sort(list(l_extendedprice - l_quantity))[len(list(l_quantity)) // 2 + 1] as drift from lineitem group by l_suppkey")
def x12_upper_median(spark, sf_dir):
    return ex.median_drift(table(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_extendedprice"), F.col("l_quantity"))


sql_query("x13_unpivot_sql", "select o_custkey, 'F' as status, count(*) as n from orders where o_orderstatus = 'F' group by o_custkey union all select o_custkey, 'O', count(*) from orders where o_orderstatus = 'O' group by o_custkey union all select o_custkey, 'P', count(*) from orders where o_orderstatus = 'P' group by o_custkey")


@query("select o_custkey, status, n from (select o_custkey, nullif(count(*) filter (where o_orderstatus = 'F'), 0) as final, nullif(count(*) filter (where o_orderstatus = 'O'), 0) as open, nullif(count(*) filter (where o_orderstatus = 'P'), 0) as pending from orders group by o_custkey) m unpivot (n for status in (final, open, pending))")
def x13_unpivot(spark, sf_dir):
    count = lambda s, name: F.nullif(F.count_if(F.col("o_orderstatus") == s), F.lit(0).cast("long")).alias(name)
    matrix = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(count("F", "final"), count("O", "open"), count("P", "pending"))
    return ex.unpivot(matrix, ["o_custkey"], ["final", "open", "pending"], "status", "n")


_RULES = [("small", "first"), ("s", "second"), ("large b", "third"), ("large", "fourth")]


@query("select p_partkey, case " + " ".join(f"when starts_with(lower(p_name), '{p}') then '{v}' end" if i == len(_RULES) - 1 else f"when starts_with(lower(p_name), '{p}') then '{v}'" for i, (p, v) in enumerate(_RULES)) + " as flow from part")
def x14_prefix_rules(spark, sf_dir):
    return ex.prefix_rule(table(spark, sf_dir, "part"), "p_name", _RULES, "flow").select("p_partkey", "flow")


_SHAKEN = "select *, case when observation_id % 61 = 0 then value * 2 else value end as shaken from obs"


@query(duck_sql(f"""with s as ({_SHAKEN}), t as (select source_id, ref_year, calorific_basis, sum(case when aggregation_role = 'leaf' then shaken end) as parts, max(case when aggregation_role = 'grand_total' then shaken end) as total from s group by all)
select s.observation_id, case when abs(t.parts - t.total) > greatest(8.0, 0.02 * abs(t.total)) then 'low' else 'normal' end as confidence from s join t using (source_id, ref_year, calorific_basis)"""))
def x15_self_check(spark, sf_dir):
    rows = run_sql(spark, sf_dir, _SHAKEN)
    return ex.flag_inconsistent(rows, ["source_id", "ref_year", "calorific_basis"], "shaken", F.col("aggregation_role") == "leaf", F.col("aggregation_role") == "grand_total").select("observation_id", "confidence")


@query("""with y as (select c_nationkey, c_mktsegment, 2020 + c_nationkey % 3 as year, case when min(c_custkey) % 3 <> 0 then min(c_acctbal) end as prior, max(c_acctbal) as cur from customer group by c_nationkey, c_mktsegment)
select c_nationkey, c_mktsegment, year - 1 as ref_year, prior as value, 'final' as data_status from y where prior is not null union all select c_nationkey, c_mktsegment, year, cur, 'provisional' from y""")
def x16_year_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.when(F.min("c_custkey") % 3 != 0, F.min("c_acctbal")).alias("prior"), F.max("c_acctbal").alias("cur"))
    return ex.year_pairs(c.withColumn("year", 2020 + F.col("c_nationkey") % 3), ["c_nationkey", "c_mktsegment"], "prior", "cur", "year")


@query(duck_sql("""with s as (select ref_year, source_id, calorific_basis, sum(case when region_id in ('asia', 'europe') then amount end) as l, sum(amount) as e from obs where aggregation_role = 'leaf' group by all)
select ref_year, source_id, calorific_basis, 'local' as scope, cast(round(l, 1) as double) as value, true as is_derived from s where l is not null union all select ref_year, source_id, calorific_basis, 'incl_exports', cast(round(e, 1) as double), true from s"""))
def x17_derived_totals(spark, sf_dir):
    leaves = view(spark, sf_dir, "obs").where("aggregation_role = 'leaf'")
    return ex.usage_totals(leaves, ["ref_year", "source_id", "calorific_basis"], "region_id", ["asia", "europe"], "amount")


@query(duck_sql("""with r as (select *, case when ref_year % 2 = 0 then 0 else amount end as printed from obs where not (aggregation_role = 'grand_total' and ref_year = 1999))
select source_id, ref_year, calorific_basis, cast(sum(case when aggregation_role = 'leaf' then amount end) as double) as amount, true as is_derived from r group by source_id, ref_year, calorific_basis
having count(*) filter (where aggregation_role = 'grand_total' and ref_year % 2 = 1 and printed <> 0) = 0"""))
def x18_missing_totals(spark, sf_dir):
    rows = view(spark, sf_dir, "obs").where("not (aggregation_role = 'grand_total' and ref_year = 1999)")
    rows = rows.withColumn("amount", F.when((F.col("aggregation_role") == "grand_total") & (F.col("ref_year") % 2 == 0), 0).otherwise(F.col("amount")))
    out = ex.missing_totals(rows, ["source_id", "ref_year", "calorific_basis"], "amount", "aggregation_role")
    return out.withColumn("amount", F.col("amount").cast("double"))


@query("select conv_id, turn, role, row_number() over (partition by conv_id, role order by turn) as nth from conversations")
def x19_nth_occurrence(spark, sf_dir):
    return ex.nth_of(table(spark, sf_dir, "conversations"), ["conv_id"], "role", ["turn"]).select("conv_id", "turn", "role", "nth")




_RESOLVERS = [("small gear", {"product": "prod.gear", "size": "small"}), ("gear", {"product": "prod.gear"}), ("small", {"size": "small"}), ("large ring", {"product": "prod.ring", "size": "large"})]


@query("select p_partkey, p_name, " + ", ".join("case " + " ".join(f"when contains(' ' || lower(p_name) || ' ', ' {w} ') then " + (f"'{d[k]}'" if k in d else "null") for w, d in _RESOLVERS) + f" end as {k}" for k in ("product", "size")) + " from part")
def x20_resolvers(spark, sf_dir):
    return ex.resolve(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", _RESOLVERS, ["product", "size"])


@query(duck_sql("select observation_id, is_total and (flow_id is null or flow_id = 'flow.sales') and coalesce(product_id, '') = '' and coalesce(region_id, '') = '' and coalesce(level_id, '') = '' as is_grand from obs"))
def x21_grand(spark, sf_dir):
    obs = view(spark, sf_dir, "obs")
    grand = ex.is_grand_total(F.col("is_total"), F.col("flow_id"), "flow.sales", F.col("product_id"), F.col("region_id"), F.col("level_id"))
    return obs.select("observation_id", grand.alias("is_grand"))


@query(f"""with recursive y as (select distinct page, y from ({_WORDS}) w), walk as (select page, 0 as block, min(y) as y from y group by page
  union all select w.page, w.block + 1, min(y.y) from walk w join y on y.page = w.page and y.y - w.y > 30 group by w.page, w.block) select page, block, y from walk""")
def x11_blocks(spark, sf_dir):
    return tables.blocks(run_sql(spark, sf_dir, _WORDS), ["page"])


#: Labels that rules know, that the vocabulary of fields or products knows, and that nothing knows.
_LABELS = ["Demande", "Production d'électricité", "Hors prod. élec.", "Haute pression", "Moy. & Basse pression", "FUEL + GASOIL", "Gaz naturel", "STEG", "IPP (Gaz naturel)", "Achat tiers", "Echanges", "Production nationale", "Production pour marché local", "Total", "Haute tension", "Moyen tension", "Basse tension", "Redevance totale (forfait fiscal)", "PRODUCTION NATIONALE +F.Fiscal", "Achats", "Ressources", "Ventes externes", "Nawara", "El Borma sud", "Gasoil ordinaire", "GPL", "Consommation totale", "???", "", "Demande totale"]
_FIELDS, _PRODUCTS = [("field.nawara", "Nawara"), ("field.el_borma", "El Borma")], [("prod.lpg", "GPL"), ("prod.gasoil_ordinaire", "Gasoil ordinaire")]


def _named(spark, pairs):
    return vocab.names(spark.createDataFrame([(i, n, k) for i, (k, n) in enumerate(pairs)], "ord int, label string, id string"), "id", ["label"], None, "ord")


def _known(spark):
    return {"field_id": _named(spark, _FIELDS), "product_id": _named(spark, _PRODUCTS), "level_id": _named(spark, [("lvl.ht", "HT")])}


def _label_sql() -> str:
    """Every label under every resolver, spread over the parts, and what SQL makes of it: cases of rules, then of names."""
    labels = ", ".join("(" + str(i) + ", '" + x.replace("'", "''") + "')" for i, x in enumerate(_LABELS))
    resolvers = ", ".join(f"({i}, '{r}')" for i, r in enumerate(tables.RESOLVERS))
    own = f"select p.p_partkey, l.label, r.resolver from part p join (values {labels}) l(i, label) on p.p_partkey % {len(_LABELS)} = l.i join (values {resolvers}) r(j, resolver) on (p.p_partkey - p.p_partkey % {len(_LABELS)}) / {len(_LABELS)} % {len(tables.RESOLVERS)} = r.j"
    return own


def _resolved_sql() -> str:
    tests = {"is": "norm = '{t}'", "starts": "starts_with(norm, '{t}')", "has": "contains(norm, '{t}')"}
    quoted = lambda x: "null" if x is None else f"'{x}'"

    def column(d: str) -> str:
        arms = []
        for name, (rules, dimension, extra) in tables.RESOLVERS.items():
            arms += [f"when resolver = '{name}' and {tests[how].format(t=t)} then {quoted(found.get(d))}" for how, t, found in rules]
            pairs = {"field_id": _FIELDS, "product_id": _PRODUCTS, "level_id": [("lvl.ht", "HT")]}.get(dimension, [])
            arms += [f"when resolver = '{name}' and contains(' ' || norm || ' ', ' {n.lower()} ') then {quoted(k if d == dimension else extra.get(d))}" for k, n in pairs]
        return f"case {' '.join(arms)} end as {d}"

    def known() -> str:
        arms = []
        for name, (rules, dimension, _) in tables.RESOLVERS.items():
            arms += [f"when resolver = '{name}' and {tests[how].format(t=t)} then {1 if found.get('is_total') else 0}" for how, t, found in rules]
            pairs = {"field_id": _FIELDS, "product_id": _PRODUCTS, "level_id": [("lvl.ht", "HT")]}.get(dimension, [])
            arms += [f"when resolver = '{name}' and contains(' ' || norm || ' ', ' {n.lower()} ') then {1 if k in tables.PARTS else 0}" for k, n in pairs]
        return f"case {' '.join(arms)} end as total"

    return f"select p_partkey, label, resolver, {', '.join(map(column, tables.DIMENSIONS))}, {known()} from (select *, {_norm('label')} as norm from ({_label_sql()}) o) n"


@query(f"select p_partkey, resolver, {', '.join(tables.DIMENSIONS)}, total = 1 as is_total from ({_resolved_sql()}) x where total is not null")
def x20_row_resolvers(spark, sf_dir):
    found, _ = tables.resolve_rows(run_sql(spark, sf_dir, _label_sql()), _known(spark))
    return found.drop("label")


@query(f"select p_partkey, label, resolver from ({_resolved_sql()}) x where total is null")
def x20_labels_aside(spark, sf_dir):
    return tables.resolve_rows(run_sql(spark, sf_dir, _label_sql()), _known(spark))[1]


#: Words on the pages of the tables of two years: a label, two numbers near the years' places, and strays, from parts.
_YEAR_WORDS = """select p_partkey % 14 as page, cast(70 + 7 * (p_partkey % 41) as double) as y, cast(case p_partkey % 4 when 0 then 20 + p_size when 1 then 165 + p_size % 12 when 2 then 220 + p_size % 15 else 460 + (p_size * 7) % 240 end as double) as x0,
  cast(case p_partkey % 4 when 0 then 60 + p_size when 1 then 175 + p_size % 12 when 2 then 232 + p_size % 15 else 470 + (p_size * 7) % 240 end as double) as x1, case p_partkey % 4 when 0 then p_name when 3 then case when p_size % 2 = 0 then p_brand else '7' end else cast(p_size * 10 as {t}) || ',5' end as text from part"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


@query(f"""with w as ({_YEAR_WORDS.format(t="varchar")}), s as (select * from (values {_values(tables.YEAR_TABLES)}) v({", ".join(x.split()[0] for x in tables.YEAR_TABLES_SCHEMA.split(", "))})),
h as (select s.*, w.y, w.x0, w.text, (w.x0 + w.x1) / 2 as c from w join s on w.page = s.page where w.y between s.y0 and s.y1),
g as (select *, c between cell_min and cell_max and least(abs(c - prior_x), abs(c - current_x)) <= 27 and regexp_matches(regexp_replace(text, '[,.%+ -]', '', 'g'), '^[0-9]+$') as is_cell, abs(c - prior_x) <= abs(c - current_x) as is_prior from h),
l as (select ref, round(y, 1) as line_y, string_agg(text, ' ' order by x0, text) filter (where not is_cell and x0 between label_min and label_max) as label, string_agg(text, '' order by x0, text) filter (where is_cell and is_prior) as prior, string_agg(text, '' order by x0, text) filter (where is_cell and not is_prior) as current from g group by ref, round(y, 1))
select ref, line_y, label, 'prior' as year_column, prior as token from l where label <> '' and prior <> '' union all select ref, line_y, label, 'current', current from l where label <> '' and current <> ''""")
def x16_year_tables(spark, sf_dir):
    specs = spark.createDataFrame(tables.YEAR_TABLES, tables.YEAR_TABLES_SCHEMA)
    return tables.year_table_rows(run_sql(spark, sf_dir, _YEAR_WORDS.format(t="string")), specs).select("ref", "line_y", "label", "year_column", "token")


_BALANCE = "select conv_id, turn, case turn % 3 when 0 then 'Gaz naturel' when 1 then 'Pétrole' else role end as label from conversations"


@query(f"""with b as (select *, row_number() over (partition by conv_id, label order by turn) as nth from ({_BALANCE}) x)
select conv_id, turn, label, case when label = 'Gaz naturel' then case nth when 1 then 'flow.resources' else 'flow.demand' end end as flow_id from b where nth = 1 or label = 'Gaz naturel' and nth = 2""")
def x19_occurrences(spark, sf_dir):
    return tables.occurrences(run_sql(spark, sf_dir, _BALANCE), ["conv_id"], ["turn"])


_LEVEL_ROWS = """select case when p_size % 2 = 0 then 'gas_demand' else 'electricity_sales' end as indicator_id, 'u' as unit_id, 'NA' as calorific_basis, p_brand as source_ref, 2020 + p_size % 3 as ref_year, cast(p_size * 10 + p_partkey % 10 as double) as value,
  case p_partkey % 3 when 0 then 'power_generation' when 1 then 'non_power' end as scope, case p_partkey % 4 when 0 then 'local' when 1 then 'exports_only' end as geography_scope, case when p_partkey % 5 <> 0 then 'lvl' end as level_id from part"""


@query(f"""with r as ({_LEVEL_ROWS}), s as (select indicator_id, unit_id, calorific_basis, source_ref, ref_year, sum(value) filter (where indicator_id = 'gas_demand' and scope is not null) as u,
  sum(value) filter (where indicator_id = 'electricity_sales' and geography_scope = 'local' and level_id is not null) as l, max(value) filter (where indicator_id = 'electricity_sales' and geography_scope = 'exports_only') as e from r group by all)
select indicator_id, unit_id, calorific_basis, source_ref, ref_year, round(v, 1) as value, f as flow_id, g as geography_scope, true as is_total, true as is_grand, true as is_derived from (select *, u as v, 'flow.demand' as f, cast(null as varchar) as g from s union all select *, l, 'flow.sales', 'local' from s union all select *, l + e, 'flow.sales', 'incl_exports' from s) t where v is not null""")
def x17_table_totals(spark, sf_dir):
    return tables.derived_totals(run_sql(spark, sf_dir, _LEVEL_ROWS))


#: Pages of two stacked tables made of parts, twenty lines a page: a title, tops with 3 to 6 numbers, numbers in two pieces, repeated lines, a gap before prose.
_PAGES = """printed as (
  select p_partkey, p_partkey / 20 as page0, p_partkey % 20 as i, p_type, p_size, cast(floor(p_retailprice) as bigint) as price from part
), placed as (
  select cast(floor(page0) as bigint) as page, p_type, p_size, price, case when i >= 10 then i - 10 else i end as r, case when i >= 10 then 1 else 0 end as b,
    100.0 + case when i >= 10 then 250.0 else 0.0 end + 14.0 * case when i >= 10 then i - 10 else i end + case when (case when i >= 10 then i - 10 else i end) >= 8 then 40.0 else 0.0 end as y,
    cast(floor(page0) as bigint) % 4 + 3 as n, (cast(floor(page0) as bigint) % 7) * 3.0 as shift from printed
), numbers as (
  select p.*, c.c from placed p join (select 0 as c union all select 1 union all select 2 union all select 3 union all select 4 union all select 5) c on c.c < p.n
), words as (
  select page, y, 40.0 as x0, 90.0 as x1, case when r = 0 then 'Demande' else p_type end as text from placed
  union all select page, y + case when p_size % 3 = 0 then 4.0 else 0.0 end, 95.0, 130.0, case when r = 0 then 'totale' else 'zone' || cast(p_size as {t}) end from placed
  union all select page, y, 200.0 + shift + 60.0 * c, 206.0 + shift + 60.0 * c, cast(1 + price % 9 as {t}) from numbers
  union all select page, y, 208.0 + shift + 60.0 * c, 226.0 + shift + 60.0 * c, cast(100 + (price + c) % 900 as {t}) from numbers
  union all select page, y + 2.0, 210.0 + shift, 220.0 + shift, '-' from placed where p_size % 5 = 0
  union all select distinct page, 40.0, 40.0, 90.0, 'Demande' from placed
)"""
_SPECS = [("P-T1", "demande totale", 0), ("P-T2", "demande totale", 1), ("P-T3", "demande totale", 2)]


@query(f"""with recursive {_PAGES.format(t="varchar")}, numeric as (
  select *, regexp_full_match(regexp_replace(text, '[\\s,.%+-]', '', 'g'), '[0-9]+') as num, lower(text) as label from words
), tops0 as (
  select distinct page, round(y, 1) as y from numeric w where label = 'demande' and (select count(*) from numeric m where m.page = w.page and m.num and abs(m.y - round(w.y, 1)) <= 5) >= 4
), tops as (
  select page, 0 as block, min(y) as top from tops0 group by page union all select t.page, t.block + 1, min(y.y) from tops t join tops0 y on y.page = t.page and y.y - t.top > 30 group by t.page, t.block
), runs as (
  select *, cast(sum(fresh) over (partition by page, block order by x0, x1, text rows unbounded preceding) as bigint) as k from (
    select t.page, t.block, t.top, w.x0, w.x1, w.text, case when w.x0 - lag(w.x1) over (partition by t.page, t.block order by w.x0, w.x1, w.text) <= 14 then 0 else 1 end as fresh
    from tops t join numeric w on w.page = t.page and abs(w.y - t.top) <= 5 and (w.num or starts_with(w.text, '-')))
), centres as (
  select page, block, top, k, (min(x0) + arg_max(x1, (x0, x1, text))) / 2 as x, max(k) over (partition by page, block) as n from runs group by page, block, top, k
), spots as (
  select *, case when n >= 5 then ['real', 'a', 'b', 'c', 'var', 'tcam'][k] when n = 4 then ['real', 'b', 'c', 'var'][k] else ['real', 'b', 'c'][k] end as role from centres
), geometry as (
  select page, block, any_value(top) as top, any_value(n) as n, max(x) filter (where role = 'real') as real_x, coalesce(max(x) filter (where role = 'tcam'), max(x) filter (where role = 'var'), max(x) filter (where role = 'c')) + 20 as last_x
  from spots where role is not null group by page, block having count(*) >= 3
), ys as (
  select distinct g.page, g.block, g.top, round(w.y, 1) as y from geometry g join numeric w on w.page = g.page and w.num and w.y >= g.top - 4 and abs((w.x0 + w.x1) / 2 - g.real_x) <= 16
    and w.y <= coalesce((select min(t.top) from tops t where t.page = g.page and t.top > g.top + 8) - 6, 1e9)
), apart as (
  select page, block, top, min(y) as y from ys group by page, block, top union all select a.page, a.block, a.top, min(ys.y) from apart a join ys on ys.page = a.page and ys.block = a.block and ys.y - a.y > 3 group by a.page, a.block, a.top, a.y
), first_rows as (
  select page, block, top, min(y) as y from apart where abs(y - top) <= 6 group by page, block, top
), chain as (
  select * from first_rows union all select c.page, c.block, c.top, min(a.y) from chain c join apart a on a.page = c.page and a.block = c.block and a.y > c.y group by c.page, c.block, c.top, c.y having min(a.y) - c.y <= 30
), labelled as (
  select c.page, c.block, c.top, c.y, g.n, g.real_x, g.last_x, trim(string_agg(w.text, ' ' order by w.x0, w.y, w.text)) as label
  from chain c join geometry g using (page, block) join numeric w on w.page = c.page and abs(w.y - c.y) <= 9 and w.x0 < g.real_x - 6 and not w.num group by all
), near as (
  select l.*, w.x0, w.y as wy, w.text, w.x1, arg_min(s.role, (abs((w.x0 + w.x1) / 2 - s.x), s.k)) as role, min(abs((w.x0 + w.x1) / 2 - s.x)) as d
  from labelled l join numeric w on w.page = l.page and abs(w.y - l.y) <= 6 and (w.x0 + w.x1) / 2 between l.real_x - 20 and l.last_x
    join spots s on s.page = l.page and s.block = l.block and s.role is not null where l.label <> '' group by all
)
select 'P-T' || cast(block + 1 as varchar) as ref, page, cast(block as int) as block, cast(top as double) as top, cast(y as double) as row_y, label, cast(n as int) as columns, role, string_agg(text, '' order by x0, wy, text, x1) as token
from near where d <= 27 and block < 3 group by page, block, top, y, label, n, role""")
def x11_page_segments(spark, sf_dir):
    """From words to the cells of stacked tables: tops by their numbers, columns by gaps, rows down to the first gap."""
    found = run_sql(spark, sf_dir, f"with {_PAGES.format(t='string')} select page, cast(y as double) as y, cast(x0 as double) as x0, cast(x1 as double) as x1, text from words")
    specs = found.select("page").distinct().join(F.broadcast(spark.createDataFrame(_SPECS, "ref string, anchor_label string, block int")))  # three tables a page
    return pages.segment(found, specs)


#: Editions of a template: a supplier's header words are moved by its own shift, some headers lack a column.
_TEMPLATE = [(0, "all", 190.0), (1, "crude", 216.0), (2, "gas", 300.0), (3, "pv", 380.0), (4, "geo", 400.0), (5, "bio", 420.0), (6, "heat", 500.0)]
_HEADER = {"brut": "crude", "naturel": "gas", "photovoltaique": "pv", "biomasse": "bio"}
_HEADERS = """words as (
  select s_suppkey as page, 100.0 - 10.0 * h.k as y, h.x + s_suppkey % 11 * 2.5 - 8 + case when h.k = s_suppkey % 4 then 3.0 else 0.0 end as x0, h.x + s_suppkey % 11 * 2.5 + 8 + case when h.k = s_suppkey % 4 then 3.0 else 0.0 end as x1, h.w as text
  from supplier join (select 1 as k, 'BRUT' as w, 216.0 as x union all select 2, 'Naturel', 300.0 union all select 3, 'Photovoltaïque', 380.0 union all select 4, 'biomasse', 420.0 union all select 5, 'Géothermie', 400.0 union all select 6, 'brut', 950.0 union all select 12, 'naturel', 10.0) h
    on (h.k < 5 and s_suppkey % 5 <> h.k) or (h.k = 5 and s_suppkey % 3 = 0) or (h.k = 6 and s_suppkey % 2 = 0) or h.k = 12
)"""


@query(f"""with {_HEADERS}, t as (select * from (values {", ".join(f"({o}, '{c}', {x})" for o, c, x in _TEMPLATE)}) t(ord, "column", x)),
head as (select *, case lower(strip_accents(text)) {" ".join(f"when '{w}' then '{c}'" for w, c in _HEADER.items())} end as "column", (x0 + x1) / 2 as cx from words where y > 100.0 - 90 and y < 100.0 - 1),
base as (select s.s_suppkey as page, t.* from supplier s, t where t.column <> 'geo' or exists (select 1 from head h where h.page = s.s_suppkey and lower(strip_accents(h.text)) = 'geothermie')),
found as (select page, "column", arg_min(cx, (y, x0, x1, text)) as cx from head where "column" is not null group by all),
met as (select b.page, b.ord, b.column, b.x, f.cx from base b left join found f on f.page = b.page and f.column = b.column),
drift as (select page, list_sort(list(cx - x) filter (where cx is not null)) as d from met group by page)
select m.page, m.column, m.ord, coalesce(m.cx, m.x + coalesce(d[len(d) // 2 + 1], 0))::double as x from met m join drift using (page)""")
def x12_reanchored(spark, sf_dir):
    found = run_sql(spark, sf_dir, f"with {_HEADERS} select page, cast(y as double) as y, cast(x0 as double) as x0, cast(x1 as double) as x1, text from words")
    templates = spark.createDataFrame([("v1", *t) for t in _TEMPLATE], "template string, ord int, column string, x double")
    on = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.lit("v1").alias("template"), F.lit(100.0).alias("y"))
    return pages.reanchored(found, templates, on, _HEADER, {"geo": ("geothermie", "geothermal")}, (90.0, 1.0))


@query(f"with w as ({_WORDS}) select page, round(y, 4) as y, x0, x1, text from w where page between 3 and 17 and y <= 60 and page <> 9")
def s6_word_pages(spark, sf_dir):
    """The words written as pages of files and read back: some pages, and a band of rows on them."""
    path = f"{shared_dir(spark)}/words-{uuid.uuid4().hex}"
    words.write(run_sql(spark, sf_dir, _WORDS), path)
    found = words.read(spark, path).where("page >= 3 and page <= 17 and y <= 60 and page <> 9")
    out = settled(found.select(F.col("page").cast("long").alias("page"), F.round("y", 4).alias("y"), "x0", "x1", "text"))
    remove(spark, path)
    return out
