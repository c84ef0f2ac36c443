"""Sources: mixed tables, markdown tables, links, names of files, archives."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import vocab
from ..sources import files
from ..sources.shared import remove, settled, shared_dir
from ..streaming import archive
from .functions_ import _norm
from .observations import run_sql, table
from .registry import query

#: Parts as a table of units, conversions and prefixes in one: some units and pairs come again, some factors are no numbers.
_MIXED = """select case p_partkey % 3 when 0 then 'unit' when 1 then 'conversion' else 'prefix' end as record_type, p_partkey as line_no, p_brand || cast(p_size % 4 as {t}) as unit_code, p_name as unit_label_fr, p_type as quantity_kind,
  p_brand as from_unit, p_type as to_unit, case when p_size % 6 = 0 then 'bad' else cast(p_size as {t}) || '.5' end as factor, case when p_size % 2 = 0 then 'PCI->PCS' end as calorific_basis, case when p_size % 5 = 0 then 'volume' end as scope, p_name as note from part"""


@query(f"""with m as ({_MIXED.format(t="varchar")}), u as (select *, row_number() over (partition by unit_code order by line_no) as nth from m where record_type = 'unit'),
c as (select *, row_number() over (partition by from_unit, to_unit, coalesce(scope, '') order by line_no) as nth from m where record_type = 'conversion')
select 'unit' as kind, unit_code as a, quantity_kind as b, '' as scope, cast(null as double) as factor, note from u where nth = 1 union all select 'conversion', from_unit, to_unit, coalesce(scope, ''), try_cast(factor as double), note from c where nth = 1""")
def s4_split_units(spark, sf_dir):
    units, factors = files.split_units(run_sql(spark, sf_dir, _MIXED.format(t="string")))
    one = units.select(F.lit("unit").alias("kind"), F.col("unit_code").alias("a"), F.col("quantity_kind").alias("b"), F.lit("").alias("scope"), F.lit(None).cast("double").alias("factor"), "note")
    return one.unionByName(factors.select(F.lit("conversion").alias("kind"), F.col("from_unit").alias("a"), F.col("to_unit").alias("b"), "scope", "factor", "note"))


_NOTES = "select p_partkey as line_no, case when p_size % 5 = 0 then 'prose | only' when p_size % 5 = 1 then '| FN-' || upper(p_type) || ' | toggle | ' || p_name || ' | x | **drop** |' when p_size % 5 = 2 then '  | **FN-B' || upper(p_type) || '** | Units-Basis | ' || p_name || ' | x | effect |' else '| not an id | a | b | c | d |' end as value from part"


@query("""with n as (select p_partkey, p_size % 5 as k, p_type, p_name from part where p_size % 5 in (1, 2)), f as (select *, row_number() over (partition by k, p_type order by p_partkey) as nth from n)
select case k when 1 then 'FN-' else 'FN-B' end || upper(p_type) as footnote_id, case k when 1 then 'toggle' else 'units_basis' end as type, p_name || ' — ' || case k when 1 then 'drop' else 'effect' end as text from f where nth = 1""")
def s5_footnotes(spark, sf_dir):
    return files.footnotes(run_sql(spark, sf_dir, _NOTES))


@query("select page_id, replace(unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)), '&amp;', '&') as link from pages")
def s8_link_harvest(spark, sf_dir):
    return files.links(table(spark, sf_dir, "pages")).select("page_id", "link")


#: Names of reports from pieces that the customer's number picks; what they stand for is known from the pieces.
_MONTHS = ("janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre")
_MONTHS_AR = tuple({n: w for w, n in reversed(files.MONTHS_AR.items())}[n] for n in range(1, 13))
_PIECES = "select c_custkey, c_custkey % 11 as kind, 2010 + c_custkey % 13 as year, c_custkey % 12 + 1 as month, c_custkey % 5 as mark, c_name from customer"
_MONTH = "case month {} end".format(" ".join(f"when {i + 1} then '{m}'" for i, m in enumerate(_MONTHS)))
_MONTH_AR = "case month {} end".format(" ".join(f"when {i + 1} then '{m}'" for i, m in enumerate(_MONTHS_AR)))
_NAMED = f"""select *, case mark when 1 then '_VF-' || cast(year + 1 as {{t}}) when 2 then '_updated' else '' end as tail, case kind when 0 then 'Conjoncture_' || {_MONTH} || '_' || cast(year as {{t}}) when 1 then 'Conjoncture_Energetique_fin_decembre_' || cast(year as {{t}})
  when 2 then 'Conjoncture_' || cast(year as {{t}}) || '_Ar_resume' when 3 then 'Chiffres_cles_' || cast(year as {{t}}) when 4 then 'Rapport_Bilan_' || cast(year as {{t}}) when 5 then 'Bilan_National_' || cast(year as {{t}})
  when 6 then 'Evolution_du_Bilan_' || cast(year as {{t}}) || '-' || cast(year + 9 as {{t}}) when 7 then 'Bulletin-' || {_MONTH} || '-' || cast(year as {{t}}) when 8 then 'Guide_summary_' || cast(year as {{t}})
  when 9 then 'وضع_قطاع_الطاقة_' || {_MONTH_AR} || '_' || cast(year as {{t}}) else 'مؤشرات_قطاع_الطاقة_' || cast(year as {{t}}) end as stem from ({_PIECES}) p"""


@query(f"""select c_custkey, stem || tail || '.pdf' as name, case when kind in (0, 1, 2, 9) then 'Conjoncture' when kind in (3, 10) then 'Memento' when kind in (4, 5, 6) then 'Bilan' when kind = 7 then 'Bulletin-COVID' else 'Other' end as family,
  case when kind in (2, 9, 10) then 'ar' when kind = 5 then 'multi' when kind = 8 then 'en' else 'fr' end as language,
  cast(year as varchar) || case when kind in (0, 7, 9) then '-' || lpad(cast(month as varchar), 2, '0') when kind = 1 then '-12' when kind = 6 then '-' || cast(year + 9 as varchar) else '' end as period,
  case mark when 1 then 'VF-' || cast(year + 1 as varchar) when 2 then 'updated' else '' end as version from ({_NAMED.format(t="varchar")})""")
def s9_s11_file_names(spark, sf_dir):
    """Family, language, period and version from the names of as many reports as there are customers."""
    rows = run_sql(spark, sf_dir, _NAMED.format(t="string")).select("c_custkey", F.concat("stem", "tail", F.lit(".pdf")).alias("name"))
    family, language = files.classify(F.col("name"))
    named = rows.select("c_custkey", "name", family.alias("family"), language.alias("language"))
    return named.select("c_custkey", "name", "family", "language", files.report_period(F.col("name"), F.col("family")).alias("period"), files.version(F.col("name")).alias("version"))


@query("""with f as (select c_mktsegment as url, cast(c_nationkey % 4 as varchar) as body, min(c_custkey) as first_at from customer group by all)
select url, sha256(body) as sha256, first_at as fetched_at, row_number() over (partition by url order by first_at, sha256(body)) as version_no from f""")
def s7_archive_versions(spark, sf_dir):
    fetched = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("url"), F.sha2((F.col("c_nationkey") % 4).cast("string"), 256).alias("sha256"), F.col("c_custkey").alias("fetched_at"))
    return files.archive_versions(fetched)


_FETCHES = "select p_brand || '/' || p_type as url, sha256(cast(p_size % 5 as {t})) as sha256, cast(p_partkey as bigint) as fetched_at, cast(p_partkey % 4 as bigint) as part from part"


@query(f"""with f as (select url, sha256, min(part * 1000000 + fetched_at) as came from ({_FETCHES.format(t="varchar")}) group by url, sha256)
select url, sha256, came % 1000000 as fetched_at, row_number() over (partition by url order by came, sha256) as version_no from f""")
def s7_archive_stream(spark, sf_dir):
    """Fetches that arrive in four files and once more: versions by state, across micro-batches."""
    root = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    fetched = run_sql(spark, sf_dir, _FETCHES.replace("sha256(", "sha2(").replace(") as sha256", ", 256) as sha256").format(t="string"))
    kept = settled(fetched)
    schema = kept.drop("part").schema
    for k in (0, 1, 2, 3, 0):
        own = kept.where(F.col("part") == k).drop("part").coalesce(1)
        own.write.mode("append").parquet(f"{root}/in")
        archive.start(spark, f"{root}/in", schema, f"{root}/store", f"{root}/check").awaitTermination()
    out = settled(spark.read.parquet(f"{root}/store/versions").drop("batch"))
    remove(spark, root)
    return out


@query("""select o_orderkey, case o_orderkey % 3 when 0 then 'annual' when 1 then 'monthly' else 'annual' end as cadence, o_orderkey % 4 in (1, 2, 3) as is_canonical_lang, case when o_orderkey % 2 = 1 then cast(month(o_orderdate) as int) end as cutoff_month from orders""")
def s14_register_sources(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    family = F.when(F.col("o_orderkey") % 3 == 0, "Bilan").when(F.col("o_orderkey") % 3 == 1, "Conjoncture").otherwise("Unknown")
    language = F.when(F.col("o_orderkey") % 4 == 0, "ar").when(F.col("o_orderkey") % 4 == 1, "en").when(F.col("o_orderkey") % 4 == 2, "fr").otherwise("multi")
    period = F.when(F.col("o_orderkey") % 2 == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy"))
    return files.register_sources(o.select("o_orderkey", family.alias("report_family"), language.alias("language"), period.alias("period"))).select("o_orderkey", "cadence", "is_canonical_lang", "cutoff_month")


@query("select page_id, case when contains(lower(url), 'guide') then 'guide' when contains(lower(url), 'strateg') or contains(lower(url), 'pst') then 'strategy' when contains(lower(url), 'th') then 'other' else 'other' end as doc_type from pages")
def s15_document_type(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.document_type(F.col("url")).alias("doc_type"))


#: Parts' names against a vocabulary of nation names and pieces of words, in order; first names win.
_VOCAB = "select n_nationkey as ord, 'v' || cast(n_nationkey as {t}) as id, case n_nationkey % 3 when 0 then n_name else lower(n_name) end as label, case n_nationkey when 1 then 'large|Small size' when 2 then 'medium|large' when 3 then 'é promo' when 4 then 'economy' else null end as aliases from nation"
_PARTS = "select p_partkey, case p_partkey % 4 when 0 then 'The ' || p_type || ', (new)' when 1 then upper(p_type) when 2 then p_name else 'É PROMO!' end as label from part"
_MATCH = f"""with v as ({_VOCAB.format(t="varchar")}), raw as (select ord, id, 0 as p, label as name from v union all select ord, id, 1, split_part(aliases, '|', 1) from v where aliases is not null union all select ord, id, 2, split_part(aliases, '|', 2) from v where contains(aliases, '|')),
n as (select {_norm("name")} as name, id, ord, p from raw), known as (select name, arg_min(id, ord * 10 + p) as id, min(ord * 10 + p) as o from n where name <> '' group by name),
own as (select p_partkey, label, {_norm("label")} as norm from ({_PARTS})),
best as (select o.p_partkey, o.label, coalesce((select id from known k where k.name = o.norm), (select arg_min(id, k.o) from known k where contains(' ' || o.norm || ' ', ' ' || k.name || ' '))) as id from own o)"""


def _matched(spark, sf_dir):
    known = vocab.names(run_sql(spark, sf_dir, _VOCAB.format(t="string")), "id", ["label"], "aliases", "ord")
    return vocab.match(run_sql(spark, sf_dir, _PARTS), "label", known)


@query(_MATCH + " select p_partkey, label, id from best where id is not null")
def j9_vocab_match(spark, sf_dir):
    return _matched(spark, sf_dir)[0].select("p_partkey", "label", "id")


@query(_MATCH + " select 'ed_' || cast(p_size % 5 as varchar) as source_id, 'T' || p_brand as source_ref, 'product' as dimension, label as raw_label, 'page' || cast(b.p_partkey // 40 as varchar) || ' y=' || cast(b.p_partkey % 40 as varchar) || ' values=[' || cast(p_size as varchar) || ', ' || case when p_size % 2 = 0 then p_type else 'None' end || ']' as context from best b join part using (p_partkey) where id is null")
def m5_quarantine(spark, sf_dir):
    """Labels that the vocabulary doesn't know, with their source, table, dimension and context."""
    missed = _matched(spark, sf_dir)[1].join(table(spark, sf_dir, "part"), "p_partkey")
    missed = missed.withColumns({"source": F.concat(F.lit("ed_"), (F.col("p_size") % 5).cast("string")), "ref": F.concat(F.lit("T"), "p_brand"), "page": F.floor(F.col("p_partkey") / 40), "row": F.col("p_partkey") % 40, "even": F.when(F.col("p_size") % 2 == 0, F.col("p_type"))})
    return vocab.quarantine(missed, "label", "product", "source", "ref", "page", "row", ["p_size", "even"])
