"""Readers and writers of the small files around the observations: vocabularies, units, footnotes, manifests, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import source_id
from ..functions.text import first_rule

# Types of footnotes, families of reports by their names, cadences.
FOOTNOTE_TYPES = {"toggle": "toggle", "units-basis": "units_basis", "provenance/status": "provenance_status", "scope/definition": "scope", "scope": "scope", "definition": "definition", "spec-change": "spec_change", "aggregate-membership": "aggregate_membership", "provenance": "provenance_status"}
ARABIC = r"[؀-ۿ]"
ARABIC_TOKEN = r"(?i)([_\-.]ar([_\-.]|$)|r[eé]sum[eé]|arabe|arabic)"
YEAR_AR = "سنة"
MONTHS_AR = {"جانفي": 1, "فيفري": 2, "مارس": 3, "أفريل": 4, "افريل": 4, "ماي": 5, "جوان": 6, "جويلية": 7, "أوت": 8, "اوت": 8, "سبتمبر": 9, "ىسبتمبر": 9, "سيتمبر": 9, "أكتوبر": 10, "اكتوبر": 10, "نوفمبر": 11, "ديسمبر": 12}
MONTHS_FR = {"janvier": 1, "fevrier": 2, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "aout": 8, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12, "décembre": 12}
VERSIONS = (r"(?i)(VF[-_]?\d{4})", r"(?i)(v[_-]?\d{4})", r"(?i)(V[_\s-]*\d{1,2}-?\d{3,4})", r"(?i)(updated)", "(محينة)")
CADENCE = {"Bilan": "annual", "Memento": "annual", "Conjoncture": "monthly", "Bulletin-COVID": "monthly"}
DOC_TYPES = ((("impact-assessment", "esia", "metbassta", "resettlement", "grievance", "stakeholder", "esms"), "esia"), (("guide",), "guide"), (("strateg", "plan_action", "pst"), "strategy"), (("revue", "depot_etude"), "study"))

UNITS_SCHEMA = "record_type string, unit_code string, unit_label_fr string, quantity_kind string, from_unit string, to_unit string, factor string, calorific_basis string, scope string, source string, note string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header and a declared schema; quoted fields may hold commas and line ends."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def split_units(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, conversion factors) of a mixed table; other record types are left out.

    The first row of a repeated key stays: by `line_no` where there is one, else by the rows' own text.
    """
    order = ["line_no"] if "line_no" in rows.columns else []
    first = lambda df, keys: df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *[c for c in df.columns if c not in (*keys, *order)]))).where("nth = 1").drop("nth", *order)
    units = first(rows.where("record_type = 'unit'").select("unit_code", "unit_label_fr", "quantity_kind", "note", *order), ["unit_code"])
    factors = rows.where("record_type = 'conversion'").select("from_unit", "to_unit", F.expr("try_cast(factor as double)").alias("factor"), F.coalesce("calorific_basis", F.lit("")).alias("calorific_basis"), F.coalesce("scope", F.lit("")).alias("scope"), "note", *order)
    return units, first(factors, ["from_unit", "to_unit", "scope"])


def footnotes(lines: DataFrame, line: str = "value", order: str = "line_no") -> DataFrame:
    """(footnote_id, type, text) of a markdown table's rows (id | type | verbatim | applies to | effect); the first of an id stays."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.where(F.ltrim(line).startswith("|")).select(cells.alias("c"), order).where(F.size("c") >= 5)
    rows = rows.withColumn("footnote_id", F.regexp_extract(F.col("c")[0], r"^\*{0,2}(FN-[A-Z0-9\-]+)\*{0,2}$", 1)).where("footnote_id <> ''")
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("footnote_id").orderBy(order))).where("nth = 1")
    kinds = F.create_map(*[F.lit(x) for pair in FOOTNOTE_TYPES.items() for x in pair])
    kind = F.coalesce(F.element_at(kinds, F.regexp_replace(F.lower(F.col("c")[1]), r"^\*+|\*+$", "")), F.lit("definition"))
    text = F.regexp_replace(F.regexp_replace(F.concat(F.col("c")[2], F.lit(" — "), F.col("c")[4]), r"\*\*", ""), "^[ —]+|[ —]+$", "")
    return first.select("footnote_id", kind.alias("type"), text.alias("text"))


def links(pages: DataFrame, html: str = "html", suffix: str = "") -> DataFrame:
    """The pages with one row for each `href` that ends in `suffix`, entities undone."""
    found = F.regexp_extract_all(html, F.lit(rf'href="([^"]*{suffix})"'), F.lit(1))
    return pages.withColumn("link", F.explode(found)).withColumn("link", F.regexp_replace(F.regexp_replace("link", "&quot;", '"'), "&amp;", "&"))


def classify(name: Column) -> tuple[Column, Column]:
    """(family, language) of a report by its file name; the first rule that holds decides."""
    low = F.lower(name)
    marked = F.when(low.rlike(ARABIC_TOKEN), "ar").otherwise("fr")
    # The words of names, in order.
    rules = [
        (low.contains("conjoncture") | low.contains("conjonctre"), "Conjoncture", marked),
        (name.contains("وضع_قطاع_الطاقة"), "Conjoncture", F.lit("ar")),
        (low.startswith("chiffres") | low.contains("chiffres_cl"), "Memento", marked),
        (name.contains("مؤشرات_قطاع_الطاقة"), "Memento", F.lit("ar")),
        (name.startswith("Rapport_Bilan"), "Bilan", F.lit("fr")),
        (name.contains("Bilan_National") | name.contains("Bilan_national"), "Bilan", F.lit("multi")),
        (name.contains("Evolution_du_Bilan") | name.contains("Note_Methodologique"), "Bilan", F.lit("fr")),
        (name.startswith("Bulletin"), "Bulletin-COVID", marked),
        (name.rlike(ARABIC), "Other", F.lit("ar")),
        (low.contains("summary") | low.contains("_en"), "Other", F.lit("en")),
    ]
    family, language = F.lit("Other"), F.lit("fr")
    for holds, f, lang in reversed(rules):
        family, language = F.when(holds, f).otherwise(family), F.when(holds, lang).otherwise(language)
    return family, language


def report_period(name: Column, family: Column) -> Column:
    """YYYY-MM of monthly reports, YYYY or a range of years of others; empty if no year is found."""
    low = F.lower(name)
    four, two = F.regexp_extract(name, r"(20\d\d)", 1), F.regexp_extract(low, r"-(\d\d)(\.pdf)?$", 1)
    year = F.when(four != "", four).when(two != "", F.concat(F.lit("20"), two)).otherwise("")
    month = F.lit(None).cast("int")
    for word, number in reversed(MONTHS_FR.items()):
        month = F.when(low.rlike(f"(?<![a-zéû]){word}(?![a-zéû])"), number).otherwise(month)
    arabic = F.lit(None).cast("int")
    for word, number in reversed(MONTHS_AR.items()):
        arabic = F.when(name.contains(word), number).otherwise(arabic)
    month = F.when(name.rlike(ARABIC), arabic).otherwise(month)
    month = F.when(low.rlike(r"fin[_\s]+d[eé]cembre|(?<![a-z0-9_])d[eé]cembre(?![a-z0-9_])") | name.contains(YEAR_AR), 12).otherwise(month)
    dated = F.when((year != "") & month.isNotNull(), F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"))).otherwise(year)
    span = F.regexp_extract(name, r"(20\d\d)[-_]+(20\d\d)", 0)
    return F.when(family.isin("Conjoncture", "Bulletin-COVID"), dated).when(span != "", F.regexp_replace(span, "[-_]+", "-")).otherwise(year)


def version(name: Column) -> Column:
    """Revision marks of a file name, each once, in a fixed order, joined by `|`."""
    stem = F.regexp_replace(name, r"(?i)\.pdf$", "")
    marks = F.array(*[F.regexp_replace(F.regexp_extract(stem, p, 1), "^[-_ ]+|[-_ ]+$", "") for p in VERSIONS])
    return F.array_join(F.array_distinct(F.filter(marks, lambda m: m != "")), "|")


def document_type(path: Column) -> Column:
    low = F.lower(path)
    rules = []
    for words, kind in DOC_TYPES:
        holds = F.lit(False)
        for w in words:
            holds = holds | low.contains(w)
        rules.append((holds, kind))
    return first_rule(rules, "other")


def archive_versions(fetched: DataFrame, url: str = "url", digest: str = "sha256", order: str = "fetched_at") -> DataFrame:
    """New content of each address, numbered: equal content is archived once, other content of an address is a new version."""
    w = Window.partitionBy(url, digest).orderBy(order)
    firsts = fetched.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    return firsts.withColumn("version_no", F.row_number().over(Window.partitionBy(url).orderBy(order, digest)))


def with_source_ids(manifest: DataFrame, order: list[str]) -> DataFrame:
    """Manifest rows with their source_id; of several rows of one id all but the first have the start of their file id behind it."""
    own = source_id(F.col("report_family"), F.col("period"), F.col("version"), F.col("language"), F.col("local_path"))
    again = F.row_number().over(Window.partitionBy("source_id").orderBy(*order)) > 1
    return manifest.withColumn("source_id", own).withColumn("source_id", F.when(again, F.concat("source_id", F.lit("_"), F.substring("file_id", 1, 6))).otherwise(F.col("source_id")))


def register_sources(manifest: DataFrame) -> DataFrame:
    """Manifest rows as sources: cadence, canonical language, cutoff; the publication date is not known."""
    cadence = F.element_at(F.create_map(*[F.lit(x) for pair in CADENCE.items() for x in pair]), F.col("report_family"))
    return manifest.withColumns({
        "cadence": F.coalesce(cadence, F.lit("annual")),
        "is_canonical_lang": F.col("language").isin("fr", "multi", "en"),
        "cutoff_month": F.when(F.col("period").rlike(r"^\d{4}-\d{2}$"), F.substring("period", 6, 2).cast("int")),
        "publication_date": F.lit(None).cast("date"),
    })


def update_manifest(spark: SparkSession, path: str, fetched: DataFrame, order: list[str], state: int) -> DataFrame:
    """The manifest after `fetched`: one row an address, the last fetched, written whole and sorted as state number `state`.

    States stand side by side in folders, so the one before is still there while the new one is written.
    """
    folder = lambda n: f"{path}/state={n}"
    rows = fetched if state == 0 else spark.read.schema(fetched.schema).parquet(folder(state - 1)).unionByName(fetched)
    last = Window.partitionBy("url").orderBy(F.col("fetched_at").desc(), F.col("sha256"))
    kept = rows.withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth")
    kept.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(folder(state))
    return spark.read.schema(fetched.schema).parquet(folder(state))


def append_log(events: DataFrame, path: str, run: int) -> None:
    """Adds a run's events to the log; the same run written again replaces its own."""
    events.write.mode("overwrite").json(f"{path}/run={run}")


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small report as one file: csv with a header, json lines, or a markdown table."""
    one = df.coalesce(1)
    if kind == "md":
        line = lambda cols: F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cols]), F.lit(" |"))
        names = df.columns
        head = df.sparkSession.createDataFrame([("| " + " | ".join(names) + " |",), ("|" + "---|" * len(names),)], "value string").coalesce(1)
        head.union(one.select(line(names).alias("value"))).coalesce(1).write.mode("overwrite").text(path)
    elif kind == "json":
        one.write.mode("overwrite").json(path)
    else:
        one.write.mode("overwrite").csv(path, header=True)
