"""Requests as tables: many questions to the interface answered by one plan each.

A table of requests is joined with the series that it names; each answer is one row with its status, so that the three
kinds of empty (unknown, out of scope, in scope without data) come from the same plan as the values. The answers are what
`api.Store` gives to one request at a time. A request holds no more than a series' observations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import api

#: Columns that a request may leave out, with what that means.
OPTIONAL = {"period_type": "string", "start_year": "int", "end_year": "int", "include_low": "boolean", "include_escalated": "boolean", "exclude_provisional": "boolean", "cutoff_month": "int"}
UNSETTLED = ("provisional", "estimated")


def family_of(query: Column, deferred: list[tuple[str, str, bool]]) -> Column:
    """The family that is not covered and that the text asks for: by phrases first, then by whole words."""
    low = F.lower(query)
    words = F.concat(F.lit(" "), F.regexp_replace(F.translate(low, "'-", "  "), r"\s+", " "), F.lit(" "))
    rules = [(F.contains(low, F.lit(p)), f) for p, f, whole in deferred if not whole] + [(F.contains(words, F.lit(f" {p} ")), f) for p, f, whole in deferred if whole]
    return reduce(lambda rest, r: F.when(r[0], F.lit(r[1])).otherwise(rest), reversed(rules), F.lit(None).cast("string"))


def completed(requests: DataFrame) -> DataFrame:
    have = set(requests.columns)
    return requests.withColumns({c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in have})


def series(requests: DataFrame, obs: DataFrame, catalog: DataFrame, deferred: list[tuple[str, str, bool]] = ()) -> DataFrame:
    """(rid, series_id, status, n, hidden_by_default, family, observations) for requests(rid, series_id, ...).

    `observations` are envelopes by period type and dates. Of a request with cutoff_month only that month's are shown.
    """
    asked = completed(requests).withColumnRenamed("series_id", "asked")
    on = (
        (F.col("series_key") == F.col("asked"))
        & (F.col("ask_type").isNull() | (F.col("period_type") == F.col("ask_type")))
        & (F.col("start_year").isNull() | (F.col("ref_year") >= F.col("start_year")))
        & (F.col("end_year").isNull() | (F.col("ref_year") <= F.col("end_year")))
        & (~F.coalesce("exclude_provisional", F.lit(False)) | ~F.col("data_status").isin(*UNSETTLED))
    )
    live = obs.where("is_preferred")
    rows = api.envelope(live)
    enveloped = F.struct(*rows.columns)
    names = F.struct("period_type", "period_start", "period_end", enveloped.alias("row"))
    source = rows.withColumn("entry", names).select("series_key", "period_type", "ref_year", "data_status", "extraction_confidence", "is_escalated", "ytd_cutoff_month", "entry")
    joined = asked.withColumnRenamed("period_type", "ask_type").join(source, on, "left")
    shown = (F.coalesce("include_low", F.lit(False)) | (F.col("extraction_confidence") != "low")) & (F.coalesce("include_escalated", F.lit(False)) | ~F.col("is_escalated"))
    in_month = F.col("cutoff_month").isNull() | (F.col("ytd_cutoff_month") == F.col("cutoff_month"))
    grouped = joined.groupBy("rid", "asked").agg(
        F.count("series_key").alias("hidden"), F.count_if(shown & F.col("series_key").isNotNull()).alias("visible"),
        F.array_sort(F.collect_list(F.when(shown & in_month, F.col("entry")))).alias("entries"),
    )
    known = catalog.select(F.col("series_key").alias("asked"), F.lit(True).alias("known")).distinct()
    out = grouped.join(known, "asked", "left").withColumn("family", F.when(F.col("known").isNull(), family_of(F.col("asked"), list(deferred))))
    n = F.size("entries")
    empty = F.when(F.col("known"), "empty_in_scope").when(F.col("family").isNotNull(), "out_of_scope").otherwise("unknown_series")
    status = F.when(n > 0, "ok").otherwise(F.when(F.col("visible") > 0, "empty_in_scope").otherwise(empty))
    return out.select(
        "rid", F.col("asked").alias("series_id"), status.alias("status"), n.cast("long").alias("n"),
        F.when((n == 0) & (F.col("visible") == 0) & F.col("known"), F.col("hidden")).alias("hidden_by_default"), "family", F.transform("entries", lambda e: e["row"]).alias("observations"),
    )


def observation(requests: DataFrame, obs: DataFrame, catalog: DataFrame, deferred: list[tuple[str, str, bool]] = ()) -> DataFrame:
    """The same for requests(rid, series_id, year, cutoff_month): one year, with a note where several values match."""
    asked = requests.withColumns({"start_year": F.col("year"), "end_year": F.col("year")}).drop("year")
    out = series(asked, obs, catalog, deferred)
    return out.withColumn("note", F.when(F.col("n") > 1, "several observations match; they differ in period or cutoff"))


def describe(requests: DataFrame, catalog: DataFrame, obs: DataFrame, footnotes: DataFrame | None = None, glossary: DataFrame | None = None) -> DataFrame:
    """(rid, series_id, status, series, footnotes, glossary): the catalog's row, the distinct footnotes, and the glossary of its tokens."""
    rows = catalog.select(F.col("series_key").alias("series_id"), F.struct(*catalog.columns).alias("series"))
    out = requests.select("rid", "series_id").join(rows, "series_id", "left").withColumn("status", F.when(F.col("series").isNull(), "unknown_series").otherwise("ok"))
    nothing = F.array().cast("array<struct<footnote_id:string,text:string>>")
    if footnotes is not None:
        wanted = requests.select(F.col("series_id").alias("series_key")).distinct()
        own = obs.join(wanted, "series_key", "left_semi").select("series_key", "observation_id").join(footnotes, "observation_id")
        notes = own.groupBy(F.col("series_key").alias("series_id")).agg(F.array_sort(F.collect_set(F.struct("footnote_id", "text"))).alias("footnotes"))
        out = out.join(notes, "series_id", "left").withColumn("footnotes", F.when(F.col("status") == "ok", F.coalesce("footnotes", nothing)))
    else:
        out = out.withColumn("footnotes", F.when(F.col("status") == "ok", nothing))
    if glossary is None:
        return out.withColumn("glossary", F.array().cast("array<struct<attribute:string,token:string>>")).select("rid", "series_id", "status", "series", "footnotes", "glossary")
    pairs = [F.struct(F.lit(c).alias("attribute"), F.col(f"series.{c}").alias("token")) for c in (*api.TWINS, "aggregation_role") if c in catalog.columns]
    tokens = out.where("status = 'ok'").select("rid", F.explode(F.array(*pairs)).alias("t")).select("rid", "t.*")
    found = tokens.join(glossary, ["attribute", "token"]).groupBy("rid").agg(F.array_sort(F.collect_set(F.struct(*glossary.columns))).alias("glossary"))
    return out.join(found, "rid", "left").select("rid", "series_id", "status", "series", "footnotes", F.when(F.col("status") == "ok", F.coalesce("glossary", F.array().cast(found.schema["glossary"].dataType))).alias("glossary"))
