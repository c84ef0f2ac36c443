"""From positioned words of a page to cells: grouping, anchoring, clustering, periods and totals.

Words are rows (page, y, x0, x1, text). Pages are independent, so every operator works per page and a page's words meet
in one task; nothing needs more than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import month_end
from ..functions.text import norm_label

# How far apart words, columns and rows may be, and roles of columns by their number.
CELL_TOLERANCE, COLUMN_GAP, ROW_GAP, BLOCK_GAP, FIRST_ROW, SAME_ROW = 27.0, 14.0, 30.0, 30.0, 6.0, 3.0
ROLES = {5: ("real", "a", "b", "c", "var", "tcam"), 4: ("real", "b", "c", "var"), 3: ("real", "b", "c")}


def lines(words: DataFrame) -> DataFrame:
    """One row a line: words with the same rounded y, joined from left to right."""
    grouped = words.groupBy("page", F.round("y", 1).alias("line_y")).agg(F.sort_array(F.collect_list(F.struct("x0", "text"))).alias("w"))
    return grouped.select("page", "line_y", F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("line"))


def band(words: DataFrame, y: float, tolerance: float) -> DataFrame:
    return words.where(F.abs(F.col("y") - y) <= tolerance)


def find_row(found: DataFrame, label: str) -> DataFrame:
    """(page, line_y): the topmost line whose label starts with or contains `label`, both normalised."""
    want = norm_label(F.lit(label))
    own = norm_label(F.col("line"))
    return found.where(own.startswith(want) | own.contains(want)).groupBy("page").agg(F.min("line_y").alias("line_y"))


def nearest_anchor(words: DataFrame, anchors: DataFrame, tolerance: float = CELL_TOLERANCE) -> DataFrame:
    """The words with the column of the nearest anchor(ord, column, x); the first anchor wins ties; too far is dropped.

    Anchors with a column `page` are those of that page and meet its words in an equi-join, as one array a page; without
    it they are of one layout that all pages share, a handful. No row is multiplied.
    """
    centre = (F.col("x0") + F.col("x1")) / 2
    if "page" in anchors.columns:
        own = anchors.groupBy("page").agg(F.collect_list(F.struct("ord", "column", "x")).alias("spots"))
        best = F.array_min(F.transform("spots", lambda a: F.struct(F.abs(centre - a["x"]).alias("d"), a["ord"].alias("o"), a["column"].alias("c"))))
        near = words.join(own, "page").withColumn("near", best).drop("spots")
        return near.where(F.col("near.d") <= tolerance).withColumn("column", F.col("near.c")).drop("near")
    table = anchors.agg(F.sort_array(F.collect_list(F.struct("ord", "column", "x"))).alias("anchors")).first()
    spots = [(a["ord"], a["column"], a["x"]) for a in table["anchors"]]
    if not spots:
        return words.withColumn("column", F.lit(None).cast("string")).limit(0)
    best = F.array_min(F.array(*[F.struct(F.abs(centre - x).alias("d"), F.lit(o).alias("o"), F.lit(c).alias("c")) for o, c, x in spots]))
    near = words.withColumn("near", best)
    return near.where(F.col("near.d") <= tolerance).withColumn("column", F.col("near.c")).drop("near")


def cells(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """The text of each cell: its fragments from left to right, without spaces, so that 4 and 702 are 4702."""
    grouped = assigned.groupBy(*keys, "column").agg(F.sort_array(F.collect_list(F.struct("x0", "text"))).alias("w"))
    return grouped.select(*keys, "column", F.array_join(F.transform("w", lambda w: w["text"]), "").alias("cell"))


def clusters(df: DataFrame, keys: list[str], start: str, end: str, gap: float, order: list[str] | None = None) -> DataFrame:
    """A column `cluster` numbering runs from 0: a new one begins where `start` is more than `gap` beyond the last `end`."""
    w = Window.partitionBy(*keys).orderBy(start, *(order or []))
    fresh = F.when(F.col(start) - F.lag(end).over(w) > gap, 1).otherwise(0)
    return df.withColumn("fresh", fresh).withColumn("cluster", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def column_centres(words: DataFrame, keys: list[str], gap: float = COLUMN_GAP) -> DataFrame:
    """(keys, cluster, centre): columns by gaps between words; a centre is midway from the first start to the last end."""
    runs = clusters(words, keys, "x0", "x1", gap)
    return runs.groupBy(*keys, "cluster").agg(((F.min("x0") + F.max("x1")) / 2).alias("centre"))


def column_role(count: Column, number: Column) -> Column:
    """The role of column `number` (from 1) on a table of `count` columns."""
    roles = {n: F.array(*[F.lit(r) for r in names]) for n, names in ROLES.items()}
    return F.try_element_at(F.when(count >= 5, roles[5]).when(count == 4, roles[4]).otherwise(roles[3]), number)


def header_years(found: DataFrame) -> DataFrame:
    """(page, ytd_years, real_year): the line with most years gives the year-to-date ones; another year is the full one's."""
    years = F.transform(F.regexp_extract_all("line", F.lit(r"\b(20\d\d)\b"), F.lit(1)), lambda y: y.cast("int"))
    counted = found.withColumn("years", years).where(F.size("years") > 0)
    best = counted.groupBy("page").agg(F.max_by("years", F.struct(F.size("years").alias("n"), (-F.col("line_y")).alias("y"))).alias("ytd_years"), F.flatten(F.collect_list("years")).alias("all"))
    others = F.array_sort(F.array_except("all", "ytd_years"))
    return best.select("page", "ytd_years", F.try_element_at(others, F.lit(1)).alias("real_year"))


def header_month(text: Column, months: dict[str, int]) -> Column:
    """The month of the longest month name in the text."""
    out = F.lit(None).cast("int")
    for name, number in sorted(months.items(), key=lambda x: (len(x[0]), x[0])):
        out = F.when(F.lower(text).contains(name), F.lit(number)).otherwise(out)
    return out


def period(role: Column, real_year: Column, ytd_years: Column, cutoff: Column, count: Column) -> Column:
    """A struct (period_type, period_start, period_end, ref_year, cutoff) for a column's role; null for changes and rates.

    Tables of fewer than five columns have no base year: their two year-to-date columns are the last two years.
    """
    month = F.coalesce(cutoff, F.lit(4))
    last = lambda k: F.try_element_at(ytd_years, F.lit(k))
    wide = F.when(role == "a", last(1)).when(role == "b", last(2)).when(role == "c", last(3))
    narrow = F.when(role == "b", F.coalesce(last(-2), last(-1))).when(role == "c", last(-1))
    year = F.when(role == "real", real_year).when(count >= 5, wide).otherwise(narrow)
    full = role == "real"
    made = F.struct(
        F.when(full, "annual").otherwise("ytd_cumulative").alias("period_type"),
        F.make_date(year, F.lit(1), F.lit(1)).alias("period_start"),
        F.when(full, F.make_date(year, F.lit(12), F.lit(31))).otherwise(month_end(year, month)).alias("period_end"),
        year.alias("ref_year"),
        F.when(~full, month).alias("cutoff"),
    )
    return F.when(role.isin("real", "a", "b", "c") & year.isNotNull(), made)


def collapse_rows(ys: DataFrame, keys: list[str], within: float = SAME_ROW) -> DataFrame:
    """Row positions without those within `within` of the last one kept: a fold over a page's rows in order."""
    sorted_ = F.array_sort(F.collect_set(F.col("y").cast("double")))
    kept = F.aggregate("ys", F.array().cast("array<double>"), lambda a, v: F.when((F.size(a) == 0) | (v - F.get(a, F.size(a) - 1) > within), F.array_append(a, v)).otherwise(a))
    return ys.groupBy(*keys).agg(sorted_.alias("ys")).select(*keys, F.explode(kept).alias("y"))


def contiguous(rows: DataFrame, keys: list[str], anchor: Column, gap: float = ROW_GAP, first: float = FIRST_ROW) -> DataFrame:
    """The rows from the first within `first` of the anchor down to the first gap over `gap`."""
    w = Window.partitionBy(*keys).orderBy("y")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    begun = rows.withColumn("on", F.max((F.abs(F.col("y") - anchor) <= first).cast("int")).over(upto)).where("on = 1").drop("on")
    broken = F.when(F.col("y") - F.lag("y").over(w) > gap, 1).otherwise(0)
    return begun.withColumn("broken", broken).withColumn("broken", F.sum("broken").over(upto)).where("broken = 0").drop("broken")


def median_drift(found: DataFrame, keys: list[str], found_x: Column, base_x: Column) -> DataFrame:
    """(keys, drift): the upper median of found minus base positions."""
    drift = F.sort_array(F.collect_list(found_x - base_x))
    return found.groupBy(*keys).agg(drift.alias("d")).select(*keys, F.element_at("d", (F.floor(F.size("d") / 2) + 1).cast("int")).alias("drift"))


def unpivot(matrix: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return matrix.unpivot(keys, columns, name, value).where(F.col(value).isNotNull())


def prefix_rule(labels: DataFrame, label: str, rules: list[tuple[str, str]], out: str) -> DataFrame:
    """A column `out`: the value of the first rule (prefix, value) whose prefix the normalised label starts with."""
    own = norm_label(F.col(label))
    value = F.lit(None).cast("string")
    for prefix, result in reversed(rules):
        value = F.when(own.startswith(norm_label(F.lit(prefix))), result).otherwise(value)
    return labels.withColumn(out, value)


def flag_inconsistent(rows: DataFrame, keys: list[str], value: str, is_part: Column, is_total: Column, least: float = 8.0, share: float = 0.02) -> DataFrame:
    """A column `confidence`, low in groups whose parts do not add up to the printed total."""
    sums = rows.groupBy(*keys).agg(F.sum(F.when(is_part, F.col(value))).alias("parts"), F.max(F.when(is_total, F.col(value))).alias("total"))
    bad = sums.where(F.abs(F.col("parts") - F.col("total")) > F.greatest(F.lit(least), share * F.abs(F.col("total")))).select(*keys).withColumn("bad", F.lit(True))
    return rows.join(bad, keys, "left").withColumn("confidence", F.when(F.col("bad"), "low").otherwise("normal")).drop("bad")


def nth_of(rows: DataFrame, keys: list[str], label: str, order: list[str]) -> DataFrame:
    """A column `nth`: which occurrence of its label a row is, in page order."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, label).orderBy(*order)))


def missing_totals(rows: DataFrame, keys: list[str], value: str, role: str) -> DataFrame:
    """(keys, value, derived): leaf sums of the groups without a printed grand total other than zero."""
    sums = rows.groupBy(*keys).agg(
        F.sum(F.when(F.col(role) == "leaf", F.col(value))).alias("leaves"),
        F.count_if((F.col(role) == "grand_total") & (F.col(value) != 0)).alias("printed"),
    )
    return sums.where("printed = 0 and leaves is not null").select(*keys, F.col("leaves").alias(value), F.lit(True).alias("is_derived"))


def is_grand_total(is_total: Column, flow: Column, main_flow: str, *dimensions: Column) -> Column:
    """A total row without any sub-dimension, whose flow is the table's or none."""
    bare = is_total & (flow.isNull() | (flow == main_flow))
    for d in dimensions:
        bare = bare & (F.coalesce(d, F.lit("")) == "")
    return bare


def resolve(rows: DataFrame, label: str, rules: list[tuple[str, dict[str, str]]], dimensions: list[str]) -> DataFrame:
    """The rows with the dimensions of the first rule whose words stand in the normalised label; no rule gives nulls.

    Rules are tried in order, so a word that is part of another must come after it.
    """
    own = norm_label(F.col(label))
    made = F.lit(None)
    for words, found in reversed(rules):
        values = F.struct(*[F.lit(found.get(d)).cast("string").alias(d) for d in dimensions])
        holds = F.contains(F.concat(F.lit(" "), own, F.lit(" ")), F.concat(F.lit(" "), norm_label(F.lit(words)), F.lit(" ")))
        made = F.when(holds, values).otherwise(made)
    return rows.withColumn("resolved", made).select("*", *[F.col("resolved")[d].alias(d) for d in dimensions]).drop("resolved")


def year_pairs(rows: DataFrame, keys: list[str], prior: str, current: str, year: str) -> DataFrame:
    """(keys, ref_year, value, data_status): a table of two years as long rows, the earlier final, the later provisional."""
    pair = F.array(
        F.struct((F.col(year) - 1).alias("ref_year"), F.col(prior).cast("double").alias("value"), F.lit("final").alias("data_status")),
        F.struct(F.col(year).alias("ref_year"), F.col(current).cast("double").alias("value"), F.lit("provisional").alias("data_status")),
    )
    return rows.select(*keys, F.explode(pair).alias("p")).select(*keys, "p.*").where("value is not null")


def usage_totals(leaves: DataFrame, keys: list[str], parts: str, local: list[str], value: str) -> DataFrame:
    """(keys, scope, value): totals derived from leaves, one over the local parts and one over all, to one decimal."""
    sums = leaves.groupBy(*keys).agg(F.sum(F.when(F.col(parts).isin(*local), F.col(value))).alias("local"), F.sum(value).alias("incl_exports"))
    return sums.unpivot(keys, ["local", "incl_exports"], "scope", "total").where("total is not null").select(*keys, "scope", F.round("total", 1).cast("double").alias("value"), F.lit(True).alias("is_derived"))
