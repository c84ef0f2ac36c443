"""Whole pages: stacked tables from words to cells, and anchors of an edition moved to where its header stands.

A page's words meet once, as one array; everything else is folds and filters over that array, in columns. Pages are
independent, and nothing needs more than one page at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import looks_numeric, norm_label
from .extraction import BLOCK_GAP, CELL_TOLERANCE, COLUMN_GAP, FIRST_ROW, ROLES, ROW_GAP, SAME_ROW

# How near to a row its words stand, numbers that an anchor row has at least, and where a next block's words begin.
ANCHOR_BAND, CELL_BAND, LABEL_BAND, VALUE_BAND = 5.0, 6.0, 9.0, 16.0
LEAST_NUMBERS, LEAST_COLUMNS, NEXT_BLOCK, ABOVE_BLOCK = 4, 3, 8.0, 6.0
BEFORE_CELLS, BEHIND_CELLS, BEFORE_LABEL, NO_COLUMN = 20.0, 20.0, 6.0, 260.0
ALL_ROLES = ROLES[5]


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """The frame with some columns that are computed once a row: a row goes through a generator, behind which the optimizer
    can't put their expressions in place of their names, once for each use and once for each word in a filter."""
    made = F.struct(*[v.alias(k) for k, v in columns.items()])
    return df.select("*", F.explode(F.array(made)).alias("__once")).select(*df.columns, "__once.*")


def page_words(words: DataFrame) -> DataFrame:
    """(page, words): each page's words(y, x0, x1, text, label, number) in order."""
    word = F.struct("y", "x0", "x1", "text", norm_label(F.col("text")).alias("label"), looks_numeric(F.col("text")).alias("number"))
    return words.groupBy("page").agg(F.sort_array(F.collect_list(word)).alias("words"))


def spaced(ys: Column, gap: float) -> Column:
    """Of sorted numbers those that are more than `gap` beyond the last one kept."""
    return F.aggregate(ys, F.array().cast("array<double>"), lambda a, v: F.when((F.size(a) == 0) | (v - F.get(a, F.size(a) - 1) > gap), F.array_append(a, v)).otherwise(a))


def rounded(words: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.round(w["y"], 1).cast("double"))))


def block_tops(words: Column, label: Column) -> Column:
    """The tops of a page's blocks: rows led by the label, or its first word, that carry enough numbers, one a block."""
    first = F.substring_index(label, " ", 1)
    led = rounded(F.filter(words, lambda w: (w["label"] == first) | w["label"].startswith(label)))
    numbers = F.filter(words, lambda w: w["number"])
    full = F.filter(led, lambda y: F.size(F.filter(numbers, lambda w: F.abs(w["y"] - y) <= ANCHOR_BAND)) >= LEAST_NUMBERS)
    return spaced(full, BLOCK_GAP)


def column_spots(words: Column, y: Column) -> Column:
    """The columns (role, x) of the numbers around a row, from left to right: fragments less than a gap apart are one."""
    numbers = F.filter(words, lambda w: (F.abs(w["y"] - y) <= ANCHOR_BAND) & (w["number"] | w["text"].startswith("-")))
    edges = F.array_sort(F.transform(numbers, lambda w: F.struct(w["x0"].alias("a"), w["x1"].alias("b"), w["text"].alias("t"))))
    empty = F.array().cast("array<struct<a:double,b:double>>")

    def join(runs: Column, w: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        grown = F.array_append(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.struct(last["a"].alias("a"), w["b"].cast("double").alias("b")))
        own = F.struct(w["a"].cast("double").alias("a"), w["b"].cast("double").alias("b"))
        return F.when((F.size(runs) > 0) & (w["a"] - last["b"] <= COLUMN_GAP), grown).otherwise(F.array_append(runs, own))

    def named(runs: Column) -> Column:
        roles = F.when(F.size(runs) >= 5, F.array(*[F.lit(r) for r in ALL_ROLES])).when(F.size(runs) == 4, F.array(*[F.lit(r) for r in ROLES[4]])).otherwise(F.array(*[F.lit(r) for r in ROLES[3]]))
        made = F.transform(runs, lambda r, i: F.struct(F.get(roles, i).alias("role"), ((r["a"] + r["b"]) / 2).alias("x"), F.size(runs).alias("of")))
        return F.filter(made, lambda c: c["role"].isNotNull())

    return let(F.aggregate(edges, empty, join), named)


def row_places(words: Column, top: Column, bottom: Column, x: Column) -> Column:
    """The rows of a block from its top down: where its first column has numbers, up to the first gap."""
    values = F.filter(words, lambda w: (w["y"] >= top - 4) & (w["y"] <= bottom) & (F.abs((w["x0"] + w["x1"]) / 2 - x) <= VALUE_BAND) & w["number"])
    start = F.struct(F.array().cast("array<double>").alias("ys"), F.lit(False).alias("over"))

    def step(a: Column, y: Column) -> Column:
        none, last = F.size(a["ys"]) == 0, F.get(a["ys"], F.size(a["ys"]) - 1)
        takes = ~a["over"] & F.when(none, F.abs(y - top) <= FIRST_ROW).otherwise(y - last <= ROW_GAP)
        return F.struct(F.when(takes, F.array_append(a["ys"], y)).otherwise(a["ys"]).alias("ys"), (a["over"] | ~none & ~takes).alias("over"))

    return F.aggregate(spaced(rounded(values), SAME_ROW), start, step, lambda a: a["ys"])


def _is(field: str, value: str):
    return lambda x: x[field] == value


def segment(words: DataFrame, specs: DataFrame) -> DataFrame:
    """(ref, page, block, top, row_y, label, columns, role, token): the cells of the tables that specs(ref, page, anchor_label, block) name.

    `block` counts the stacked tables of the page from 0. A block runs from its anchor row to the next block or the first
    gap; words left of its first column make the label, others the cell of the nearest column, the first on ties.
    """
    found = page_words(words).join(once(specs, anchor=norm_label(F.col("anchor_label"))), "page")
    found = once(found, tops=block_tops(F.col("words"), F.col("anchor")))
    found = once(found.withColumn("top", F.get("tops", F.col("block"))).where("top is not null"), spots=column_spots(F.col("words"), F.col("top")))
    found = found.where(F.size("spots") >= LEAST_COLUMNS)
    place = lambda *roles: F.coalesce(*[F.get(F.filter("spots", _is("role", r)), F.lit(0))["x"] for r in roles])
    below = F.filter("tops", lambda t: t > F.col("top") + NEXT_BLOCK)
    found = once(found, real_x=place("real"), columns=F.get("spots", F.lit(0))["of"], bottom=F.coalesce(F.array_min(below) - ABOVE_BLOCK, F.lit(1e9)))
    found = once(found, last_x=F.coalesce(place("tcam", "var", "c"), F.col("real_x") + NO_COLUMN) + BEHIND_CELLS)
    rows = found.withColumn("row_y", F.explode(row_places(F.col("words"), F.col("top"), F.col("bottom"), F.col("real_x"))))
    near = lambda band: F.filter("words", lambda w: F.abs(w["y"] - F.col("row_y")) <= band)
    by_x = lambda ws: F.array_sort(F.transform(ws, lambda w: F.struct(w["x0"], w["y"], w["text"], w["x1"])))
    left = F.filter(near(LABEL_BAND), lambda w: (w["x0"] < F.col("real_x") - BEFORE_LABEL) & ~w["number"])
    rows = once(rows, label=F.trim(F.array_join(F.transform(by_x(left), lambda w: w["text"]), " "))).where("label <> ''")
    centre = lambda w: (w["x0"] + w["x1"]) / 2
    inside = F.filter(near(CELL_BAND), lambda w: (centre(w) >= F.col("real_x") - BEFORE_CELLS) & (centre(w) <= F.col("last_x")))

    def column_of(w: Column) -> Column:
        best = F.array_min(F.transform("spots", lambda c, i: F.struct(F.abs(centre(w) - c["x"]).alias("d"), i.alias("i"), c["role"].alias("role"))))
        return F.when(best["d"] <= CELL_TOLERANCE, best["role"])

    placed = F.transform(by_x(inside), lambda w: F.struct(w["text"].alias("text"), column_of(w).alias("role")))
    rows = once(rows, placed=placed).withColumn("role", F.explode(F.array_distinct(F.filter(F.transform("placed", lambda p: p["role"]), lambda r: r.isNotNull()))))
    token = F.array_join(F.transform(F.filter("placed", lambda p: p["role"] == F.col("role")), lambda p: p["text"]), "")
    return rows.select("ref", "page", "block", "top", "row_y", "label", "columns", "role", token.alias("token"))


def _is_not(field: str, value: str):
    return lambda x: x[field] != value


def _says(form: str):
    return lambda w: (w["label"] == form) | F.contains(w["text"], F.lit(form))


def reanchored(words: DataFrame, templates: DataFrame, pages: DataFrame, distinctive: dict[str, str], only_if: dict[str, tuple[str, ...]], band: tuple[float, float]) -> DataFrame:
    """(page, column, ord, x): the columns of a template where a page's header has them.

    templates(template, ord, column, x); pages(page, template, y): the row below the header, whose words stand between
    `band` above it. A column with a word of its own in the header (`distinctive`: normalised word, column) stands where the
    first such word does, the others move by the upper median of what those moved. Columns of `only_if` are dropped unless
    one of their words (or a part of one) is in the header.
    """
    heads = page_words(words).join(pages, "page").withColumn("header", F.filter("words", lambda w: (w["y"] > F.col("y") - band[0]) & (w["y"] < F.col("y") - band[1])))
    pairs = F.create_map(*[F.lit(x) for kv in distinctive.items() for x in kv])
    seen = F.transform("header", lambda w: F.struct(F.element_at(pairs, w["label"]).alias("column"), ((w["x0"] + w["x1"]) / 2).alias("x")))
    listed = templates.groupBy("template").agg(F.sort_array(F.collect_list(F.struct("ord", "column", "x"))).alias("base"))
    both = heads.withColumn("seen", F.filter(seen, lambda s: s["column"].isNotNull())).join(listed, "template")
    for column, forms in only_if.items():
        shown = reduce(lambda a, b: a | b, [F.exists("header", _says(f)) for f in forms])
        both = both.withColumn("base", F.when(shown, F.col("base")).otherwise(F.filter("base", _is_not("column", column))))
    first = lambda b: F.get(F.filter("seen", lambda s: s["column"] == b["column"]), F.lit(0))["x"]
    both = both.withColumn("met", F.transform("base", lambda b: F.struct(b["ord"], b["column"], b["x"].alias("x"), first(b).alias("found"))))
    drifts = F.array_sort(F.transform(F.filter("met", lambda b: b["found"].isNotNull()), lambda b: b["found"] - b["x"]))
    both = both.withColumn("drift", let(drifts, lambda d: F.coalesce(F.get(d, F.floor(F.size(d) / 2).cast("int")), F.lit(0.0))))
    return both.select("page", F.explode("met").alias("b"), "drift").select("page", "b.column", "b.ord", F.coalesce("b.found", F.col("b.x") + F.col("drift")).alias("x"))
