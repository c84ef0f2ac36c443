"""Text and number functions over columns."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Accented Latin letters and their bases, no-break spaces, and words for scopes.
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
NO_BREAK = "\u00a0\u2009\u202f"
DASHES = ("-", "_", "—", "–")
SCOPES = {
    "gas": "natural gas", "natural gas": "natural gas", "gaz": "natural gas", "gaz naturel": "natural gas", "naturalgas": "natural gas",
    "crude": "crude oil quality", "crude oil": "crude oil quality", "crudeoil": "crude oil quality", "oil": "crude oil quality",
    "petrole brut": "crude oil quality", "petrole": "crude oil quality", "crude oil quality": "crude oil quality", "crude oil map": "crude oil MAP",
    "electricity": "electricity", "elec": "electricity", "electricite": "electricity", "power": "electricity",
    "volume": "volume", "vol": "volume",
    "product": "product tep/t", "products": "product tep/t", "petroleum product": "product tep/t", "petroleum products": "product tep/t", "produits petroliers": "product tep/t",
}


def fold_latin(text: Column) -> Column:
    """Latin letters without their accents, inside the JVM."""
    return F.translate(text, ACCENTED, PLAIN)


@F.pandas_udf(StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    """Exact for every script: decompose, drop combining marks. Null stays null."""
    return text.map(lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"), na_action="ignore")


def norm_label(text: Column, exact: bool = False) -> Column:
    """A label for matching: no accents, lower case, letters, digits and underscores, single spaces; null is empty."""
    plain = F.translate(text, NO_BREAK, "   ")
    plain = F.lower(strip_accents(plain) if exact else fold_latin(plain))
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(plain, F.lit("")), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def parse_number(text: Column) -> Column:
    """The double that a printed number stands for, else null: dashes, blanks and anything that is no plain decimal.

    A comma is a decimal point, unless there is a point too: then commas group thousands. Every comma counts, so
    `1,234,567` is no number.
    """
    bare = F.trim(F.translate(F.trim(F.translate(text, NO_BREAK, "   ")), " ", ""))
    dotted = F.when(bare.contains(",") & bare.contains("."), F.translate(bare, ",", "")).otherwise(F.translate(bare, ",", "."))
    number = dotted.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(~bare.isin("", *DASHES) & number, dotted.try_cast("double"))


def looks_numeric(text: Column) -> Column:
    return F.coalesce(F.translate(text, ",.%-+ " + NO_BREAK, "").rlike("^[0-9]+$"), F.lit(False))


def scope_key(text: Column) -> Column:
    """A free scope word in the form that SCOPES is keyed by."""
    low = F.translate(F.lower(F.trim(text)), "éèêà_-/", "eeea   ")
    return F.trim(F.regexp_replace(low, " +", " "))


def canonical_scope(text: Column) -> Column:
    """The stored scope for a free word; null if it is not known."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in SCOPES.items() for x in pair]), scope_key(text))


def expand(query: Column, synonyms: dict[str, str]) -> Column:
    """The query with the canonical words of every synonym that it contains, in the order of `synonyms`."""
    found = F.array(*[F.when(query.contains(k), F.lit(v)) for k, v in synonyms.items()])
    extra = F.array_join(F.array_compact(found), " ")
    return F.when(extra == "", query).otherwise(F.concat_ws(" ", query, extra))


def terms(query: Column) -> Column:
    """Search terms: lower case, apostrophes and hyphens as spaces, words of two letters and more; repeats stay."""
    return F.filter(F.split(F.translate(F.lower(query), "'-", "  "), r"\s+"), lambda t: F.length(t) > 1)


def label(language: str, labels: dict[str, Column], id_col: Column) -> Column:
    """The label in the language asked for, else English, else French, else the id; empty counts as missing."""
    order = dict.fromkeys((language, "en", "fr"))
    return F.coalesce(*[F.when(labels[x] != "", labels[x]) for x in order if x in labels], id_col)


def approx(a: Column, b: Column, least: float = 1.0, share: float = 0.01) -> Column:
    """|a - b| within the larger of `least` and `share` of the larger; null is not approximate to anything."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(least), share * F.greatest(F.abs(a), F.abs(b))), F.lit(False))


def decimal_text(number: Column, places: int = 2) -> Column:
    """A number rounded to `places` (one at least) as text without an exponent, of trailing zeros only the first place's: `35242386.5`, `7.0`."""
    digits = F.round(number, places).cast(f"decimal(38, {places})").cast("string")
    return F.regexp_replace(digits, r"(\.\d+?)0+$", "$1")


def first_rule(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The value of the first rule that holds."""
    out = F.lit(otherwise)
    return reduce(lambda rest, rule: F.when(rule[0], F.lit(rule[1])).otherwise(rest), reversed(rules), out)
