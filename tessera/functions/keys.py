"""Keys, roles, warnings and dates of observations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_rule

# The fields of a series key, in order, and ranks of report types and data statuses.
KEY_FIELDS = ("indicator_id", "flow_id", "product_id", "sector_id", "region_id", "field_id", "level_id", "producer_id", "calorific_basis", "unit_id", "period_type", "redevance_included", "scope", "technology", "regime", "geography_scope")
REPORT_RANK = {"bilan": 3, "memento": 2, "rapport": 2, "conjoncture": 1, "covid_bulletin": 0}
STATUS_RANK = {"final": 3, "revised": 2, "provisional": 1, "estimated": 0}
PRODUCT_SUBTOTALS = ("prod.gasoil", "prod.gasoline", "prod.fuel_oil", "prod.gasoil_ordinaire", "prod.gasoil_ss", "prod.gasoil_premium", "prod.gasoline_ssp", "prod.gasoline_super", "prod.gasoline_premium")
PRODUCER_SUBTOTALS = ("prod.steg",)
#: Months end on these days; there are no leap years here.
MONTH_ENDS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def series_key(have: set[str] | None = None) -> Column:
    """The 16 fields joined by `|`, null being empty; booleans are spelt True and False. `have`: columns there are."""

    def field(name: str) -> Column:
        if have is not None and name not in have:
            return F.lit("")
        col = F.col(name)
        return F.when(col, "True").when(~col, "False").otherwise("") if name == "redevance_included" else F.coalesce(col.cast("string"), F.lit(""))

    return F.concat_ws("|", *[field(x) for x in KEY_FIELDS])


def upsert_key(key: Column, start: Column, end: Column, source: Column) -> Column:
    return F.concat(key, F.lit("#"), iso(start), F.lit("#"), iso(end), F.lit("#"), source)


def iso(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def ranked(col: Column, ranks: dict[str, int]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), col), F.lit(0))


def source_id(family: Column, period: Column, version: Column, language: Column, path: Column) -> Column:
    """<type>_<period>[_version][_ar|_en] of a manifest row."""
    kind = first_rule([((family == "Bilan") & path.contains("Rapport_Bilan"), "rapport"), (family == "Bilan", "bilan"), (family == "Memento", "memento"), (family == "Conjoncture", "conjoncture"), (family == "Bulletin-COVID", "covid_bulletin")], "other")
    version = F.regexp_replace(F.trim(F.coalesce(version, F.lit(""))), "[^A-Za-z0-9]+", "")
    dated = F.translate(F.when(F.coalesce(period, F.lit("")) == "", "undated").otherwise(period), "-", "_")
    return F.concat(kind, F.lit("_"), dated, F.when(version != "", F.concat(F.lit("_"), version)).otherwise(""), F.when(language.isin("ar", "en"), F.concat(F.lit("_"), language)).otherwise(""))


def period_cutoff(period: Column) -> Column:
    """The month of a YYYY-MM period."""
    return F.when(period.rlike(r"^\d{4}-\d{2}$"), F.substring(period, 6, 2).cast("int"))


def ytd_cutoff(period_type: Column, period_end: Column) -> Column:
    return F.when(period_type == "ytd_cumulative", F.month(period_end))


def warnings(confidence: Column, escalated: Column, derived: Column, status: Column) -> Column:
    """What a reader of a value must know, in a fixed order."""
    return F.array_compact(F.array(
        F.when(confidence == "low", "LOW_CONFIDENCE"),
        F.when(escalated, "ESCALATED"),
        F.when(derived, "DERIVED"),
        F.when(status != "final", F.concat(F.lit("DATA_STATUS="), status)),
    ))


def aggregation_role(is_total: Column, flow: Column, product: Column, producer: Column, level: Column, scope: Column, geography: Column, is_grand: Column) -> Column:
    """The role of a row in sums; the first rule that holds decides."""
    filled = lambda c: F.coalesce(c, F.lit(""))
    demand = filled(flow) == "flow.demand"
    return first_rule([
        (~F.coalesce(is_total, F.lit(False)), "leaf"),
        (F.coalesce(is_grand, F.lit(False)), "grand_total"),
        ((filled(level) != "") & demand, "alternative_breakdown"),
        ((filled(scope) == "non_power") & demand, "subtotal"),
        (filled(scope).isin("market_local", "available_local"), "alternative_breakdown"),
        (filled(flow).isin("flow.exchanges_transfers", "flow.export", "flow.import"), "alternative_breakdown"),
        (filled(geography) == "exports_only", "alternative_breakdown"),
        (filled(product).isin(*PRODUCT_SUBTOTALS), "subtotal"),
        (filled(producer).isin(*PRODUCER_SUBTOTALS), "subtotal"),
    ], "grand_total")


def month_end(year: Column, month: Column) -> Column:
    day = F.element_at(F.array(*[F.lit(d) for d in MONTH_ENDS]), month)
    return F.make_date(year, month, day)
