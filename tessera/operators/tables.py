"""The printed tables of the reports: which rows and columns there are, and what a row's label stands for.

Everything that is peculiar to a table stands here as data. Rows of all tables are resolved together: rules by label
first, then the vocabulary of the resolver's dimension; a label that neither knows is set aside.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import looks_numeric, norm_label, parse_number
from . import vocab
from .extraction import BLOCK_GAP, CELL_TOLERANCE

DIMENSIONS = ("indicator_id", "flow_id", "product_id", "field_id", "level_id", "producer_id", "technology", "scope", "geography_scope")

# What labels stand for, by resolver: how the normalised label is compared, with what, and what it sets.
# The first rule that holds decides, so a label that another one begins with comes after it.
DEMAND = [
    ("is", "demande", {"flow_id": "flow.demand", "is_total": True}),
    ("starts", "production d electricite", {"flow_id": "flow.demand", "scope": "power_generation"}),
    ("starts", "hors prod elec", {"flow_id": "flow.demand", "scope": "non_power"}),
    ("starts", "haute pression", {"flow_id": "flow.demand", "level_id": "lvl.hp", "is_total": True}),
    ("starts", "moy basse pression", {"flow_id": "flow.demand", "level_id": "lvl.mbp", "is_total": True}),
    ("starts", "demande", {"flow_id": "flow.demand", "is_total": True}),
]
SOURCES = [
    ("starts", "fuel gasoil", {"technology": "thermal_fuel", "producer_id": "prod.steg"}),
    ("starts", "gaz naturel", {"technology": "thermal_gas", "producer_id": "prod.steg"}),
    ("starts", "hydraulique", {"technology": "hydro", "producer_id": "prod.steg"}),
    ("starts", "eolienne", {"technology": "wind", "producer_id": "prod.steg"}),
    ("starts", "solaire", {"technology": "pv", "producer_id": "prod.steg"}),
    ("starts", "steg", {"producer_id": "prod.steg", "is_total": True}),
    ("starts", "ipp gaz naturel", {"technology": "thermal_gas", "producer_id": "prod.ipp"}),
    ("starts", "ipp solaire", {"technology": "pv", "producer_id": "prod.ipp"}),
    ("starts", "autoproducteurs solaire", {"technology": "pv", "producer_id": "prod.autoproducteurs"}),
    ("starts", "achat tiers", {"producer_id": "prod.tiers"}),
    ("starts", "echanges", {"flow_id": "flow.exchanges_transfers", "is_total": True}),
    ("starts", "exportation", {"flow_id": "flow.export", "is_total": True}),
    ("starts", "importation", {"flow_id": "flow.import", "is_total": True}),
    ("starts", "production pour marche local", {"scope": "market_local", "is_total": True}),
    ("starts", "disponible pour marche local", {"scope": "available_local", "is_total": True}),
    ("starts", "production nationale", {"is_total": True}),
]
LEVELS = [
    ("starts", "total", {"flow_id": "flow.sales", "is_total": True}),
    ("starts", "haute tension", {"flow_id": "flow.sales", "level_id": "lvl.ht"}),
    ("starts", "moyenne tension", {"flow_id": "flow.sales", "level_id": "lvl.mt"}),
    ("starts", "moyen tension", {"flow_id": "flow.sales", "level_id": "lvl.mt"}),
    ("starts", "basse tension", {"flow_id": "flow.sales", "level_id": "lvl.bt"}),
]
PRODUCED = {"indicator_id": "gas_production", "flow_id": "flow.primary_production", "scope": "commercial_dry"}
RESOURCES = {"indicator_id": "gas_resources", "flow_id": "flow.resources", "is_total": True}
GAS_FIELDS = [
    ("starts", "redevance", {"indicator_id": "redevance", "flow_id": "flow.royalty"}),
    ("starts", "achat", {"indicator_id": "gas_purchase", "flow_id": "flow.purchase"}),
    ("starts", "production nationale f", RESOURCES),
    ("has", "nationale f fiscal", RESOURCES),
    ("starts", "ressources", RESOURCES),
    ("starts", "production nationale", PRODUCED | {"is_total": True}),
    ("is", "production", PRODUCED | {"is_total": True}),
    ("starts", "total", PRODUCED | {"is_total": True}),
]
GAS_FLOWS = [
    ("is", "production nationale", {"flow_id": "flow.primary_production"}),
    ("is", "redevance totale", {"flow_id": "flow.royalty"}),
    ("is", "achats", {"flow_id": "flow.purchase"}),
    ("is", "demande totale", {"flow_id": "flow.demand"}),
]
SALES = [
    ("is", "total", {"is_total": True}),
    ("is", "total ventes", {"is_total": True}),
    ("is", "total ventes locales", {"is_total": True}),
    ("starts", "ventes externes", {"flow_id": "flow.sales", "geography_scope": "exports_only", "is_total": True}),
    ("is", "moyen tension", {"flow_id": "flow.sales", "level_id": "lvl.mt", "geography_scope": "local"}),
    ("is", "moyenne tension", {"flow_id": "flow.sales", "level_id": "lvl.mt", "geography_scope": "local"}),
    ("is", "basse tension", {"flow_id": "flow.sales", "level_id": "lvl.bt", "geography_scope": "local"}),
    ("is", "haute tension", {"flow_id": "flow.sales", "level_id": "lvl.ht", "geography_scope": "local"}),
]
OIL_TOTAL = {"product_id": "prod.petroleum_products_total", "is_total": True}
#: resolver: (rules, dimension whose vocabulary knows other labels, what such a row sets besides).
RESOLVERS = {
    "product": ([("is", "total", OIL_TOTAL), ("is", "total produits petroliers", OIL_TOTAL), ("is", "consommation totale", OIL_TOTAL)], "product_id", {}),
    "field": ([("is", "total", {"is_total": True})], "field_id", {}),
    "gas_demand": (DEMAND, None, {}),
    "elec_src": (SOURCES, None, {}),
    "level": (LEVELS, None, {}),
    "gasfield": (GAS_FIELDS, "field_id", PRODUCED),
    "flow_gas": (GAS_FLOWS, None, {}),
    "sales": (SALES, "level_id", {"flow_id": "flow.sales", "geography_scope": "local"}),
}
#: Parts of product lines: their rows are totals, so that the lines alone add up.
PARTS = ("prod.gasoil_ordinaire", "prod.gasoil_ss", "prod.gasoil_premium", "prod.gasoline_ssp", "prod.gasoline_super", "prod.gasoline_premium")

# The tables of two years, as printed.
#: Page, rows from and to, places of the two years, label and cell columns, what the table is of.
YEAR_TABLES_SCHEMA = "ref string, page int, y0 double, y1 double, prior_x double, current_x double, label_min double, label_max double, cell_min double, cell_max double, resolver string, indicator string, unit string, basis string, product string, flow string, table_scope string"
YEAR_TABLES = [
    ("M-T2", 3, 100.0, 300.0, 168.5, 222.3, 0.0, 160.0, 150.0, 270.0, "field", "crude_production", "kt", "NA", "prod.crude_oil", "flow.primary_production", "incl_gpl_condensat"),
    ("M-T6", 5, 85.0, 190.0, 210.0, 255.0, 0.0, 200.0, 200.0, 290.0, "field", "gas_production", "ktep-pci", "PCI", "prod.natural_gas", "flow.primary_production", "commercial_dry"),
    ("M-T5", 5, 262.0, 366.0, 210.0, 255.0, 0.0, 200.0, 200.0, 290.0, "field", "gas_production", "ktep-pcs", "PCS", "prod.natural_gas", "flow.primary_production", "commercial_dry"),
    ("M-T7", 6, 78.0, 120.0, 171.5, 231.9, 0.0, 160.0, 160.0, 275.0, "flow_gas", "gas_resources", "ktep-pci", "PCI", "prod.natural_gas", None, None),
    ("M-T8", 6, 208.0, 250.0, 171.5, 233.0, 0.0, 160.0, 160.0, 275.0, "flow_gas", "gas_resources", "ktep-pcs", "PCS", "prod.natural_gas", None, None),
    ("M-T9", 7, 92.0, 210.0, 172.0, 223.0, 0.0, 160.0, 160.0, 270.0, "product", "pp_export", "ktep", "NA", None, "flow.export", None),
    ("M-T12", 8, 70.0, 190.0, 607.0, 647.0, 455.0, 600.0, 600.0, 710.0, "elec_src", "electricity_production", "GWh", "NA", None, "flow.primary_production", None),
    ("M-T15", 10, 135.0, 285.0, 159.0, 222.0, 0.0, 158.0, 155.0, 270.0, "product", "pp_consumption", "ktep", "NA", None, "flow.consumption", None),
    ("M-T16", 12, 78.0, 185.0, 171.0, 231.0, 0.0, 165.0, 160.0, 275.0, "gas_demand", "gas_demand", "ktep-pci", "PCI", "prod.natural_gas", None, None),
    ("M-T17", 12, 205.0, 320.0, 171.0, 231.0, 0.0, 165.0, 160.0, 275.0, "gas_demand", "gas_demand", "ktep-pcs", "PCS", "prod.natural_gas", None, None),
    ("M-T18", 13, 100.0, 175.0, 182.5, 234.8, 0.0, 175.0, 170.0, 290.0, "sales", "electricity_sales", "GWh", "NA", None, "flow.sales", None),
]


# The footnotes that belong to every value of a table.
YEAR_FOOTNOTES = {
    "M-T2": ("FN-OIL-GPLCOND-INCL",), "M-T5": ("FN-PCI-PCS", "FN-GAS-COMMERCIAL", "FN-GAZSUD-MEMBERS-M"), "M-T6": ("FN-PCI-PCS", "FN-GAS-COMMERCIAL", "FN-GAZSUD-MEMBERS-M"), "M-T7": ("FN-PCI-PCS",), "M-T8": ("FN-PCI-PCS",),
    "M-T12": ("FN-ELEC-NOAUTOTHERM",), "M-T15": ("FN-PP-CONS-AUTOSTIR",), "M-T16": ("FN-PCI-PCS",), "M-T17": ("FN-PCI-PCS",),
}


def footnotes_of(ref: Column, notes: dict[str, tuple[str, ...]] = YEAR_FOOTNOTES) -> Column:
    """The footnotes of a table; none for tables without any."""
    listed = F.create_map(*[x for k, v in notes.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    return F.coalesce(F.element_at(listed, ref), F.array().cast("array<string>"))


def blocks(rows: DataFrame, keys: list[str], y: str = "y", gap: float = BLOCK_GAP) -> DataFrame:
    """(keys, block, y): stacked blocks of a page, from 0 down; a row more than `gap` below the top of the last begins one.

    The gap counts from a block's top, not from the row before, so tops are found by a walk down the page: an array
    folded in one pass, a page's rows at a time.
    """
    ys = rows.where(F.col(y).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_set(F.col(y).cast("double"))).alias("ys"))
    tops = F.aggregate("ys", F.array().cast("array<double>"), lambda a, v: F.when((F.size(a) == 0) | (v - F.get(a, F.size(a) - 1) > gap), F.array_append(a, v)).otherwise(a))
    return ys.select(*keys, F.posexplode(tops).alias("block", "y"))


def _by_rules(own: Column, resolver: Column) -> Column:
    """The struct of what the first rule sets, for each row's own resolver; null if none holds."""
    out = F.lit(None)
    for name, (rules, _, _) in RESOLVERS.items():
        for how, text, found in reversed(rules):
            holds = own == text if how == "is" else own.startswith(text) if how == "starts" else own.contains(text)
            values = F.struct(*[F.lit(found.get(d)).cast("string").alias(d) for d in DIMENSIONS], F.lit(bool(found.get("is_total"))).alias("is_total"))
            out = F.when((resolver == name) & holds, values).otherwise(out)
    return out


def resolve_rows(rows: DataFrame, known: dict[str, DataFrame], label: str = "label", resolver: str = "resolver") -> tuple[DataFrame, DataFrame]:
    """(rows with DIMENSIONS and is_total, rows that no rule and no vocabulary knows).

    `known` has the names (`vocab.names`) of each dimension that a resolver looks labels up in.
    """
    ruled = rows.withColumn("set", _by_rules(norm_label(F.col(label)), F.col(resolver)))
    found = [ruled.where("set is not null").select(*rows.columns, "set.*")]
    left = ruled.where("set is null").drop("set")
    for dimension in sorted({d for _, d, _ in RESOLVERS.values() if d}):
        names = [n for n, (_, d, _) in RESOLVERS.items() if d == dimension]
        hits, _ = vocab.match(left.where(F.col(resolver).isin(*names)), label, known[dimension])
        others = {d: reduce(lambda rest, n, d=d: F.when(F.col(resolver) == n, F.lit(RESOLVERS[n][2].get(d))).otherwise(rest), names, F.lit(None).cast("string")) for d in DIMENSIONS if d != dimension}
        dims = [F.col("id").alias(d) if d == dimension else others[d].alias(d) for d in DIMENSIONS]
        found.append(hits.select(*rows.columns, *dims, F.col("id").isin(*PARTS).alias("is_total")))
    known_rows = reduce(DataFrame.unionByName, found)
    missed = [vocab.match(left.where(F.col(resolver).isin(*[n for n, (_, d, _) in RESOLVERS.items() if d == dimension])), label, known[dimension])[1] for dimension in sorted({d for _, d, _ in RESOLVERS.values() if d})]
    missed.append(left.where(~F.col(resolver).isin(*[n for n, (_, d, _) in RESOLVERS.items() if d])))
    return known_rows, reduce(DataFrame.unionByName, [m.select(*rows.columns) for m in missed])


def year_table_rows(words: DataFrame, specs: DataFrame) -> DataFrame:
    """(ref, line_y, label, year_column, token, resolver, ...): the cells of tables of two years among words(page, y, x0, x1, text).

    A word belongs to the tables of its page whose rows and columns hold it: words left of the cells make the label, the
    others the cell of the nearer year, if that is near enough. Pages and tables meet in an equi-join by page.
    """
    centre = (F.col("x0") + F.col("x1")) / 2
    on_page = words.join(F.broadcast(specs), "page").where((F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))).withColumn("line_y", F.round("y", 1))
    nearer = F.when(F.abs(centre - F.col("prior_x")) <= F.abs(centre - F.col("current_x")), "prior").otherwise("current")
    apart = F.least(F.abs(centre - F.col("prior_x")), F.abs(centre - F.col("current_x")))
    in_cell = (centre >= F.col("cell_min")) & (centre <= F.col("cell_max")) & (apart <= CELL_TOLERANCE) & looks_numeric(F.col("text"))
    in_label = (F.col("x0") >= F.col("label_min")) & (F.col("x0") <= F.col("label_max")) & ~in_cell
    joined = lambda c, sep: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda w: w["text"]), sep)
    word = F.struct("x0", "text")
    lines = on_page.groupBy("ref", "line_y").agg(joined(F.when(in_label, word), " ").alias("label"), joined(F.when(in_cell & (nearer == "prior"), word), "").alias("prior"), joined(F.when(in_cell & (nearer == "current"), word), "").alias("current"))
    cells = lines.where("label <> ''").unpivot(["ref", "line_y", "label"], ["prior", "current"], "year_column", "token").where("token <> ''")
    return cells.join(F.broadcast(specs.select("ref", "page", "resolver", "indicator", "unit", "basis", "product", "flow", "table_scope")), "ref")


def year_observations(cells: DataFrame, known: dict[str, DataFrame], ref_year: int) -> tuple[DataFrame, DataFrame]:
    """(observations, labels set aside) of the cells: the earlier year is final, the later provisional.

    What a row sets goes before what its table sets; a token that is no number gives none.
    """
    found, missed = resolve_rows(cells, known)
    year = F.when(F.col("year_column") == "prior", ref_year - 1).otherwise(ref_year)
    own = lambda c, table: F.coalesce(F.col(c), F.col(table)).alias(c)
    rows = found.select(
        own("indicator_id", "indicator"), parse_number(F.col("token")).alias("value"), F.col("token").alias("value_raw"), F.col("unit").alias("unit_id"), F.col("basis").alias("calorific_basis"),
        F.when(F.col("basis") == "NA", "na").otherwise("stated").alias("basis_confidence"), F.lit("annual").alias("period_type"), F.make_date(year, F.lit(1), F.lit(1)).alias("period_start"), F.make_date(year, F.lit(12), F.lit(31)).alias("period_end"),
        year.alias("ref_year"), F.when(F.col("year_column") == "prior", "final").otherwise("provisional").alias("data_status"), F.col("ref").alias("source_ref"), (F.col("page") + 1).cast("string").alias("source_page"),
        F.concat(F.lit("row="), F.col("label"), F.lit("|col="), year.cast("string")).alias("source_cell"), own("flow_id", "flow"), own("product_id", "product"), "field_id", "level_id", "producer_id", "technology", own("scope", "table_scope"), "geography_scope", "is_total", footnotes_of(F.col("ref")).alias("footnotes"),
    ).where("value is not null")
    return rows, missed


def derived_totals(rows: DataFrame) -> DataFrame:
    """The totals that the tables don't print, as observations marked derived: gas demand from its usage, sales from their levels.

    Local sales are the sum of the levels; sales with exports add the exports, where a table has any. To one decimal.
    """
    keys = ["indicator_id", "unit_id", "calorific_basis", "source_ref", "ref_year"]
    usage = F.sum(F.when((F.col("indicator_id") == "gas_demand") & F.col("scope").isin("power_generation", "non_power"), F.col("value")))
    sold = F.col("indicator_id") == "electricity_sales"
    local = F.sum(F.when(sold & (F.col("geography_scope") == "local") & F.col("level_id").isNotNull(), F.col("value")))
    exports = F.max(F.when(sold & (F.col("geography_scope") == "exports_only"), F.col("value")))
    sums = rows.groupBy(*keys).agg(usage.alias("usage"), local.alias("local"), exports.alias("exports"))
    one = lambda value, flow, geography: F.struct(F.round(value, 1).alias("value"), F.lit(flow).alias("flow_id"), F.lit(geography).cast("string").alias("geography_scope"))
    listed = F.array(one(F.col("usage"), "flow.demand", None), one(F.col("local"), "flow.sales", "local"), one(F.col("local") + F.col("exports"), "flow.sales", "incl_exports"))
    return sums.select(*keys, F.explode(listed).alias("t")).select(*keys, "t.*", F.lit(True).alias("is_total"), F.lit(True).alias("is_grand"), F.lit(True).alias("is_derived")).where("value is not null")


def occurrences(rows: DataFrame, keys: list[str], order: list[str], label: str = "label", twice: str = "gaz naturel") -> DataFrame:
    """The rows that count of a balance table: `twice` stands for resources first and demand second, other labels count once."""
    nth = F.row_number().over(Window.partitionBy(*keys, norm_label(F.col(label))).orderBy(*order))
    again = norm_label(F.col(label)) == twice
    return rows.withColumn("nth", nth).where((F.col("nth") == 1) | again & (F.col("nth") == 2)).withColumn("flow_id", F.when(again, F.when(F.col("nth") == 1, "flow.resources").otherwise("flow.demand"))).drop("nth")
