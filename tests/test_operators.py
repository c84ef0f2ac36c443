"""Small frames for what the test tables don't hold."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import keys, text
from tessera.operators import api, catalog, constraints, evaluate, pages, postings, requests, extraction, quality, settle, tables, upsert, vocab
from tessera.operators import ingest as ingest_run
from tessera.plans.observations import run_sql, view
from tessera.sources import files
from tessera.sources import words as word_pages
from tessera.streaming import archive, ingest


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_numbers(spark):
    cases = {"4 702": 4702.0, "1 518": 1518.0, "0,3": 0.3, "-291": -291.0, "-": None, "_": None, "—": None, "": None, "1,234.5": 1234.5, "1,234,567": None, "1d": None, "1_0": None, "12.": 12.0, ".5": 0.5, "1e3": 1000.0, "abc": None}
    rows = column(spark, [*cases, None]).select("x", text.parse_number(F.col("x")).alias("n"), text.looks_numeric(F.col("x")).alias("like")).collect()
    assert {r.x: r.n for r in rows} == cases | {None: None}
    assert {r.x for r in rows if r.like} >= {"4 702", "0,3", "-291"} and not any(r.like for r in rows if r.x in ("abc", "-", None))


def test_decimals_as_text(spark):
    cases = {35242386.54: "35242386.54", 35242386.5: "35242386.5", 1e7: "10000000.0", 12345678901.25: "12345678901.25", -12345678.5: "-12345678.5", 7.0: "7.0", 0.1: "0.1", 100.0: "100.0", 2.005: "2.01", 0.0: "0.0"}
    rows = column(spark, [*cases, None], "double").select("x", text.decimal_text(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in rows} == cases | {None: None}


def test_labels(spark):
    rows = column(spark, ["  Pétrole brut (1) ", None, "ÉLEC.-HT", "نفط خام", "Å_b"]).select(text.norm_label(F.col("x")), text.norm_label(F.col("x"), exact=True)).collect()
    assert [r[0] for r in rows] == ["petrole brut 1", "", "elec ht", "نفط خام", "a_b"] == [r[1] for r in rows]


def test_roles(spark):
    cases = [((False, None, None, None, None, None, None, None), "leaf"), ((True, None, None, None, None, None, None, True), "grand_total"), ((True, "flow.demand", None, None, "lvl.hp", None, None, None), "alternative_breakdown"), ((True, "flow.demand", None, None, None, "non_power", None, False), "subtotal"), ((True, "flow.export", "prod.gasoil", None, None, None, None, None), "alternative_breakdown"), ((True, None, "prod.gasoil", None, None, None, None, None), "subtotal"), ((True, None, None, "prod.steg", None, None, None, None), "subtotal"), ((True, None, None, None, None, None, None, None), "grand_total")]
    df = spark.createDataFrame([(*c, want) for c, want in cases], "t boolean, f string, p string, pr string, l string, s string, g string, ig boolean, want string")
    assert all(r.role == r.want for r in df.withColumn("role", keys.aggregation_role(*[F.col(c) for c in ("t", "f", "p", "pr", "l", "s", "g", "ig")])).collect())


def test_month_ends_have_no_leap_year(spark):
    assert str(spark.range(1).select(keys.month_end(F.lit(2024), F.lit(2))).first()[0]) == "2024-02-28"


def test_exactly_one_preferred_row_a_cell(spark, sf_dir):
    settled = settle.precedence(view(spark, sf_dir, "obs"))
    per = settled.groupBy(*settle.CELL).agg(F.count_if("is_preferred").alias("n"), F.count_if(F.col("supersedes_id").isNotNull()).alias("l"), F.count("*").alias("all"))
    assert per.where("n <> 1 or l <> `all` - 1").count() == 0
    assert settle.detail(settled).where("is_total").count() == 0


def test_later_publication_wins_before_load_order(spark):
    rows = [(1, "s", "2020-01-01", "2020-12-31", "memento", "final", 1, "2021-01-01"), (2, "s", "2020-01-01", "2020-12-31", "rapport", "final", 2, "2022-01-01"), (3, "s", "2020-01-01", "2020-12-31", "rapport", "final", 0, None)]
    df = spark.createDataFrame(rows, "observation_id long, series_key string, period_start string, period_end string, report_type string, data_status string, load_key int, published string")
    assert [r.observation_id for r in settle.precedence(df, published="published").where("is_preferred").collect()] == [2]
    assert [r.observation_id for r in settle.precedence(df).where("is_preferred").collect()] == [3]


def test_upsert_rules(spark):
    schema = "upsert_key string, value double, source_cell string, n int"
    stored = spark.createDataFrame([("a", 1.0, "c1", 0), ("b", None, "c1", 0)], schema)
    batch = spark.createDataFrame([("a", 1.005, "c2", 1), ("a", 2.0, "c1", 2), ("a", 2.0, "c9", 3), ("d", 5.0, "c1", 4), ("d", 6.0, "c2", 5), ("b", 1.0, "c2", 6)], schema)
    fresh, collisions = upsert.upsert(stored, batch, ["n"])
    assert [(r.upsert_key, r.value) for r in fresh.collect()] == [("d", 5.0)]
    assert sorted((r.upsert_key, r.value) for r in collisions.collect()) == [("a", 2.0), ("b", 1.0), ("d", 6.0)]


def test_vocabulary(spark):
    known = vocab.names(spark.createDataFrame([(1, "p1", "Gaz", "Gaz naturel|GN"), (2, "p2", "Gaz naturel", None), (3, "p3", "Pétrole", "")], "o int, id string, label string, alias string"), "id", ["label"], "alias", "o")
    found, missed = vocab.match(column(spark, ["gaz naturel", "GAZ naturel sec", "petrole brut", "charbon", "", None]), "x", known)
    assert {r.x: r.id for r in found.collect()} == {"gaz naturel": "p1", "GAZ naturel sec": "p1", "petrole brut": "p3"}
    assert sorted(str(r.x) for r in missed.collect()) == ["", "None", "charbon"]


def test_vocabularies_of_any_size(spark):
    names = spark.range(60_000).selectExpr("cast(id as int) as o", "concat('v', id) as id", "concat('name ', id, ' of many words') as label", "cast(null as string) as alias")
    known = vocab.names(names, "id", ["label"], "alias", "o")
    found, missed = vocab.match(column(spark, ["the name 59999 of many words here", "Name 7 of many words", "name 7 of"]), "x", known)
    assert {r.x: r.id for r in found.collect()} == {"the name 59999 of many words here": "v59999", "Name 7 of many words": "v7"}
    assert [r.x for r in missed.collect()] == ["name 7 of"]


def test_anchors_of_each_page(spark):
    words = spark.createDataFrame([(1, 95.0, 105.0, "4"), (2, 95.0, 105.0, "5"), (3, 95.0, 105.0, "6")], "page int, x0 double, x1 double, text string")
    anchors = spark.createDataFrame([(1, 1, "b", 110.0), (1, 0, "a", 90.0), (2, 0, "z", 101.0), (3, 0, "far", 300.0)], "page int, ord int, column string, x double")
    found = extraction.nearest_anchor(words, anchors)
    assert sorted((r.page, r.column) for r in found.collect()) == [(1, "a"), (2, "z")] and found.columns == ["page", "x0", "x1", "text", "column"]


def test_a_source_that_reports_a_cell_twice_is_listed_with_its_last_value(spark):
    rows = [(1, "a", 1.0, True), (2, "a", 9.0, False), (3, "b", 2.0, False), (4, None, 5.0, False)]
    df = spark.createDataFrame([("s", "2020-01-01", "2020-12-31", 2020, "annual", "NA", i, src, v, p) for i, src, v, p in rows], "series_key string, period_start string, period_end string, ref_year int, period_type string, calorific_basis string, observation_id long, source_id string, value double, is_preferred boolean")
    assert settle.reconciliation_log(df).first().values_json == '{"a":9.0,"b":2.0}'


def test_the_first_row_of_a_unit_stays(spark):
    rows = [(2, "unit", "t", "second"), (1, "unit", "t", "first"), (3, "conversion", None, None)]
    df = spark.createDataFrame([(n, k, u, label, "mass", "a", "b", "2", "", "", "") for n, k, u, label in rows], "line_no int, record_type string, unit_code string, unit_label_fr string, quantity_kind string, from_unit string, to_unit string, factor string, calorific_basis string, scope string, note string")
    units, factors = files.split_units(df)
    assert [r.unit_label_fr for r in units.collect()] == ["first"] and [r.factor for r in factors.collect()] == [2.0]


def test_pairs_have_the_status_that_compare_gives(store, spark, sf_dir):
    live = store.obs.where("is_preferred")
    keys_ = [r.series_key for r in live.select("series_key").distinct().orderBy(F.xxhash64("series_key")).limit(6).collect()]
    pairs = [(a, b) for a in keys_ for b in keys_ if a < b]
    found = {(r.one, r.other): r.status for r in api.compare_pairs(spark.createDataFrame(pairs, "one string, other string"), live).collect()}
    assert found == {p: store.compare(list(p))["status"] for p in pairs}


def test_anchor_ties_go_to_the_first(spark):
    words = spark.createDataFrame([(1, 5.0, 95.0, 105.0, "4"), (1, 5.0, 200.0, 202.0, "9")], "page int, y double, x0 double, x1 double, text string")
    anchors = spark.createDataFrame([(1, "b", 110.0), (0, "a", 90.0)], "ord int, column string, x double")
    assert [(r.text, r.column) for r in extraction.nearest_anchor(words, anchors).collect()] == [("4", "a")]
    assert extraction.nearest_anchor(words, anchors.limit(0)).count() == 0


def test_cycles(spark):
    spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", None), ("f", "f")], "child string, parent string").createOrReplaceTempView("edges")
    assert {(r.offender, r.length) for r in quality.cycles(spark.table("edges")).collect()} == {("a", 3), ("b", 3), ("c", 3), ("f", 1)}
    ring = [(f"n{i}", f"n{(i + 1) % 1000}") for i in range(1000)]  # a ring of a thousand, with a long tail into it, beside a long chain to a root
    tail = [(f"t{i}", f"t{i - 1}" if i else "n7") for i in range(300)]
    chain = [(f"c{i}", f"c{i + 1}") for i in range(500)]
    found = {(r.offender, r.length) for r in quality.cycles(spark.createDataFrame(ring + tail + chain + [("two", "one"), ("one", "two"), ("x", None)], "child string, parent string")).collect()}
    assert found == {(f"n{i}", 1000) for i in range(1000)} | {("one", 2), ("two", 2)}
    none = spark.createDataFrame([("a", "b"), ("b", None)], "child string, parent string")
    assert quality.cycles(none).count() == 0 and quality.cycles(none.limit(0)).count() == 0 and quality.trees(none).count() == 0


def test_rules_report_errors_and_go_on(spark):
    rules = [quality.Rule("broken", "BLOCK", "select * from nowhere", ""), quality.Rule("finds", "BLOCK", "select 1 as x", ""), quality.Rule("clean", "BLOCK", "select 1 as x where false", "")]
    out = quality.run(spark, rules, lambda s, sql: s.sql(sql))
    assert [o.split(":")[0] for _, o, _ in out] == ["ERROR", "BLOCK", "PASS"]


@pytest.fixture(scope="module")
def store(spark, sf_dir):
    settled = settle.precedence(view(spark, sf_dir, "obs"))
    cat = catalog.catalog(settled)
    factors = spark.createDataFrame([("PCI", "PCS", 1.1111111111, "PCI->PCS", "natural gas", "")], "from_unit string, to_unit string, factor double, calorific_basis string, scope string, note string")
    units = spark.createDataFrame([("cur", "money")], "unit_code string, quantity_kind string")
    glossary = spark.createDataFrame([("calorific_basis", "NET", "net of discount", "GROSS"), ("scope", "flash_only", "x", "a|b")], "attribute string, token string, definition string, never_sum_with string")
    notes = settled.where("is_escalated").select("observation_id", F.lit("FN-1").alias("footnote_id"), F.lit("escalated").alias("text"))
    return api.Store(spark, settled, cat, units, factors, glossary, notes, [("oil price", "crude_price", False), ("prices", "brent_price", True)], {"umsatz": "revenue order"})


def ids(store, where):
    return [r.series_key for r in store.catalog.where(where).orderBy("series_key").collect()]


def test_answers_have_three_kinds_of_empty(store):
    key = ids(store, "aggregation_role = 'leaf' and calorific_basis = 'NET' and scope is null")[0]
    full = store.get_series(key)
    assert full["status"] == "ok" and full["n"] == len(full["observations"]) and {g["token"] for g in full["glossary"]} == {"NET"}
    assert all(o["calorific_basis"] == "NET" and isinstance(o["warnings"], list) for o in full["observations"])
    assert store.get_series(key, start_year=3000)["status"] == "empty_in_scope"
    assert store.get_series("nothing")["status"] == "unknown_series" and store.get_series("oil price x")["status"] == "out_of_scope"
    year = full["observations"][0]["ref_year"]
    assert store.get_observation(key, year)["n"] >= 1 and store.describe_series(key)["status"] == "ok" and store.get_metadata("x")["status"] == "unknown_series"


def test_search_and_list(store):
    assert store.search_series("umsatz asia")["series"][0]["region_id"] == "asia"
    assert store.search_series("qqq")["status"] == "empty_in_scope" and store.search_series("what prices")["also_note_out_of_scope"] == "brent_price"
    assert store.list_series("order_revenue", limit=3)["n"] > 3 and store.list_series("prices")["status"] == "out_of_scope" and store.list_series("zz")["status"] == "empty_in_scope"


def test_guard(store):
    leaf = ids(store, "aggregation_role = 'leaf' and scope is null and calorific_basis = 'NET'")
    other = ids(store, "aggregation_role = 'leaf' and scope is null and calorific_basis = 'GROSS'")
    total = ids(store, "aggregation_role = 'grand_total' and scope is null and calorific_basis = 'NET'")
    assert store.compare(leaf[:1])["status"] == "error" and store.compare([leaf[0], "x"])["status"] == "unknown_series"
    assert store.compare(leaf[:2])["status"] == "compared"
    assert store.compare([leaf[0], other[0]])["status"] == "refused_incompatible" and "calorific_basis" in store.compare([leaf[0], other[0]])["incompatible_on"]
    assert store.compare([leaf[0], total[0]])["status"] == "refused_aggregation" == store.compare([other[0], total[0]])["status"]
    forced = store.compare([leaf[0], total[0]], force=True)
    assert forced["status"] == "compared_with_warning" and forced["hard_warning"]


def test_small_tools(store):
    assert store.convert_units(100, "ktep-pci", "ktep-pcs")["result"] == pytest.approx(111.11111111) and store.convert_units(9, "ktep-pcs", "ktep-pci")["result"] == pytest.approx(8.1)
    assert store.convert_units(1, "a", "b")["status"] == "no_factor"
    assert store.list_units()["units"] and store.list_dimensions()["dimensions"]["product_id"] > 1 and store.list_dimensions("x")["status"] == "error"
    assert store.list_dimensions("region_id")["members"] and store.get_scope_glossary("scope")["glossary"][0]["never_sum_with"] == ["a", "b"]
    assert store.get_conflicts()["n"] <= store.get_conflicts(include_agreements=True)["n"]


def test_queries_are_read_only_and_arguments_are_literals(store):
    with pytest.raises(PermissionError):
        store.query("drop table observation")
    assert store.query("select count(*) as n from observation where source_id = ?", ["x' or '1'='1"]).first().n == 0


def test_unsafe_sums_are_refused(store, spark, sf_dir):
    one = store.obs.where("scope is null and calorific_basis = 'NET'")
    assert store.safe_total(one).first().total > 0
    with pytest.raises(ValueError):
        store.safe_total(store.obs)


def test_reports_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a, b"), (2, None)], "n int, t string")
    files.write_report(df, str(tmp_path / "c"))
    assert [(r.n, r.t) for r in files.read_csv(spark, str(tmp_path / "c"), "n int, t string").orderBy("n").collect()] == [(1, "a, b"), (2, None)]
    files.write_report(df, str(tmp_path / "m"), "md")
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["| n | t |", "|---|---|", "| 1 | a, b |", "| 2 |  |"]
    files.write_report(df, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_stream_of_editions_is_idempotent(spark, tmp_path):
    schema = spark.createDataFrame([], "upsert_key string, value double, source_cell string").schema
    source, store, aside, check = (str(tmp_path / x) for x in ("in", "store", "aside", "check"))
    spark.createDataFrame([("a", 1.0, "c1"), ("b", 2.0, "c1")], schema).coalesce(1).write.mode("append").parquet(source)
    ingest.start(spark, source, schema, store, aside, check, ["value"]).awaitTermination(120)
    spark.createDataFrame([("a", 1.0, "c1"), ("b", 9.0, "c2"), ("c", 3.0, "c1")], schema).coalesce(1).write.mode("append").parquet(source)
    ingest.start(spark, source, schema, store, aside, check, ["value"]).awaitTermination(120)
    kept = lambda: (sorted((r.upsert_key, r.value) for r in spark.read.parquet(store).collect()), [(r.upsert_key, r.value) for r in spark.read.parquet(aside).collect()])
    assert kept() == ([("a", 1.0), ("b", 2.0), ("c", 3.0)], [("b", 9.0)])
    # a batch whose commit was lost is run again, and changes nothing
    os.remove(f"{check}/commits/1")
    os.remove(f"{check}/commits/.1.crc")
    ingest.start(spark, source, schema, store, aside, check, ["value"]).awaitTermination(120)
    assert kept() == ([("a", 1.0), ("b", 2.0), ("c", 3.0)], [("b", 9.0)])


def test_an_ingest_run_is_idempotent_and_keeps_constraints(spark, tmp_path):
    root = str(tmp_path / "store")
    one = {"indicator_id": "gas", "unit_id": "kt", "value": 5.0, "period_type": "annual", "period_start": "2020-01-01", "period_end": "2020-12-31", "ref_year": 2020, "report_type": "bilan", "data_status": "final", "calorific_basis": "NA", "extra": "x"}
    rows = [one | {"source_id": "a", "source_cell": "c1", "load_key": 1}, one | {"source_id": "b", "source_cell": "c1", "load_key": 2, "value": 50.0, "report_type": "conjoncture"}, one | {"source_id": "c", "source_cell": "c1", "load_key": 3, "period_start": "2021-01-01"}, one | {"source_id": "d", "source_cell": "c1", "load_key": 4, "data_status": "guessed"}, one | {"source_id": "e", "source_cell": "c1", "load_key": 5, "unit_id": None}]
    schema = "indicator_id string, unit_id string, value double, period_type string, period_start string, period_end string, ref_year int, report_type string, data_status string, calorific_basis string, extra string, source_id string, source_cell string, load_key long"
    batch = spark.createDataFrame(rows, schema)
    ingest_run.reset(spark, root)
    first, sizes = ingest_run.ingest(spark, batch, root, 1), ingest_run.sizes(spark, root)
    assert first == {"appended": 2, "set_aside": 3, "replaced": 1}
    assert (sizes["observation"], sizes["preferred"], sizes["reconciliation"], sizes["series"], sizes["quarantine"]) == (2, 1, 1, 1, 3)
    assert {r.context for r in spark.read.parquet(f"{root}/quarantine").collect()} == {"not (period_start <= period_end)", "data_status=guessed", "unit_id is null"}
    stored = ingest_run.observations(spark, root)
    assert stored.schema == ingest_run.OBSERVATION and sorted(r.observation_id for r in stored.collect()) == [1, 2]
    assert ingest_run.ingest(spark, batch, root, 1) == first and ingest_run.sizes(spark, root) == sizes  # the same run again
    assert ingest_run.ingest(spark, batch, root, 2) == {"appended": 0, "set_aside": 3, "replaced": 0}  # the same batch as a later run
    more = batch.where("source_id = 'a'").withColumns({"value": F.lit(7.0), "source_cell": F.lit("c9")}).unionByName(batch.where("source_id = 'a'").withColumn("source_id", F.lit("z")))
    third = ingest_run.ingest(spark, more, root, 3)
    assert third["appended"] == 1 and ingest_run.sizes(spark, root)["observation"] == 3 and spark.read.parquet(f"{root}/quarantine/run=3").first().dimension == "SERIES_KEY_COLLISION"
    assert spark.read.parquet(f"{root}/settled").where("is_preferred").first().source_id in ("a", "z")
    stored, ids_ = ingest_run.observations(spark, root), lambda x: spark.createDataFrame([(x,)], "id string")
    assert {(r.reference, r.offender) for r in quality.orphan_members(stored, {"unit_id": ids_("t"), "source_id": ids_("a")}).collect()} == {("unit_id", "kt"), ("source_id", "b"), ("source_id", "z")}
    ingest_run.reset(spark, root)
    assert ingest_run.observations(spark, root).count() == 0


def test_a_later_batch_replaces_only_what_it_touches(spark, tmp_path):
    """Folders of other periods and indicators stay byte for byte; the store equals one loaded at once."""
    root, whole = str(tmp_path / "a"), str(tmp_path / "b")
    schema = "indicator_id string, unit_id string, value double, period_type string, period_start string, period_end string, ref_year int, report_type string, data_status string, calorific_basis string, source_id string, source_ref string, product_id string, is_total boolean, aggregation_role string, source_cell string, load_key long"

    def row(indicator, year, source, product, value, ref="C-T14"):
        total = product == "prod.petroleum_products_total"
        return (indicator, "kt", float(value), "annual", f"{year}-01-01", f"{year}-12-31", year, "conjoncture", "final", "NA", source, ref, product, total, "grand_total" if total else "leaf", f"{source}/{product}/{year}/{indicator}", 1)

    total = "prod.petroleum_products_total"
    old = [row(i, y, s, p, v) for i in ("oil", "gas") for y in (2018, 2019, 2020) for s in ("a", "b") for p, v in (("prod.x", 60), ("prod.y", 40), (total, 200 if i == "oil" else 0))]
    new = [row("oil", 2019, "a", "prod.z", 500), row("coal", 2020, "c", "prod.x", 5, "M-T2")]
    new = [*new, row("gas", 2019, "c", "prod.x", 70)]
    ingest_run.reset(spark, root)
    ingest_run.reset(spark, whole)
    frame = lambda rows: spark.createDataFrame(rows, schema)
    ingest_run.ingest(spark, frame(old), root, 1)
    files_of = lambda: {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for t in ("settled", "reconciliation") for d, _, names in os.walk(f"{root}/{t}") for f in names if f.endswith(".parquet")}
    before = files_of()
    found = ingest_run.ingest(spark, frame(new), root, 2)
    stays = {f for f, t in files_of().items() if before.get(f) == t}
    gone = {tuple(f.split("/")[-3:-1]) for f in before if f not in stays and "/settled/" in f}
    assert found == {"appended": 3, "set_aside": 0, "replaced": 3}
    assert gone == {(f"indicator_id={i}", "period=2019-01-01_2019-12-31") for i in ("oil", "gas")}  # gas shares the printed table
    ingest_run.ingest(spark, frame(old + new), whole, 1)
    columns = ["upsert_key", "is_preferred", "extraction_confidence", "value"]
    rows = lambda r: sorted((tuple(x) for x in ingest_run.settled_rows(spark, r).select(*columns).collect()), key=str)
    assert rows(root) == rows(whole) and ingest_run.sizes(spark, root) == ingest_run.sizes(spark, whole)
    log = lambda r: sorted((tuple(x) for x in spark.read.parquet(f"{r}/reconciliation").select("series_key", "period", "n_sources", "note").collect()), key=str)
    assert log(root) == log(whole)
    low = {(r.indicator_id, r.ref_year, r.source_id) for r in ingest_run.settled_rows(spark, root).where("extraction_confidence = 'low'").collect()}
    assert {(y, s) for _, y, s in low} == {(2019, "a")}  # the total is missed there; M-T2 prints none and stays normal


def test_pinned_totals_by_table(spark):
    """Leaves against the pinned total over all indicators and bases of a table; other totals of the table don't count."""
    rows = [("a", "C-T21", "flow.sales", None, True, "grand_total", 100.0), ("a", "C-T21", "flow.sales", None, False, "leaf", 60.0), ("a", "C-T21", "flow.sales", None, False, "leaf", 38.0), ("a", "C-T21", "flow.exchanges_transfers", None, True, "alternative_breakdown", 900.0), ("b", "C-T21", "flow.sales", None, True, "grand_total", 100.0), ("b", "C-T21", "flow.sales", None, False, "leaf", 60.0), ("c", "C-T21", "flow.sales", None, False, "leaf", 60.0), ("d", "M-T2", "flow.sales", None, False, "leaf", 60.0), ("e", "C-T21", "flow.sales", "lvl.hp", True, "grand_total", 100.0), ("e", "C-T21", "flow.sales", None, False, "leaf", 1.0), ("f", "C-T21", "flow.sales", None, True, "grand_total", 0.0)]
    frame = spark.createDataFrame([(*r, "2020-01-01", "2020-12-31", None, None, None, None, True, "normal") for r in rows], "source_id string, source_ref string, flow_id string, level_id string, is_total boolean, aggregation_role string, value double, period_start string, period_end string, scope string, geography_scope string, producer_id string, technology string, is_preferred boolean, extraction_confidence string").withColumn("product_id", F.lit(None).cast("string"))
    low = {r.source_id for r in settle.distrust(frame).where("extraction_confidence = 'low'").collect()}
    assert low == {"b", "c"}


def test_constraints_as_rows(spark):
    c = constraints.Constraint
    listed = [c("observation", "not_null", ("a",)), c("observation", "enum", ("b",), ("x", "y")), c("observation", "check", ("ab",), ("a < 3",)), c("observation", "unique", ("a",)), c("observation", "reference", ("b",), ("dim.id",)), c("dim", "reference", ("parent",), ("dim.id",)), c("other", "not_null", ("z",))]
    rows = spark.createDataFrame([(1, "x"), (1, "q"), (None, "y"), (5, None)], "a int, b string")
    dim = spark.createDataFrame([("x", None), ("y", "x"), ("z", "nowhere")], "id string, parent string")
    found = {r.constraint_name: (r.n, r.outcome) for r in constraints.check({"observation": rows, "dim": dim}, listed).collect()}
    assert found == {"observation.a.not_null": (1, "BLOCK"), "observation.b.enum": (1, "BLOCK"), "observation.ab.check[a < 3]": (1, "BLOCK"), "observation.a.unique": (1, "BLOCK"), "observation.b.reference": (1, "BLOCK"), "dim.parent.reference": (1, "BLOCK")}
    said = rows.withColumn("v", constraints.violations(listed)).orderBy("b").collect()
    assert [r.v for r in said] == [["not (a < 3)"], ["b=q"], [], ["a is null"]]
    unknown = constraints.unknown_members(rows, {"dim": dim}, listed)
    assert {r.b: r.unknown for r in unknown.collect()} == {"x": [], "q": ["b->q"], "y": [], None: []}
    clean = constraints.check({"observation": rows.limit(0), "dim": dim.where("parent is null")}, listed).collect()
    assert all(r.n == 0 and r.outcome == "PASS" for r in clean) and len(clean) == 6


def test_the_published_catalog_has_its_columns(store):
    out = catalog.published(store.catalog)
    assert len(out.columns) == 28 and out.columns[:5] == ["series_id", "display_name", "aggregation_role", "definition", "unit"] and out.where("display_name is null").count() == 0


def test_a_table_of_two_years_becomes_observations(spark):
    specs = spark.createDataFrame(tables.YEAR_TABLES, tables.YEAR_TABLES_SCHEMA)
    line = lambda y, label, prior, now: [(13, y, 20.0, 60.0, label), (13, y, 175.0, 190.0, prior), (13, y, 228.0, 242.0, now)]
    words = spark.createDataFrame(line(110.0, "Haute tension", "1 500,5", "1600") + line(120.0, "Basse tension", "700", "-") + line(130.0, "Ventes externes", "10", "20") + line(140.0, "Inconnu", "1", "2") + [(3, 110.0, 20.0, 60.0, "x")], "page int, y double, x0 double, x1 double, text string")
    names = {d: vocab.names(spark.createDataFrame([(0, "none", "none")], "o int, id string, label string"), "id", ["label"], None, "o") for d in ("field_id", "product_id", "level_id")}
    rows, aside = tables.year_observations(tables.year_table_rows(words, specs), names, 2024)
    assert sorted((r.ref_year, r.data_status, r.level_id or r.geography_scope, r.value) for r in rows.collect()) == [(2023, "final", "exports_only", 10.0), (2023, "final", "lvl.bt", 700.0), (2023, "final", "lvl.ht", 1500.5), (2024, "provisional", "exports_only", 20.0), (2024, "provisional", "lvl.ht", 1600.0)]
    assert {r.label for r in aside.collect()} == {"Inconnu"}
    totals = {(r.ref_year, r.geography_scope): r.value for r in tables.derived_totals(rows).collect()}
    assert totals == {(2023, "local"): 2200.5, (2023, "incl_exports"): 2210.5, (2024, "local"): 1600.0, (2024, "incl_exports"): 1620.0}


def test_blocks_count_from_their_top(spark):
    rows = spark.createDataFrame([(1, y) for y in (10.0, 35.0, 41.0, 60.0, 72.0, 200.0)] + [(2, None)], "page int, y double")
    assert [(r.block, r.y) for r in tables.blocks(rows, ["page"]).orderBy("block").collect()] == [(0, 10.0), (1, 41.0), (2, 72.0), (3, 200.0)]


def test_evaluation_gates_on_adversarial_cases(store, spark):
    good = evaluate.Case("a", "get_series", ("nothing",), {}, {"status": "unknown_series"})
    bad = evaluate.Case("b", "compare", (["x"],), {}, {"status": "compared"}, "adversarial")
    rows = {r.layer: (r.cases, r.passed, r.gate_open) for r in evaluate.summary(evaluate.run(spark, store, [good, bad])).collect()}
    assert rows == {"retrieval": (1, 1, True), "adversarial": (1, 0, False)}
    assert evaluate.at({"a": [{"b": 3}]}, "a.0.b") == 3 and evaluate.at({"a": []}, "a.0.b") is None and evaluate.at({"a": [1, 2]}, "a.n") == 2


def test_manifest_states_and_log(spark, tmp_path):
    schema, path = "url string, sha256 string, fetched_at int", str(tmp_path / "m")
    files.update_manifest(spark, path, spark.createDataFrame([("b", "x", 1), ("a", "y", 1), ("a", "z", 0)], schema), ["url"], 0)
    after = files.update_manifest(spark, path, spark.createDataFrame([("a", "w", 2), ("c", "v", 2)], schema), ["url"], 1)
    assert [(r.url, r.sha256) for r in after.orderBy("url").collect()] == [("a", "w"), ("b", "x"), ("c", "v")]
    for _ in range(2):
        files.append_log(spark.createDataFrame([(1, "fetched")], "n int, event string"), str(tmp_path / "log"), 7)
    assert spark.read.json(str(tmp_path / "log")).count() == 1


def test_plans_prune_and_push(spark, sf_dir):
    plan = run_sql(spark, sf_dir, "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")._jdf.queryExecution().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "o_totalprice" not in plan.split("Physical Plan")[1]


def test_requests_give_what_the_store_gives_one_by_one(store, spark):
    keys_ = [r[0] for r in store.catalog.select("series_key").orderBy("series_key").limit(6).collect()]
    asked = [(i, k, None, 1996 if i % 2 else None, None if i % 3 else 1999, i % 2 == 0, i % 3 == 0, i % 4 == 0) for i, k in enumerate([*keys_, "nothing", "crude oil price", keys_[0]])]
    asked.append((99, keys_[1], "monthly", None, None, True, True, False))
    frame = spark.createDataFrame(asked, "rid int, series_id string, period_type string, start_year int, end_year int, include_low boolean, include_escalated boolean, exclude_provisional boolean")
    got = {r.rid: r for r in requests.series(frame, store.obs, store.catalog, store.deferred).collect()}
    for rid, key, kind, start, end, low, escalated, exclude in asked:
        want = store.get_series(key, kind, start, end, low, escalated, exclude)
        r = got[rid]
        assert (r.status, r.n) == (want["status"], want.get("n", 0)) and r.family == want.get("family") and r.hidden_by_default == want.get("hidden_by_default")
        assert [o.asDict(recursive=True) for o in r.observations] == want.get("observations", [])
    one = requests.observation(spark.createDataFrame([(1, keys_[0], 1996, None), (2, keys_[0], 1996, 3)], "rid int, series_id string, year int, cutoff_month int"), store.obs, store.catalog)
    want = [store.get_observation(keys_[0], 1996), store.get_observation(keys_[0], 1996, 3)]
    assert [(r.status, r.n) for r in one.orderBy("rid").collect()] == [(w["status"], w["n"]) for w in want]
    found = {r.rid: r for r in requests.describe(spark.createDataFrame([(1, keys_[0]), (2, "nothing")], "rid int, series_id string"), store.catalog, store.obs, store.footnotes, store.glossary).collect()}
    full = store.describe_series(keys_[0])
    assert found[2].status == "unknown_series" and found[1].series.asDict(recursive=True) == full["series"]
    assert [x.asDict() for x in found[1].footnotes] == full["footnotes"]


def test_postings_give_what_a_scan_gives(store, spark):
    texts_ = postings.texts(catalog.tiers(store.catalog))
    index = postings.postings(texts_)
    queries = ["asia large net", "order order_rev", "zz", "a", "", "ev", "it's region=asia net NET"]
    frame = spark.createDataFrame(list(enumerate(queries)), "qid int, query string")
    got = {}
    for r in postings.best(postings.search(frame, index, texts_), store.catalog, 5).orderBy("qid", "place").collect():
        got.setdefault(r.qid, []).append((r.key, r.score))
    for i, q in enumerate(queries):
        want = [(h["series_key"], h["score"]) for h in store.search_series(q, limit=5)["series"]]
        assert got.get(i, []) == want, q
    plan = index.join(spark.createDataFrame([("net",)], "piece string"), "piece")
    assert plan.columns == ["piece", "key", "tier"]


def test_a_page_of_stacked_tables(spark):
    """Split numbers, a title row with too few numbers, a row printed twice, prose behind a gap, and a second block."""
    rows = [(40, 40, 90, "Demande")]
    for block, top in ((0, 100), (1, 300)):
        for r, label in enumerate(("Demande", "Haute", "Haute", "Total")):
            y = top + (14 * r if r != 2 else 15.5)
            rows.append((y, 40, 90, label))
            for c in range(5):
                rows += [(y, 200 + 60 * c, 206 + 60 * c, str(r + 1)), (y, 208 + 60 * c, 226 + 60 * c, f"{block}0{c}")]
        rows += [(top + 100, 40, 90, "Prose"), (top + 100, 205, 225, "2020")]
    words = spark.createDataFrame([(7, float(y), float(a), float(b), t) for y, a, b, t in rows], "page int, y double, x0 double, x1 double, text string")
    specs = spark.createDataFrame([("A", 7, "Demande", 0), ("B", 7, "Demande", 1), ("C", 7, "Demande", 2), ("D", 7, "Offre", 0)], "ref string, page int, anchor_label string, block int")
    found = pages.segment(words, specs).collect()
    assert {r.ref for r in found} == {"A", "B"} and {r.top for r in found} == {100.0, 300.0} and {r["columns"] for r in found} == {5}
    assert {r.row_y for r in found if r.ref == "A"} == {100.0, 114.0, 142.0}  # one of the two rows that are 1.5 apart, and none behind the gap
    cells = {(r.row_y, r.role): r.token for r in found if r.ref == "B"}
    assert cells[300.0, "real"] == "1100" and cells[342.0, "var"] == "4104" and len([r for r in found if r.ref == "B" and r.row_y == 300.0]) == 5
    assert next(r.label for r in found if r.row_y == 142.0) == "Total"


def test_versions_by_state_equal_those_of_the_whole_history(spark, tmp_path):
    schema = "url string, sha256 string, fetched_at long"
    batches = [[("a", "x", 1), ("b", "x", 2), ("a", "y", 3)], [("a", "x", 4), ("a", "z", 6), ("a", "z", 5), ("c", "q", 7)], [("b", "w", 8), ("b", "x", 9)]]
    source, store_ = str(tmp_path / "in"), str(tmp_path / "store")
    start = lambda: archive.start(spark, source, spark.createDataFrame([], schema).schema, store_, str(tmp_path / "check")).awaitTermination(240)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        start()
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(f"{store_}/versions").select("url", "sha256", "fetched_at", "version_no").collect())
    whole = files.archive_versions(spark.createDataFrame(sum(batches, []), schema)).select("url", "sha256", "fetched_at", "version_no")
    assert read() == sorted(tuple(r) for r in whole.collect())
    spark.createDataFrame(batches[0], schema).coalesce(1).write.mode("append").parquet(source)  # a replay adds nothing
    start()
    assert read() == sorted(tuple(r) for r in whole.collect())
    last = max(int(x.split("=")[1]) for x in os.listdir(f"{store_}/manifest"))
    manifest = {r.url: r.sha256 for r in spark.read.parquet(f"{store_}/manifest/state={last}").collect()}
    assert manifest == {"a": "z", "b": "w", "c": "q"}


def test_arabic_months_and_repeated_source_ids(spark):
    names = {"وضع_قطاع_الطاقة_جويلية_2021.pdf": "2021-07", "وضع_قطاع_الطاقة_سنة_2020.pdf": "2020-12", "Conjoncture_mai_2019.pdf": "2019-05", "Conjoncture_fin_décembre_2018.pdf": "2018-12"}
    rows = column(spark, list(names)).select("x", files.report_period(F.col("x"), F.lit("Conjoncture")).alias("p")).collect()
    assert {r.x: r.p for r in rows} == names
    manifest = spark.createDataFrame([("Bilan", "2020", "", "fr", "p1", "abcdef123"), ("Bilan", "2020", "", "fr", "p2", "fedcba987"), ("Memento", "2020", "", "ar", "p3", "x")], "report_family string, period string, version string, language string, local_path string, file_id string")
    assert [r.source_id for r in files.with_source_ids(manifest, ["local_path"]).orderBy("local_path").collect()] == ["bilan_2020", "bilan_2020_fedcba", "memento_2020_ar"]


def test_pages_that_nobody_wants_are_not_read(spark, tmp_path, monkeypatch):
    rows = [(page, float(y), 10.0 * i, 10.0 * i + 5, f"w{page}\t{i} é") for page in range(1, 31) for y in (10, 20, 30) for i in range(4)]
    words_ = spark.createDataFrame(rows, "page int, y double, x0 double, x1 double, text string")
    path = str(tmp_path / "words")
    word_pages.write(words_, path, files=3)
    back = word_pages.read(spark, path)
    assert sorted((r.page, r.y, r.x0, r.x1, r.text) for r in back.collect()) == sorted((p, y, a, b, t.replace("\t", " ")) for p, y, a, b, t in rows)
    some = word_pages.read(spark, "file://" + path).where("page in (4, 29) and y > 10 and y <= 20")
    assert {(r.page, r.y) for r in some.collect()} == {(4, 20.0), (29, 20.0)} and some.count() == 8
    reader = word_pages.WordReader({"path": path, "partition_bytes": "100"})
    reader.pages.append((word_pages.BOUNDS[word_pages.EqualTo], 7))
    plan = reader.partitions()
    assert [x[1] for p in plan for x in p.of] == [7]  # one page is planned
    reader.bands.append((word_pages.BOUNDS[word_pages.GreaterThan], 25.0))
    assert sum(b.num_rows for p in plan for b in reader.read(p)) == 4
    whole = word_pages.WordReader({"path": path, "partition_bytes": "400"}).partitions()
    assert len(whole) > 10 and sum(len(p.of) for p in whole) == 30
    assert word_pages.file_system("s3a://bucket/x")[1] == "bucket/x" if hasattr(word_pages.pafs, "S3FileSystem") and os.environ.get("AWS_REGION") else True
    assert word_pages.read(spark, path).where("page > 99").count() == 0
