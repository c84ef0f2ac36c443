"""Every query against its SQL on DuckDB."""

import math
import os

import duckdb
import pytest

from tessera.operators import evaluate
from tessera.plans import all_queries

QUERIES, ORACLES = all_queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return str(value)[:10] if hasattr(value, "isoformat") and str(value)[10:] in ("", " 00:00:00") else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir)
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = [tuple(map(plain, r)) for r in got.select(*[f"`{c}`" for c in columns]).collect()]
    assert sorted(rows, key=repr) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


def test_greedy_rows_against_a_loop(spark, sf_dir):
    assert set(QUERIES) == set(ORACLES)
    got = {}
    for r in QUERIES["x10_greedy_dedupe"](spark, sf_dir).collect():
        got.setdefault(r.page, []).append(r.y)
    rows = {}
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id % 200 as page", "hour(ts) * 60 + minute(ts) as y").collect():
        rows.setdefault(r.page, []).append(float(r.y))
    for page, ys in rows.items():
        kept = []
        for y in sorted(ys):
            if not kept or y - kept[-1] > 3:
                kept.append(y)
        assert sorted(got[page]) == kept


def test_evaluation_of_large_values(spark, sf_dir, con, tmp_path):
    """A thousand times the prices: values from ten million on have no exponent."""
    for name in os.listdir(sf_dir):
        if name != "lineitem.parquet":
            os.symlink(f"{sf_dir}/{name}", tmp_path / name)
    con.execute(f"copy (select * replace (l_extendedprice * 1000 as l_extendedprice) from lineitem) to '{tmp_path}/lineitem.parquet'")
    large = duckdb.connect()
    for name in os.listdir(tmp_path):
        large.execute(f"create view {name.removesuffix('.parquet')} as select * from '{tmp_path}/{name}'")
    want = large.execute(ORACLES["e1_evaluation"]).fetchall()
    assert max(float(got) for _, path, got in want if path == "observations.0.value") >= 1e7
    assert sorted(map(tuple, QUERIES["e1_evaluation"](spark, str(tmp_path)).select("name", "path", "got").collect())) == sorted(want)


def test_evaluation_settles_once(spark, sf_dir, monkeypatch):
    """What the cases ask is a table of its own: no case joins and shuffles the given tables again."""
    seen, run = [], evaluate.run
    monkeypatch.setattr(evaluate, "run", lambda spark, store, cases: seen.append(store) or run(spark, store, []))
    QUERIES["e1_evaluation"](spark, sf_dir)
    [store] = seen
    assert store.obs.count() > 0 and not store.obs.inputFiles() and not store.catalog.inputFiles()
