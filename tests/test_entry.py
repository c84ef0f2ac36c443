import sys

import __spark_entry__ as entry


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    assert all(callable(q) for q in queries.values())
    flagship = entry.entry(spark)
    assert flagship.count() > 0 and "value" in flagship.columns


def test_works_without_the_training_data_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "tessera.llm.queries", None)
    assert "w1_precedence" in entry.queries() and not any(q.startswith("op") for q in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
