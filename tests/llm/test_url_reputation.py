import math

import duckdb
import numpy as np
import pytest

from tessera.llm import queries
from tessera.llm import url_reputation as U

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
URLS = ["https://A.Example.ORG/es/x", "http://example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/", "x://b.com/fr/1?q", "x://b.com/frx", "http://b.com", "http://b.com?/fr/", "no scheme", "", None, "http://u@H.co.uk:80/p#f", "http://10.0.0.1/x", "a://b://c/d"]


def judged(spark, urls, outcomes, rules=RULES, **how):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, good string")
    rows = U.judge(pages, spark.createDataFrame(outcomes, "host string, good int"), rules, **how).collect()
    return {r.id: r for r in rows}


def test_hosts_paths_and_rules(spark):
    rows = judged(spark, URLS, [("b.com", 1)])
    assert [(rows[i].host, rows[i].path) for i in range(len(URLS))] == [("a.example.org", "/es/x"), ("example.org", "/en/12"), ("example.org", "/en/2"), ("notexample.org", "/es/"), ("b.com", "/fr/1"), ("b.com", "/frx"), ("b.com", ""), ("b.com", ""), ("", ""), ("", ""), ("", ""), ("u@h.co.uk:80", "/p"), ("10.0.0.1", "/x"), ("b:", "//c/d")]
    assert [rows[i].rule for i in range(8)] == ["example.org/es/", "example.org/en/1", "org/", "org/", "com/fr/", None, None, None]
    assert [rows[i].verdict for i in range(5)] == ["block", "block", "allow", "allow", "allow"]
    assert {r.verdict for r in rows.values()} <= {"allow", "block"}


def test_domains(spark):
    from pyspark.sql import functions as F

    hosts = ["a.b.example.com", "x.y.co.uk", "co.uk", "u@h.net:80", "localhost", "10.1.2.3", ""]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select(U.domain_of(F.col("h")), U.suffix_of(F.col("h"))).collect()
    assert [tuple(r) for r in rows] == [("example.com", "com"), ("y.co.uk", "co.uk"), ("co.uk", "co.uk"), ("h.net", "net"), ("localhost", "localhost"), ("10.1.2.3", ""), ("", "")]


def test_shrinking(spark):
    rows = [("good.a.com", 30, 30), ("bad.a.com", 0, 30), ("one.a.com", 0, 1), ("new.net", 0, 0), ("new.a.com", 0, 0), *[(f"h{i}.net", 1, 1) for i in range(40)]]
    found = {r.host: r for r in U.reputations(spark.createDataFrame(rows, "host string, good long, n long")).collect()}
    mean = {h: r.mean for h, r in found.items()}
    assert mean["bad.a.com"] < mean["one.a.com"] < mean["new.a.com"] < mean["good.a.com"]  # one bad page is not thirty
    assert mean["new.net"] > mean["new.a.com"]  # the suffix speaks for new hosts
    assert all(r.bound <= r.mean for r in found.values()) and found["good.a.com"].bound > U.LIMIT > found["bad.a.com"].bound


def brute_below(x, a, b, terms=20_000):
    """P(Beta(a, b) <= x), summed up from its series of positive terms."""
    return sum(math.exp((a + i) * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b + i) - math.lgamma(b) - math.lgamma(a + 1 + i)) for i in range(terms))


def test_beta_probabilities_and_quantiles():
    shapes = [(0.3, 0.7), (1, 1), (2.5, 1.2), (1.5, 30), (40, 12), (700.5, 650.2), (0.9, 5)]
    a, b = (np.array(x, float) for x in zip(*shapes, strict=True))
    for x in (0.1, 0.5, 0.8):
        assert np.allclose(U.beta_below(np.full(len(a), x), a, b), [brute_below(x, *s) for s in shapes], atol=1e-10)
    assert np.allclose(U.beta_below(U.beta_quantile(0.05, a, b), a, b), 0.05, atol=1e-9)
    assert U.beta_below(np.array([0.0, 1.0]), np.array([2.0, 2.0]), np.array([3.0, 3.0])).tolist() == [0, 1]
    assert abs(U.beta_below(np.array([0.5]), np.array([4e9]), np.array([4e9]))[0] - 0.5) < 1e-3


def test_what_a_level_is_shrunk_towards_leaves_its_own_out(spark):
    rows = [("a.x.com", 3, 4), ("b.x.com", 0, 5), ("c.y.com", 7, 7), ("d.z.net", 1, 3), ("new.x.com", 0, 0)]
    frame = spark.createDataFrame(rows, "host string, good long, n long")
    strengths = {}
    for level, key in (("suffix", U.suffix_of), ("domain", U.domain_of), ("host", lambda h: h)):
        groups = frame.select(key(frame.host).alias("k"), "good", "n").groupBy("k").sum("good", "n").toDF("k", "good", "n")
        strengths[level] = U._strength(groups)
    total = [sum(x) for x in zip(*((g, n) for _, g, n in rows), strict=True)]
    reputations = {r.host: r for r in U.reputations(frame).collect()}
    for host, good, n in rows:
        suffix, domain = host.split(".")[-1], ".".join(host.split(".")[-2:])
        s = [sum(x) for x in zip(*((g, m) for h, g, m in rows if h.endswith(suffix)), strict=True)]
        d = [sum(x) for x in zip(*((g, m) for h, g, m in rows if h.endswith(domain)), strict=True)]
        rest = (total[0] - s[0] + 1) / (total[1] - s[1] + 2)
        above = (s[0] - d[0] + strengths["suffix"] * rest) / (s[1] - d[1] + strengths["suffix"])
        prior = (d[0] - good + strengths["domain"] * above) / (d[1] - n + strengths["domain"])
        found = reputations[host]
        a, b = good + strengths["host"] * prior, n - good + strengths["host"] * (1 - prior)
        assert found.mean == pytest.approx(a / (a + b)) and found.risk == pytest.approx(brute_below(U.LIMIT, a, b), abs=1e-9)


def test_the_method_blocks_hosts_that_no_rule_names(spark):
    outcomes = [("bad.net", 0)] * 8 + [("good.net", 1)] * 40 + [("worse.info", 0)] * 20 + [("fine.info", 1)] * 12
    rows = judged(spark, ["http://bad.net/a", "http://good.net/a", "http://worse.info/b", "http://new.info/"], outcomes)
    assert [rows[i].verdict for i in range(3)] == ["block", "allow", "block"] and all(r.rule is None for r in rows.values())
    assert all((r.verdict == "allow") == (r.bound >= U.LIMIT) == (r.risk <= U.TAIL) for r in rows.values())


def test_counts_of_any_size(spark):
    rows = [("a.com", 3_000_000_000, 5_000_000_000), ("b.com", 4_000_000_000, 4_000_000_001), ("c.net", 0, 3)]
    found = {r.host: r for r in U.reputations(spark.createDataFrame(rows, "host string, good long, n long")).collect()}
    assert abs(found["a.com"].mean - 0.6) < 1e-3 and abs(found["a.com"].bound - 0.6) < 1e-3 and found["c.net"].bound < U.LIMIT


def test_other_suffixes_may_be_passed_in(spark):
    frame = spark.createDataFrame([("a.b.github.io",)], "h string")
    row = frame.select(U.domain_of(frame.h), U.domain_of(frame.h, ["github.io"]), U.suffix_of(frame.h, ["github.io"])).first()
    assert tuple(row) == ("github.io", "b.github.io", "github.io")


def test_odd_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(pages, spark.createDataFrame([("a.com", 1)], "host string, good int"), RULES).count() == 0
    rows = judged(spark, ["http://a.com/", "http://a.com/", None], [])
    assert rows[0].bound == rows[1].bound == pytest.approx(rows[2].bound)


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cols = ["page_id", "host", "path", "rule", "verdict", "risk_permille"]
    want = con.sql(f"select {', '.join(cols)} from ({queries.ORACLES['op1_url_reputation']})").fetchall()
    got = [tuple(r) for r in queries.op1_url_reputation(spark, sf_dir).select(*cols).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
