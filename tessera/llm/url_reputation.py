"""URL filters: fixed rules, and an empirical-Bayes reputation of hosts.

Labelled outcomes of pages are shrunk through beta-binomial priors: the host towards the other hosts of its registered
domain, the domain towards the other domains of its suffix, the suffix towards all other pages. What a level is shrunk
towards leaves its own outcomes out, so that none counts twice. How strongly each level shrinks is estimated from the
spread of the outcomes between its groups (method of moments). A host is allowed if the lower bound of its beta posterior,
the quantile at `tail`, reaches a limit.

Defined cases: a null URL or one without `://` has empty host and path, and shares one reputation; hosts without labels
take their domain's, suffix's or the overall estimate; repeated labels of a page count once, by the worst; repeated
pages are judged alike; a bound equal to the limit allows; URLs, hosts and paths of any length are judged whole; counts
are taken as doubles, so sums of any size are; without any label the prior mean is one half; other columns are ignored,
whatever their names; no rows give no rows.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

#: Suffixes of two labels that are known unless others are passed in. All others have one.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "ne.jp", "co.kr", "co.in", "co.za", "com.br", "com.mx", "com.ar", "com.cn", "com.tr", "com.sg")
LIMIT = 0.5
#: The posterior probability that lies below the bound.
TAIL = 0.05
#: Strength of shrinking, in pages: bounds of the estimate.
WEAKEST, STRONGEST = 1.0, 1000.0


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; rules look like `example.org/en/` and fit all subdomains."""
    rule = verdict = F.lit(None).cast("string")
    for text in sorted(rules, key=lambda x: (len(x), x)):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, rules[text]).otherwise(verdict)
    return rule, verdict


def _bare(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def suffix_of(host: Column, two_labels: Iterable[str] = TWO_LABELS) -> Column:
    """The public suffix of a host without user and port; empty for an address in digits."""
    bare = _bare(host)
    last, two = F.substring_index(bare, ".", -1), F.substring_index(bare, ".", -2)
    return F.when(bare.rlike("^[0-9.]*$"), "").when(two.isin(*two_labels), two).otherwise(last)


def domain_of(host: Column, two_labels: Iterable[str] = TWO_LABELS) -> Column:
    """The registered domain: the suffix and one more label, or the bare host if there is none."""
    bare = _bare(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(bare.rlike("^[0-9.]*$"), bare).when(two.isin(*two_labels), F.substring_index(bare, ".", -3)).otherwise(two)


def _strength(groups: DataFrame) -> float:
    """Pages that the prior of a level counts for, from groups(good, n)."""
    good, n = F.col("good").cast("double"), F.col("n").cast("double")
    s = groups.where("n > 0").agg(F.count("*").alias("g"), F.sum(n).alias("n"), F.sum(good).alias("k"), F.sum(n * n).alias("nn"), F.sum(good * good / n).alias("kk")).first()
    if not s.g or s.g < 2 or not 0 < s.k < s.n:
        return STRONGEST
    mean = s.k / s.n
    spread = s.kk - 2 * mean * s.k + mean * mean * s.n
    between = (spread - (s.g - 1) * mean * (1 - mean)) / (s.n - s.nn / s.n) if s.nn < s.n * s.n else 0.0
    rho = between / (mean * (1 - mean))
    return min(STRONGEST, max(WEAKEST, 1 / rho - 1)) if rho > 0 else STRONGEST


_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def beta_below(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """P(Beta(a, b) <= x): the regularised incomplete beta function, by its continued fraction."""
    turned = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(turned, 1 - x, x), np.where(turned, b, a), np.where(turned, a, b)
    inside = (x > 0) & (x < 1)
    y = np.where(inside, x, 0.5)
    front = np.exp((_lgamma(a + b) - _lgamma(a) - _lgamma(b)).astype(float) + a * np.log(y) + b * np.log1p(-y)) / a
    tiny = 1e-300
    nudge = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(y), 1 / nudge(1 - (a + b) * y / (a + 1))
    value, m = d.copy(), 1
    while True:
        even = m * (b - m) * y / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / nudge(1 + even * d), nudge(1 + even / c)
        value *= d * c
        odd = -(a + m) * (a + b + m) * y / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / nudge(1 + odd * d), nudge(1 + odd / c)
        value *= d * c
        if np.all(np.abs(d * c - 1) < 1e-14) or m > 100_000:
            break
        m += 1
    part = np.where(inside, front * value, (x >= 1).astype(float))
    return np.clip(np.where(turned, 1 - part, part), 0, 1)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x with P(Beta(a, b) <= x) = p, by bisection."""
    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(52):
        mid = (low + high) / 2
        under = beta_below(mid, a, b) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def reputations(hosts: DataFrame, tail: float = TAIL, limit: float = LIMIT, two_labels: Iterable[str] = TWO_LABELS) -> DataFrame:
    """Rows (host, mean, bound, risk) for hosts(host, good, n): posterior mean, its lower bound, P(share of good < limit).

    Hosts, domains and suffixes are joined on their keys; only the numbers of each level come to the driver.
    """
    named = hosts.select("host", domain_of(F.col("host"), two_labels).alias("domain"), suffix_of(F.col("host"), two_labels).alias("suffix"), F.col("good").cast("double").alias("good"), F.col("n").cast("double").alias("n"))
    sums = [F.sum("good").alias("good"), F.sum("n").alias("n")]
    domains = settled(named.groupBy("domain", "suffix").agg(*sums))
    suffixes = domains.groupBy("suffix").agg(*sums)
    total = suffixes.agg(*sums).first()
    by_suffix, by_domain, by_host = _strength(suffixes), _strength(domains), _strength(named)

    def towards(good: Column, n: Column, own: str, strength: float, prior: Column) -> Column:
        """The mean of the rest of a group, without the outcomes of `own`, shrunk towards `prior`."""
        return (good - F.col(f"{own}good") + strength * prior) / (n - F.col(f"{own}n") + strength)

    rest = (F.lit(total.good or 0.0) - F.col("s_good") + 1.0) / (F.lit(total.n or 0.0) - F.col("s_n") + 2.0)
    suffixes = suffixes.select("suffix", F.col("good").alias("s_good"), F.col("n").alias("s_n"))
    domains = domains.withColumnsRenamed({"good": "d_good", "n": "d_n"}).join(suffixes, "suffix")
    domains = domains.select("domain", "suffix", "d_good", "d_n", towards(F.col("s_good"), F.col("s_n"), "d_", by_suffix, rest).alias("above"))
    out = named.join(domains, ["domain", "suffix"])
    prior = towards(F.col("d_good"), F.col("d_n"), "", by_domain, F.col("above"))
    posterior = out.select("host", (F.col("good") + by_host * prior).alias("a"), (F.col("n") - F.col("good") + by_host * (1 - prior)).alias("b"))

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            a, b = x.a.to_numpy(), x.b.to_numpy()
            yield pd.DataFrame({"host": x.host, "mean": a / (a + b), "bound": beta_quantile(tail, a, b), "risk": beta_below(np.full_like(a, limit), a, b)})

    return posterior.mapInPandas(bounds, "host string, mean double, bound double, risk double")


def judge(pages: DataFrame, outcomes: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", limit: float = LIMIT, tail: float = TAIL, two_labels: Iterable[str] = TWO_LABELS) -> DataFrame:
    """Rows (id, host, path, rule, verdict, bound, risk) of all pages. outcomes(host, good 0/1): one row a labelled page."""
    url = F.col(f"`{url_col}`")
    own = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    labelled = outcomes.groupBy("host").agg(F.sum("good").alias("good"), F.count("good").alias("n"))
    unlabelled = own.groupBy("host").agg(F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("n"))
    hosts = settled(labelled.unionByName(unlabelled).groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = own.join(reputations(hosts, tail, limit, two_labels).select("host", "bound", "risk"), "host", "left")
    method = F.when(F.col("bound") >= limit, "allow").otherwise("block")
    return judged.select("id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "bound", "risk")
