"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op8_warc"] = """
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as hexed from pages
), w as (
  select hexed, max(page_id) as winner, count(*) as n from p group by hexed
), digits as (
  select p.page_id, p.payload_bytes, p.hexed,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(p.hexed, 1 + 5 * (i // 4)::int, 5))::bigint >> (5 * (3 - i % 4))::int) & 31)::int, 1)), '') as payload_digest
  from p
)
select d.page_id, d.payload_bytes::bigint as payload_bytes, d.payload_digest,
  case when w.n > 1 and d.page_id is distinct from w.winner and w.winner is not null then 'revisit' else 'response' end as record_type,
  case when w.n > 1 and d.page_id is distinct from w.winner then w.winner end as refers_to
from digits d join w using (hexed)
"""

_LABELLED = """
labelled as (
  select doc_id, min(case when quality = 1 and toxic = 0 then 1 else 0 end) as good from labels group by doc_id
), own as (
  select page_id, url,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path,
    try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) as bigint) as doc_id
  from pages
), hosts as (
  select host, coalesce(sum(good), 0)::bigint as good, count(good) as n from own left join labelled using (doc_id) group by host
), bare as (
  select *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as b from hosts
), named as (
  select host, good, n,
    case when regexp_matches(b, '^[0-9.]*$') then ''
      when array_to_string(string_split(b, '.')[-2:], '.') in {two} then array_to_string(string_split(b, '.')[-2:], '.')
      else string_split(b, '.')[-1] end as suffix,
    case when regexp_matches(b, '^[0-9.]*$') then b
      when array_to_string(string_split(b, '.')[-2:], '.') in {two} then array_to_string(string_split(b, '.')[-3:], '.')
      else array_to_string(string_split(b, '.')[-2:], '.') end as domain
  from bare
), domains as (
  select domain, suffix, sum(good)::bigint as good, sum(n)::bigint as n from named group by domain, suffix
), suffixes as (
  select suffix, sum(good)::bigint as good, sum(n)::bigint as n from named group by suffix
)"""


def _strength(name: str) -> str:
    """A CTE with the shrinking strength k of the level `name`, by the method of moments."""
    return f""", s_{name} as (
  select count(*) as g, sum(n)::double as n, sum(good)::double as k, sum(n::double * n) as nn, sum(good::double * good / n) as kk from {name} where n > 0
), r_{name} as (
  select g, n, k, case when g >= 2 and k > 0 and k < n and nn < n * n then
    ((kk - 2 * (k / n) * k + (k / n) * (k / n) * n - (g - 1) * (k / n) * (1 - k / n)) / (n - nn / n)) / ((k / n) * (1 - k / n)) end as rho from s_{name}
), k_{name} as (select case when rho > 0 then least(1000.0, greatest(1.0, 1 / rho - 1)) else 1000.0 end as k from r_{name})"""


def reputation_sql(two_labels: tuple[str, ...], rules: dict[str, str], limit: float, tail: float) -> str:
    """op1; the posterior's probability below the limit is summed up from its series of positive terms."""
    two = "(" + ", ".join(f"'{x}'" for x in two_labels) + ")"
    cases: dict[str, str] = {}
    for text in sorted(rules, key=lambda x: (-len(x), x)):
        name, slash, rest = text.partition("/")
        cases[text] = f"(o.host = '{name}' or ends_with(o.host, '.{name}')) and starts_with(o.path, '{slash + rest}')"
    rule = "case " + " ".join(f"when {c} then '{t}'" for t, c in cases.items()) + " end"
    verdict = "case " + " ".join(f"when {c} then '{rules[t]}'" for t, c in cases.items()) + f" when j.risk <= {tail} then 'allow' else 'block' end"
    return (
        "with " + _LABELLED.format(two=two) + _strength("suffixes") + _strength("domains") + _strength("named")
        + f""", total as (select coalesce(sum(good), 0) as good, coalesce(sum(n), 0) as n from suffixes
), sm as (
  select suffix, s.good, s.n, (t.good - s.good + 1.0) / (t.n - s.n + 2.0) as rest from suffixes s, total t
), dm as (
  select d.domain, d.suffix, d.good, d.n, (s.good - d.good + ks.k * s.rest) / (s.n - d.n + ks.k) as above from domains d join sm s using (suffix), k_suffixes ks
), hm as (
  select h.host, h.good, h.n, kh.k, (d.good - h.good + kd.k * d.above) / (d.n - h.n + kd.k) as prior
  from named h join dm d on h.domain = d.domain and h.suffix = d.suffix, k_domains kd, k_named kh
), post as (
  select host, good + k * prior as a, n - good + k * (1 - prior) as b from hm
), shapes as (
  select distinct a, b from post
), risks as (
  select a, b, least(1.0, sum(exp((a + i) * ln({limit}) + b * ln(1 - {limit}) + lgamma(a + b + i) - lgamma(b) - lgamma(a + 1 + i)))) as risk
  from shapes, (select unnest(range(20000)) as i) group by a, b
), judged as (
  select host, risk from post join risks using (a, b)
)
select o.page_id, o.host, o.path, {rule} as rule, {verdict} as verdict, round(1000 * j.risk)::bigint as risk_permille from own o join judged j using (host)"""
    )


def chat_sql(control: tuple[str, ...], own: str) -> str:
    """op3 from the turns alone; `control` holds the escaped strings, `own` the text of conversation -7."""

    def escaped(c: str) -> str:
        c = f"replace({c}, '\\', '\\\\')"
        for x in control:
            c = f"replace({c}, '{x}', '{x[0]}\\{x[1:]}')"
        return c

    return f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '{own}'), (-7, 1, 'assistant', '{own}')
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length({escaped("role")}) + length({escaped("text")}) + {len("<|turn|>") + len("<|end|>") + 2})::bigint as formatted_chars
from t group by conv_id"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII string, bit by bit."""
    byte = "list_reduce(list_prepend(xor(c, ascii(x)::bigint), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda b, z: xor(b >> 1, (b & 1) * 3988292384))"
    codes = f"list_transform(string_split({text}, ''), lambda y: ascii(y)::bigint)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, x: {byte.replace('ascii(x)::bigint', 'x')}))"


#: op13: words equal `q` apart, islands of such places, and of equal stretches that with the smallest period.
ORACLES["op13_periodic_runs"] = f"""
with own as (
  select row_number() over () as r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') as ws,
    {crc32_sql("doc_id::varchar")} as h from documents
), sized as (
  select *, len(ws) as n, h // 10 as g from own
), cut as (
  select *, case when h % 10 = 0 and n > 0 then g % n end as a from sized
), looped as (
  select *, 1 + (n - a) // (3 + g % 8) as p from cut
), words as (
  select r, i, case when a is not null and i >= a then ws[1 + a + (i - a) % p] else ws[1 + i] end as w
  from (select *, unnest(range(n)) as i from looped)
), pairs as (
  select x.r, y.i - x.i as q, x.i from words x join words y on x.r = y.r and x.w = y.w and y.i > x.i
), islands as (
  select r, q, min(i) as s, max(i) + 1 + q as e from (select *, i - row_number() over (partition by r, q order by i) as k from pairs) group by r, q, k
  having count(*) >= greatest(q, 12 - q)
), runs as (
  select r, s, e - s as l, min(q) as q from islands group by r, s, e
), listed as (
  select r, count(*) as n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as t, min((-l, s, q)) as best from runs group by r
), gone as (
  select distinct r, unnest(range(s + q, s + l)) as i from runs
), kept as (
  select r, string_agg(w, ' ' order by i) as t from words anti join gone using (r, i) group by r
)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, best[2]::bigint as start, (-best[1])::bigint as length, best[3]::bigint as period,
  (1000 * -best[1] // best[3])::bigint as exponent_milli, sha256(coalesce(listed.t, '')) as runs_sha256, sha256(coalesce(kept.t, '')) as collapsed_sha256
from own left join listed using (r) left join kept using (r)"""


def _tree(name: str, levels: int) -> str:
    """CTEs for the nodes of a tree, `{name}0 (g, i, h, n)` being its leaves, and for what stands left and right of each."""
    out = ""
    for k in range(levels):
        run = "partition by g, i // 16 order by i rows between"
        out += f""", {name}s{k} as (
  select g, i, coalesce(string_agg(h, '') over ({run} unbounded preceding and 1 preceding), '') as l,
    coalesce(string_agg(h, '') over ({run} 1 following and unbounded following), '') as r from {name}{k} where n > 1
), {name}{k + 1} as (
  select g, i // 16 as i, sha256(string_agg(h, '' order by i)) as h, any_value((n + 15) // 16) as n from {name}{k} where n > 1 group by g, i // 16
)"""
    tops = " union all ".join(f"select g, h from {name}{k} where n = 1" for k in range(levels + 1))
    return out + f", {name}top as ({tops})"


def merkle_sql(levels: int = 8) -> str:
    """op11 for up to 16 ** levels leaves a source and as many sources."""
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    steps = ""
    for tree in ("a", "b"):
        for k in range(levels):
            first = "select g, i, leaf, doc_id, r, f as f, '' as p from own" if (tree, k) == ("a", 0) else None
            steps += "" if first is None else f", w0 as ({first})"
            at = k + (levels if tree == "b" else 0)
            if tree == "b" and k == 0:
                steps += f", w{at}b as (select w.* exclude (g, i), '' as g, c.i, w.g as own_g from w{at} w join b0s c on c.source = w.g)"
            source = f"w{at}b" if tree == "b" and k == 0 else f"w{at}"
            steps += f""", w{at + 1} as (
  select w.* replace (w.i // 16 as i, case when s.i is null then w.f else sha256(s.l || w.f || s.r) end as f, w.p || coalesce(s.l || s.r, '') as p)
  from {source} w left join {tree}s{k} s on s.g = w.g and s.i = w.i
)"""
    return f"""
with leaves as (
  select doc_id, coalesce('=' || source, '-') as g, row_number() over () as r, {leaf("text")} as leaf,
    case when {crc32_sql("doc_id::varchar")} % 5 = 0 and doc_id is not null then {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as other
  from documents
), own as (
  select *, coalesce(other, leaf) as f, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n from leaves
), a0 as (
  select g, i, leaf as h, n from own
){_tree("a", levels)}, b0s as (
  select g as source, h, row_number() over (order by g) - 1 as i, count(*) over () as n from atop
), b0 as (
  select '' as g, i, h, n from b0s
){_tree("b", levels)}{steps}
select w.doc_id, w.leaf, c.h as subroot, t.h as root, sha256(w.p) as proof_sha256, w.f as folded_root, w.f = t.h as verified
from w{2 * levels} w join b0s c on c.source = w.own_g cross join btop t"""


ORACLES["op11_merkle_manifest"] = merkle_sql()
