"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from collections.abc import Sequence

from ledgerline.llm.rules_ledger import BASE, POLICIES, RULES, mask
from ledgerline.llm.url_filters import (
    DEPTH, REJECT_SHARE, SIMILAR_Z, SMOOTHING, VARIABLE_SHARE, VARIABLE_VALUES, Rule)

WORD = r"[^\x20\x09-\x0D]+"


def quality_rules() -> str:
    bits = " + ".join(f"case when {fails} then {1 << i} else 0 end" for i, fails in enumerate(RULES.values()))
    return rf"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{WORD}')) as l
  from documents),
win as (
  select doc_id, i, w[i] as a, w[i + 1] as b, w[i + 2] as c
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
twice as (select doc_id, a, b, c from win group by all having count(*) > 1),
covered as (
  select doc_id, count(distinct i + k) as n
  from win join twice using (doc_id, a, b, c), (values (0), (1), (2)) as o(k) group by doc_id),
m as (
  select d.doc_id, cast(len(w) as bigint) as n_words,
         cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
         cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
         cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
         cast(coalesce(covered.n, 0) as bigint) as n_repeat_words, len(l) as n_lines,
         len(regexp_extract_all(t, '[A-Z]')) as n_upper, len(regexp_extract_all(t, '[A-Za-z]')) as n_letters,
         len(regexp_extract_all(t, '!')) as n_shouts
  from d left join covered using (doc_id)),
f as (select *, cast({bits} as bigint) as failures from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failures & {mask(BASE)}) <> 0 as base_failed,
       (failures & {mask(BASE + tuple(POLICIES["corpus-2"]))}) = 0 as kept, failures
from f"""


def rule_ablations() -> str:
    """What each rule of each policy rejects, by the failure bits of ``quality_rules``."""
    parts = " union all ".join(
        f"select '{policy}' as policy, '{rule}' as rule, "
        f"coalesce(sum(n) filter (failures & {mask((rule,))} <> 0), 0) as rejected, "
        f"coalesce(sum(n) filter (failures & {mask(names)} = {mask((rule,))}), 0) as only_this from counts"
        for policy, names in POLICIES.items() for rule in names)
    return f"""
with entries as ({quality_rules()}),
counts as (select failures, count(*) as n from entries group by failures)
select policy, rule, cast(rejected as bigint) as rejected, cast(only_this as bigint) as only_this from ({parts}) as q"""


TOP_VECTORS = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, v.vec_id,
         cast(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])), 0) as bigint)
           as score
  from v q join v on q.vec_id % 50 = 0 and q.vec_id <> v.vec_id and len(q.e) = len(v.e))
select query_id, cast(r as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from s)
where r <= 5"""


MIXING = rf"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as bigint) as size,
         md5(concat_ws(':', 'mix-1', cast(doc_id as varchar))) as key
  from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size,
         [5, 2, 1][1 + (row_number() over (order by source is null, source) - 1) % 3] as weight
  from d group by source),
l as (
  select *, cast(sum(source_size) over () - coalesce(sum(3 * source_size) over before, 0) as double)
            / cast(sum(weight) over () - coalesce(sum(weight) over before, 0) as double) as level
  from s
  window before as (order by 3 * source_size / weight, source is null, source
                    rows between unbounded preceding and 1 preceding)),
t as (select *, least(max(level) over () * weight, cast(3 * source_size as double)) as target from l),
p as (
  select d.doc_id, d.size, t.source_size, t.target, cast(floor(t.target + 0.5) as bigint) as budget,
         coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size
                                    rows between unbounded preceding and 1 preceding), 0) as start
  from d join t on d.source is not distinct from t.source),
e as (select *, case when source_size > 0 then budget // source_size else 0 end as whole from p),
r as (select *, budget - whole * source_size - start as rest from e)
select doc_id, size, source_size, target,
       cast(size * (whole + case when size <= rest or (rest > 0 and 2 * rest >= size) then 1 else 0 end) as bigint)
         as taken
from r"""


def url_filters(rules: Sequence[Rule]) -> str:
    """The template tree level by level, as common table expressions."""
    own = f"""case when n < 2 or abs(bad / n - p) <= {SIMILAR_Z} * sqrt(p * (1 - p) / n) then p
              else (bad + {SMOOTHING} * p) / (n + {SMOOTHING}) end as share"""
    levels, shares = "", ""
    for i in range(DEPTH + 1):
        levels += f"""
v{i} as (select host, t{i}, coalesce(shape[{i + 1}], '') as seg, sum(pages) as pages from n{i} group by all),
w{i} as (select host, t{i}, count(*) > {VARIABLE_VALUES} and count(*) > {VARIABLE_SHARE} * sum(pages) as varies
       from v{i} group by all),
n{i + 1} as (select n{i}.*, case when len(shape) <= {i} then t{i}
                  else t{i} || '/' || case when varies then '*' else shape[{i + 1}] end end as t{i + 1}
       from n{i} join w{i} using (host, t{i})),"""
        shares += f"""
s{i + 1} as (select host, t{i + 1}, {own}
       from (select c.*, s{i}.share as p from
               (select host, t{i}, t{i + 1}, cast(sum(n) as double) as n, cast(sum(bad) as double) as bad
                from n{DEPTH + 1} group by all) c
             join s{i} using (host, t{i}))),"""
    length = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    fits = [(v, h + p, f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')") for v, h, p in length]
    rule = "case " + " ".join(f"when {fit} then '{text}'" for _, text, fit in fits) + " end"
    verdict = "case " + " ".join(f"when {fit} then '{v}'" for v, _, fit in fits) + " end"
    last = DEPTH + 1
    return rf"""
with u as (
  select page_id, lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')) as host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
  from pages),
sp as (
  select *, string_split(regexp_replace(ltrim(path, '/'), '[0-9]+', '#', 'g'), '/') as parts,
         try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})[^/]*/?$', 1), '') as bigint) as doc_id
  from u),
sh as (
  select * exclude (parts), case when len(parts) <= {DEPTH} then parts
           else list_append(parts[1:{DEPTH}], array_to_string(parts[{last}:], '/')) end as shape
  from sp),
marks as (
  select page_id, max(case when quality = 0 or toxic = 1 then 1 when quality = 1 or toxic = 0 then 0 end) as bad
  from sh join labels using (doc_id) group by page_id),
n0 as (
  select host, shape, count(*) as pages, cast(count(bad) as double) as n,
         cast(coalesce(sum(bad), 0) as double) as bad, '' as t0
  from sh left join marks using (page_id) group by host, shape),{levels}
s0 as (
  select host, t0, {own}
  from (select host, t0, sum(n) as n, sum(bad) as bad,
               (select (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) from n0) as p
        from n{last} group by host, t0)),{shares}
tree as (select host, shape, t{last} as template, share from n{last} join s{last} using (host, t{last}))
select page_id, host, path, {rule} as rule,
       coalesce({verdict}, case when share > {REJECT_SHARE} then 'block' else 'allow' end) as verdict, template
from sh join tree using (host, shape)"""


def near_duplicates_sql(n: int) -> str:
    """All pairs that share a shingle, then what is reachable over links."""
    return rf"""
with recursive d as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w
  from documents),
s as (
  select distinct doc_id, g from (
    select doc_id, unnest(case when len(w) = 0 then [] when len(w) < {n} then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) end) as g
    from d)),
c as (select doc_id, count(*) as n from s group by doc_id),
links as (
  select a, b from (
    select x.doc_id as a, y.doc_id as b, count(*) as common
    from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all) p
  join c ca on ca.doc_id = a join c cb on cb.doc_id = b
  where 100 * common >= 80 * (ca.n + cb.n - common)),
reach as (
  select doc_id, doc_id as seen from d
  union
  select doc_id, b from reach join links on seen = a)
select d.doc_id, coalesce(c.n, 0) as n_shingles, r.component_id, d.doc_id = r.component_id as kept
from d left join c using (doc_id)
join (select doc_id, min(seen) as component_id from reach group by doc_id) r using (doc_id)"""


def filter_audit() -> str:
    """Rows counted by the bits they fail, then every step of every order over those counts."""
    names = "ABCDE"
    bits = ", ".join(f"('{name}', {1 << i})" for i, name in enumerate(names))
    joins = " ".join(
        f"join f as {name} on " + " and ".join(f"{name}.bit <> {earlier}.bit" for earlier in names[:i])
        for i, name in enumerate(names) if i)
    order, taken = " || ".join(f"{n}.name" for n in names), ", ".join(f"{n}.bit" for n in names)
    return rf"""
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '{WORD}') as w
  from documents),
firsts as (select t, min(doc_id) as first from d group by t),
marks as (
  select doc_id, coalesce(max(cast(quality = 1 as int)), 0) as good, coalesce(max(cast(toxic = 1 as int)), 0) as toxic
  from labels group by doc_id),
b as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
         cast(len(w) < 200 as int) + 2 * cast(100 * len(list_distinct(w)) < 50 * len(w) as int)
         + 4 * cast(100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) as int)
         + 8 * cast(regexp_matches(t, '[#$%&*|]') as int) + 16 * cast(coalesce(doc_id > first, false) as int) as bits
  from d join firsts using (t) left join marks using (doc_id)),
p as (select part, bits, count(*) as n, sum(good) as good, sum(toxic) as toxic from b group by all),
f(name, bit) as (values {bits}),
o as (select {order} as filter_order, [{taken}] as taken from f as A {joins}),
s as (
  select filter_order, i as step, taken[i] as bit, coalesce(list_sum(taken[1:i - 1]), 0) as before
  from o, unnest(range(1, 6)) as r(i)),
c as (
  select part, filter_order, step, bit,
         coalesce(sum(n) filter (bits & (before + bit) = 0), 0) as kept,
         coalesce(sum(n) filter (bits & bit <> 0 and bits & before = 0), 0) as removed,
         coalesce(sum(n) filter (bits & bit <> 0 and bits & before <> 0), 0) as redundant,
         coalesce(sum(n) filter (bits = bit), 0) as unique_fails,
         coalesce(sum(good) filter (bits & bit <> 0 and bits & before = 0), 0) as good_lost,
         coalesce(sum(toxic) filter (bits & bit <> 0 and bits & before = 0), 0) as toxic_lost
  from p, (select filter_order, step, cast(bit as bigint) as bit, cast(before as bigint) as before from s)
  group by all)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept,
       cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
       cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
       cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from c"""


def resampling() -> str:
    """CRC-32 bit by bit of the distinct words, the rest as the formulas say."""
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
with d as materialized (select doc_id, row_number() over () as own, regexp_extract_all({lower}, '{words}') as w from documents),
f as (select own, unnest(w) as w from d),
b as (select unnest(regexp_extract_all({lower}, '{words}')) as w from benchmark),
bytes as (
  select w, list_transform(range(1, octet_length(encode(w)) + 1),
         lambda i: cast('0x' || substr(hex(encode(w)), cast(2 * i - 1 as int), 2) as bigint)) as x
  from (select w from f union select w from b)),
k as (
  select w, xor(list_reduce(list_concat([4294967295], x), lambda c, y: list_reduce(
           list_concat([xor(c, y)], [0, 0, 0, 0, 0, 0, 0, 0]),
           lambda r, z: xor(r >> 1, case when r & 1 = 1 then 3988292384 else 0 end))), 4294967295) % 10000 as bucket
  from bytes),
s as (select bucket, cast(count(*) as double) as s from f join k using (w) group by bucket),
t as (select bucket, cast(count(*) as double) as t from b join k using (w) group by bucket),
g as (
  select bucket, cast(floor(1000 * ln(((coalesce(t, 0) + 1) * (coalesce((select sum(s) from s), 0) + 10000))
         / ((coalesce(s, 0) + 1) * (coalesce((select sum(t) from t), 0) + 10000)))) as bigint) as gain
  from s full join t using (bucket)),
m as (
  select own, cast(count(*) as bigint) as n_features, cast(sum(gain) as bigint) as weight
  from f join k using (w) join g using (bucket) group by own),
r as (
  select doc_id, own, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast(cast('0x' || substr(sha256('2024:' || coalesce(
           cast(doc_id as varchar), '')), 1, 8) as bigint) as double) + 0.5) / 4294967296))) as bigint) as score
  from d left join m using (own)),
e as (
  select own, row_number() over (order by score desc, doc_id nulls last, n_features) as rank,
         count(*) over () as n
  from r where n_words >= 20)
select doc_id, n_features, weight, score, cast(rank as bigint) as rank
from r left join (select own, rank from e where rank <= 10 * n // 100) using (own)"""
