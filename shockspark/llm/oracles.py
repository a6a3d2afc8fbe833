"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations


def url_filters() -> str:
    """Every rule tested against every url by plain string comparison."""
    return r"""
with parts as (
  select page_id,
         case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages),
cut as (
  select page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts),
rules(rule_host, rule_path, rule_verdict) as (values
  ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits as (
  select page_id, rule_host || rule_path as rule, rule_verdict as verdict,
         row_number() over (partition by page_id order by length(rule_host || rule_path) desc) as nth
  from cut join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from cut left join (select * from fits where nth = 1) using (page_id)"""


def sharding(shards: list[str], size: int = 8191) -> str:
    """The shards' turns as a recursive query: one claimed slot per step.  A shard's
    candidate list is its preference order; taken slots are a bit list."""
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(shards))
    n = len(shards)
    return f"""
with recursive names(i, name) as (values {names}),
prefs as (
  select list(start order by i) as starts, list(skip order by i) as skips from (
    select i, ('0x' || substr(md5(name || '/offset'), 1, 15))::bigint % {size} as start,
           ('0x' || substr(md5(name || '/skip'), 1, 15))::bigint % {size - 1} + 1 as skip from names)),
fill(step, slot, taken) as (
  select 0, starts[1], list_transform(range({size}), lambda x: x = starts[1]) from prefs
  union all
  select step + 1, next, list_transform(taken, lambda t, x: t or x - 1 = next)
  from (select step, taken, list_filter(
                 list_transform(range({size}), lambda j: (starts[(step + 1) % {n} + 1] + j * skips[(step + 1) % {n} + 1]) % {size}),
                 lambda s: not taken[s + 1])[1] as next
        from fill, prefs where step + 1 < {size})),
owner as (select slot, name as shard from fill join names on i = step % {n}),
keyed as (select doc_id, (('0x' || substr(md5(coalesce('k' || doc_id::varchar, '')), 1, 15))::bigint % {size})::integer as slot from documents)
select doc_id, slot, shard from keyed join owner using (slot)"""


def packing(context: int = 4096, align: int = 64, buckets: int = 8, budget: int = 65_536) -> str:
    """The same programme as a recursive query over the histogram; numbering by one global
    window."""
    return f"""
with recursive cut as (
  select doc_id, unnest(range(greatest(1, ceil(strlen(coalesce(text, '')) / {context}::double)::bigint))) as part,
         strlen(coalesce(text, '')) as tokens from documents),
rows as (
  select doc_id, part, part * {context} as start, least(tokens - part * {context}, {context}) as length,
         greatest(1, ceil(least(tokens - part * {context}, {context}) / {align}::double)::bigint) as bin from cut),
hist as (select bin, count(*) as n, sum(length)::bigint as s from rows group by bin),
sums as (select row_number() over (order by bin) as j, bin, (sum(n) over (order by bin))::bigint as n, (sum(s) over (order by bin))::bigint as s from hist),
edges as (select * from sums union all select 0, 0, 0, 0),
best(k, j, cost, path) as (
  select 0, 0::bigint, 0::bigint, []::bigint[]
  union all
  select m.k + 1, m.j, m.b.cost, m.b.path from (
    select f.k, t.j, min({{'cost': f.cost + t.bin * {align} * (t.n - e.n) - (t.s - e.s), 'i': e.j, 'path': list_append(f.path, t.bin::bigint)}}) as b
    from best f join edges e on e.j = f.j join edges t on t.j > e.j
    where f.k < {buckets} group by f.k, t.j) m),
ends as (select unnest(path) as last from best
         where k = least({buckets}, (select count(*) from hist)) and j = (select count(*) from hist)),
placed as (select r.*, (select min(last) from ends where last >= bin) * {align} as bucket,
                  substr(md5(concat_ws('/', doc_id, part, length)), 1, 3) as shard from rows r),
numbered as (select *, row_number() over (partition by bucket order by shard, doc_id, part, length) - 1 as nth from placed)
select doc_id, part, start, length, bucket, nth // ({budget} // bucket) as batch, nth % ({budget} // bucket) as place from numbered"""


def hard_negatives() -> str:
    """Every anchor's scores with all rows."""
    return """
with shifted as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scored as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_inner_product(a.q, r.q)::bigint as score
  from shifted a join shifted r on a.vec_id <> r.vec_id and len(a.q) = len(r.q) where a.vec_id % 100 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id,
       (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::integer as rank,
       vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 5"""
