"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

import string

_WORDS = "regexp_extract_all(translate(text, '%s', '%s'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')" % (string.ascii_uppercase, string.ascii_lowercase)

op1_decontaminate = f"""
with d as (select row_number() over () as rid, doc_id, coalesce({_WORDS}, []) as w from documents),
b as (select coalesce(cast(item_id as varchar), 'null') as item, {_WORDS} as w from benchmark where text is not null),
g as (select distinct item, least(len(w), 10) as n, array_to_string(w[k:k + 9], ' ') as g from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from b where len(w) > 0)),
s as (select distinct n from g),
p as (select rid, n, k, array_to_string(w[k:k + n - 1], ' ') as g from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as k from d cross join s where len(w) >= n)),
h as (select rid, item, k, p.n from p join g using (n, g)),
c as (select rid, count(distinct spot) as n_hit from (select rid, unnest(range(k, k + n)) as spot from h) group by 1),
i as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item from h) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (rid) left join i using (rid)
"""

op2_suffix_dedup = """
with d as (select row_number() over () as rid, doc_id, coalesce(hex(encode(text)), '') as h from documents),
w as (select rid, doc_id, p, substr(h, cast(2 * p + 1 as bigint), 100) as g from (select rid, doc_id, h, unnest(range(0, length(h) // 2 - 49)) as p from d where length(h) >= 100)),
m as (select g, min(doc_id) as first from w group by 1),
r as (select rid, p from w join m using (g) where first < doc_id or (doc_id is null and first is not null)),
e as (select rid, p, case when p <= lag(p) over (partition by rid order by p) + 50 then 0 else 1 end as new from r),
s as (select rid, min(p) as a, max(p) + 50 as z from (select rid, p, sum(new) over (partition by rid order by p rows unbounded preceding) as k from e) group by rid, k),
c as (select rid, a, z, lag(z, 1, 0) over (partition by rid order by a) as before from s),
k as (select rid, count(*) as n_spans, sum(z - a) as n_removed, max(z) as last, string_agg(substr(h, cast(2 * before + 1 as bigint), cast(2 * (a - before) as bigint)), '' order by a) as kept from c join d using (rid) group by rid)
select doc_id, length(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, cast(2 * coalesce(last, 0) + 1 as bigint)))) as kept_sha256
from d left join k using (rid)
"""

op7_similar = f"""
with recursive d as (select row_number() over (order by doc_id) as rid, doc_id, coalesce({_WORDS}, []) as w from documents),
s as (select distinct rid, array_to_string(w[k:k + 4], ' ') as g from (select rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as k from d where len(w) > 0)),
n as (select rid, count(*) as n from s group by 1),
o as (select a.rid as a, b.rid as b, count(*) as common from s a join s b on a.g = b.g and a.rid < b.rid group by 1, 2),
l as (select a, b from o join n x on x.rid = a join n y on y.rid = b where common >= 0.8 * (x.n + y.n - common) - 1e-9),
e as (select a, b from l union all select b, a from l),
t as (select a, a as b from e union select t.a, e.b from t join e on t.b = e.a),
c as (select t.a as rid, min(doc_id) as class_id from t join d on d.rid = t.b group by 1),
k as (select a as rid, count(*) as n_links from e group by 1)
select doc_id, coalesce(class_id, doc_id) as class_id, coalesce(n_links, 0) as n_links from d left join c using (rid) left join k using (rid)
"""

_KEY = "cast('0x' || substr(md5(concat_ws('|', 'mix-1', {})), 1, 13) as bigint)"



def _halved(level: int) -> str:
    """The urns of a level, halved: one colour after the other, each a hypergeometric number by the inverse of its
    distribution (weights by lgamma)."""
    weight = "lgamma(k + 1) + lgamma(c - k + 1) + lgamma(n - k + 1) + lgamma(rest - c - n + k + 1)"
    sd = "sqrt(greatest(0.0, n * c / greatest(rest, 1.0) * (1 - c / greatest(rest, 1.0)) * (rest - n) / greatest(rest - 1, 1.0)))"
    at = f"""select *, cast(greatest(0, n - (rest - c), mode - reach) as bigint) as lo, cast(least(n, c, mode + reach) as bigint) as hi from (
      select *, floor((n + 1) * (c + 1) / (rest + 2)) as mode, ceil({sd} * 8) + 8 as reach from (select *, cast(counts[i + 1] as double) as c, {_KEY.format(f"'urn', cast(node + {1 << level} as varchar), cast(i as varchar)")} / 4503599627370496.0 as unit from h{level} where i < len(counts)))"""
    weights = f"select *, list_transform(range(lo, hi + 1), lambda k: exp(top - ({weight}))) as ws from (select *, {weight.replace('k', 'cast(least(greatest(mode, lo), hi) as bigint)')} as top from ({at}))"
    sums = f"select *, list_transform(range(1, len(ws) + 1), lambda m: list_sum(ws[1:m])) as sums from ({weights})"
    drawn = f"select *, case when rest > 0 then least(hi, lo + len(list_filter(sums, lambda s: s <= unit * sums[len(sums)]))) else 0 end as x from ({sums})"
    return f"""h{level} as (select node, counts, 0 as i, cast(floor(list_sum(counts) / 2) as double) as n, cast(list_sum(counts) as double) as rest, cast([] as bigint[]) as drawn from n{level}
  union all select node, counts, i + 1, n - x, rest - c, list_append(drawn, cast(x as bigint)) from ({drawn})),
n{level + 1} as (select 2 * node + side as node, list_transform(range(1, len(counts) + 1), lambda k: cast(case when side = 0 then drawn[k] else counts[k] - drawn[k] end as bigint)) as counts from h{level}, (values (0), (1)) as t(side) where i = len(counts))"""


op8_mix = f"""
with recursive r as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size, {_KEY.format("coalesce(cast(doc_id as varchar), '-')")} as mixed from documents),
s as (select source, count(*) as docs, cast(sum(size) as bigint) as source_size from r group by 1),
t as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight, source_size * 3 as cap, sum(source_size) over () as total from s),
u as (select *, (total - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level from t),
v as (select *, least(cap, weight * (select arg_min(level, cap / weight) from u where level <= cap / weight)) as target from u),
p as (select r.*, source_size, target, mixed % 4096 as block from r join v on r.source is not distinct from v.source),
b as (select source, block, sum(size) as block_size, any_value(source_size) as source_size, cast(round(any_value(target)) as bigint) as goal from p group by 1, 2),
c as (select *, case when source_size > 0 then goal // source_size else 0 end as epochs, row_number() over (partition by source order by {_KEY.format("coalesce(source, '-'), cast(block as varchar)")}, block) as turn, count(*) over (partition by source) as blocks from b),
e as (select *, goal - epochs * source_size as rest, sum(block_size) over (partition by source order by turn) as upto from c),
f as (select source, block, turn, blocks, epochs + case when upto <= rest then 1 else 0 end as whole, case when upto > rest and upto - block_size < rest then rest - upto + block_size else 0 end as part from e),
g as (select p.*, part, least(size, part + size - sum(size) over (partition by p.source order by mixed, doc_id, size rows unbounded preceding)) as words from p join f on p.source is not distinct from f.source and p.block = f.block where part > 0 and size > 0),
k as (select source, block, doc_id, size, words from g where words > 0),
n0 as (select 0 as node, list(cast(draws as bigint) order by source nulls last) as counts from (select source, sum(whole + case when part > 0 then 1 else 0 end) as draws from f group by 1)),
{", ".join(_halved(level) for level in range(4))},
o as (select source, row_number() over (order by source nulls last) as i from s),
q as (select source, node as shard, sum(counts[i]) over (partition by source order by node) as upto, counts[i] as quota from n4, o),
d as (select source, block, epoch, epoch < whole as entire, row_number() over (partition by source order by epoch * blocks + turn) - 1 as number from (select *, unnest(range(0, cast(whole + case when part > 0 then 1 else 0 end as bigint))) as epoch from f)),
w as (select d.*, cast(1 as bigint) << cast(shard as integer) as bit from d join q on d.source is not distinct from q.source and number < upto and number >= upto - quota),
x as (select doc_id, p.source, size, bit, size as words from p join w on p.source is not distinct from w.source and p.block = w.block where entire and size > 0
  union all select doc_id, k.source, size, bit, words from k join w on k.source is not distinct from w.source and k.block = w.block where not entire),
y as (select doc_id, source, sum(words) as taken, bit_or(bit) as shards from x group by 1, 2)
select p.doc_id, size, source_size, cast(target as double) as target, cast(coalesce(taken, 0) as bigint) as taken, coalesce(shards, 0) as shards from p left join y on p.doc_id = y.doc_id and p.source is not distinct from y.source
"""

ORACLES = {"op1_decontaminate": op1_decontaminate, "op2_suffix_dedup": op2_suffix_dedup, "op7_similar": op7_similar, "op8_mix": op8_mix}
