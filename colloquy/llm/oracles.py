"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

OP4_MIXING = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    -ln((cast('0x' || substr(md5('mix-1:' || doc_id), 1, 12) as bigint) + 0.5) / 281474976710656.0)
      / (0.1 + 0.9 * length(regexp_replace(coalesce(text, ''), '[^\p{L} ]+', '', 'g')) / greatest(length(coalesce(text, '')), 1)) as key
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3.0 when 1 then 1.0 else 2.0 end as weight, source_size * 2.0 as cap from s),
f as (select *, ((select sum(source_size) from s) * 1.5 - coalesce(sum(cap) over before, 0)) / ((select sum(weight) from r) - coalesce(sum(weight) over before, 0)) as level
  from r window before as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select *, case when cap / weight <= level then cap else weight * (select arg_min(level, cap / weight) from f where cap / weight > level) end as target from f),
p as (select *, case when source_size = 0 then 0 else floor(target / source_size) end as epochs from t),
k as (select d.doc_id, d.size, p.source_size, p.target, p.epochs, round(p.target - p.epochs * p.source_size) as budget,
  coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id rows between unbounded preceding and 1 preceding), 0) as before
  from d join p on d.source is not distinct from p.source)
select doc_id, size, source_size, target, cast(epochs * size + greatest(0, least(size, budget - before)) as bigint) as taken from k
"""

OP7_NEARDUP = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
e as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as (select e.a, e.b from e join n x on x.doc_id = e.a join n y on y.doc_id = e.b where 100 * common >= 75 * (x.n + y.n - common)),
r(a, b) as (select doc_id, doc_id from w union select r.a, l.b from r join l on r.b = l.a),
c as (select a as doc_id, min(b) as component_id from r group by a)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from c left join n using (doc_id)
"""

OP13_FILTERS = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
m as (select doc_id, part, cast(len(w) < 200 as int) + 2 * cast(100 * len(list_distinct(w)) < 50 * len(w) as int) + 4 * cast(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) as int)
    + 8 * cast(regexp_matches(t, '[#$%&*|]') as int) + 16 * cast(min(doc_id) over (partition by t) < doc_id as int) as mask from d),
h as (select part, mask, count(*) as n, count(*) filter (quality = 1) as good, count(*) filter (toxic = 1) as toxic from m left join labels using (doc_id) group by 1, 2),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
o as (select a.c || b.c || x.c || y.c || z.c as filter_order from l a, l b, l x, l y, l z where len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5),
s as (select filter_order, cast(i as int) as step, 1 << (ascii(filter_order[i]) - 65) as own, coalesce(list_sum(list_transform(range(1, i), lambda j: 1 << (ascii(filter_order[j]) - 65))), 0)::int as earlier from o, range(1, 6) r(i)),
r as (select part, filter_order, step, own, cast(sum(case when mask & (own | earlier) = 0 then n else 0 end) as bigint) as kept, cast(sum(case when mask & own <> 0 and mask & earlier = 0 then n else 0 end) as bigint) as removed,
    cast(sum(case when mask & own <> 0 and mask & earlier <> 0 then n else 0 end) as bigint) as redundant, cast(sum(case when mask = own then n else 0 end) as bigint) as unique_fails,
    cast(sum(case when mask & own <> 0 and mask & earlier = 0 then good else 0 end) as bigint) as good_lost, cast(sum(case when mask & own <> 0 and mask & earlier = 0 then toxic else 0 end) as bigint) as toxic_lost
  from h, s group by 1, 2, 3, 4)
select * exclude (own), cast(sum(removed) over (partition by part, own) as bigint) as shapley from r
"""

_FIELD = "coalesce(strlen(cast({0} as varchar)) || ':' || cast({0} as varchar), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_CHANGED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = """xor(list_reduce(flatten(list_prepend([4294967295], list_transform(string_split(cast(doc_id as varchar), ''), lambda c: [cast(ascii(c) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, (c & 1) * 3988292384) end), 4294967295)"""

OP11_MANIFEST = f"""
with recursive d as (select doc_id, coalesce('=' || source, '') as g, {_LEAF.format(text="text")} as leaf, case when {_CRC} % 5 = 0 then {_LEAF.format(text=_CHANGED)} end as tampered from documents),
t(g, level, nodes) as (select g, 0, list(leaf order by doc_id) from d group by g
  union all select g, level + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1:i + 16], ''))) from t where len(nodes) > 1),
s as (select g, nodes[1] as subroot, row_number() over (order by g) - 1 as place from t where len(nodes) = 1),
u(level, nodes) as (select 0, list(subroot order by g) from s
  union all select level + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1:i + 16], ''))) from u where len(nodes) > 1),
p as (select doc_id, g, row_number() over (partition by g order by doc_id) - 1 as place from d),
i as (select doc_id, level, cast(floor(place / pow(16, level)) as bigint) as k, nodes from p join t using (g) where len(nodes) > 1
  union all select doc_id, 1000 + level, cast(floor(s.place / pow(16, level)) as bigint), nodes from p join s using (g), u where len(nodes) > 1),
b as (select doc_id, row_number() over (partition by doc_id order by level) as step, array_to_string(list_filter(nodes, lambda x, j: j > k // 16 * 16 and j <= k), '') as before,
    array_to_string(list_filter(nodes, lambda x, j: j > k + 1 and j <= k // 16 * 16 + 16), '') as after from i),
f(doc_id, step, node) as (select doc_id, 0, coalesce(tampered, leaf) from d union all select doc_id, f.step + 1, sha256(before || node || after) from f join b using (doc_id) where b.step = f.step + 1),
r as (select nodes[1] as root from u where len(nodes) = 1),
h as (select doc_id, sha256(coalesce(string_agg(before || after, '' order by step), '')) as proof_sha256 from d left join b using (doc_id) group by 1),
e as (select doc_id, arg_max(node, step) as folded_root from f group by 1)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from d join s using (g) join h using (doc_id) join e using (doc_id), r
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4_MIXING, "op7_neardup": OP7_NEARDUP, "op11_manifest": OP11_MANIFEST, "op13_filters": OP13_FILTERS}
