"""DuckDB SQL of the operators on vectors, archives and spelling, written another way than the operators."""

from __future__ import annotations


def clusters_sql(k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """All distances in every round, unrolled."""
    d = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    out = f"""with kept as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings
  where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {size}),
c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id), v) - 1 as k, v from kept order by sha256('{seed}:' || vec_id), v limit {k})"""
    for i in range(rounds + 1):
        out += f""",
a{i} as materialized (select r, any_value(vec_id) as vec_id, any_value(v) as v, min({{'d': d, 'k': k}}) as b from (select x.r, x.vec_id, x.v, c.k, {d} as d from kept x, c{i} c) group by r)"""
        if i < rounds:
            out += f""",
s{i} as (select k, p, sum(x)::bigint as s, count(*) as n from (select b.k as k, unnest(v) as x, generate_subscripts(v, 1) as p from a{i}) group by k, p),
m{i} as (select k, list((s - (((s % n) + n) % n)) // n order by p) as v from s{i} group by k),
c{i + 1} as materialized (select c.k, coalesce(m.v, c.v) as v from c{i} c left join m{i} m using (k))"""
    return out + f"""
select vec_id, b.k::integer as cluster, b.d as distance, (sum(b.d) over (partition by b.k))::bigint as cluster_inertia, (sum(b.d) over ())::bigint as inertia,
  (select sha256(array_to_string(c.v, ',')) from c{rounds} c where c.k = b.k) as centroid_sha256 from a{rounds}"""


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * i + 1}, 5))::integer >> {s}) & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))

WARC_SQL = f"""with p as (select page_id, url, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
r as (select *, row_number() over (partition by html order by page_id nulls last, url nulls last) as nth, first_value(page_id) over (partition by html order by page_id nulls last, url nulls last) as lead_ from p)
select page_id, strlen(html)::bigint as payload_bytes, {_BASE32} as payload_digest, case when nth = 1 then 'response' else 'revisit' end as record_type,
  case when nth > 1 then lead_ end as refers_to from r"""

#: crc32 byte by byte from its table, which recursion makes; pairs of near words one by one.
SPELLING_SQL = """with recursive bits(i, c, k) as (select i, i::bigint, 0 from range(256) as t(i) union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
crc as materialized (select list(c order by i) as t from bits where k = 8),
runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as w from documents),
seen as (select doc_id, w, count(*) as n from runs where length(w) >= 6 group by 1, 2),
hashed as (select w, n, xor(list_reduce(list_transform(range(strlen(s)), lambda i: ('0x' || substr(x, 2 * i::integer + 1, 2))::bigint), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295::bigint), 4294967295::bigint) as h
  from (select w, n, coalesce(doc_id::varchar, 'null') || ':' || w as s, hex(encode(coalesce(doc_id::varchar, 'null') || ':' || w)) as x from seen), crc),
edited as (select case when h % 199 = 0 then substr(w, 1, (h % length(w))::integer) || substr(w, (h % length(w))::integer + 2) else w end as w, n from hashed),
words as materialized (select w as word, sum(n)::bigint as n from edited where length(w) >= 6 group by 1 having sum(n) >= 5),
cuts as materialized (select word, n, p, substr(word, 1, p - 1) as a, substr(word, p + 1) as b from (select word, n, unnest(range(1, length(word) + 1))::integer as p from words)),
near as materialized (select x.word, y.word as other, y.n from cuts x join cuts y on x.p = y.p and x.a = y.a and x.b = y.b and x.word <> y.word
  union select x.word, y.word, y.n from cuts x join words y on y.word = x.a || x.b union select y.word, x.word, x.n from cuts x join words y on y.word = x.a || x.b),
best as (select word, count(*) as n_near, first(other order by n desc, other) as other, max(n) as other_n from near group by 1),
formed as materialized (select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 5 * w.n then other end as form, case when other_n >= 5 * w.n then other_n end as form_n from words w left join best b on b.word = w.word),
way(word, root) as (select word, form from formed where form is not null union all select y.word, f.form from way y join formed f on f.word = y.root where f.form is not null),
ends as (select y.word, y.root from way y join formed f on f.word = y.root where f.form is null)
select f.word, f.form, coalesce(e.root, f.word) as root, f.n, f.n_near::bigint as n_near, f.form_n from formed f left join ends e on e.word = f.word"""
