"""SQL for the operators that it can express, by plain self joins; fit for small tables only."""

#: Cosine of all pairs of a label, and what is reachable by links.
EMBEDDINGS = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
n as (select a, count(*) as n from l group by a), m as (select a, least(a, min(b)) as c from r group by a)
select vec_id, coalesce(n.n, 0) as n_links, coalesce(m.c, vec_id) as component_id, vec_id = coalesce(m.c, vec_id) as kept from embeddings left join n on n.a = vec_id left join m on m.a = vec_id
"""

#: Windows that a smaller id starts, and the words left.
SUBSTRINGS = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as k from (select doc_id, w, unnest(generate_series(1, len(w) - 12)) as i from w where len(w) >= 13)),
f as (select k, min(doc_id) as m from g group by k having min(doc_id) < max(doc_id)),
h as (select distinct doc_id, unnest(generate_series(i, i + 12)) as i from g join f using (k) where doc_id > m),
u as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from w),
s as (select u.doc_id, count(*) as n_words, count(h.i) as n_removed, sha256(coalesce(string_agg(word, ' ' order by u.i) filter (h.i is null), '')) as kept_sha256 from u left join h on h.doc_id = u.doc_id and h.i = u.i group by u.doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, coalesce(kept_sha256, sha256('')) as kept_sha256 from documents d left join s using (doc_id)
"""

#: Overlaps of all pairs that share a shingle, and what is reachable by links.
JACCARD = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, hash(array_to_string(w[i:i + 3], ' ')) as k from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) as i from w where len(w) > 0)),
z as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by all),
l as (select a, b from p join z x on x.doc_id = a join z y on y.doc_id = b where 100 * o >= 85 * (x.n + y.n - o)),
e as (select a, b from l union all select b, a from l), r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
m as (select a, least(a, min(b)) as c from r group by a)
select d.doc_id, coalesce(z.n, 0) as n_shingles, coalesce(m.c, d.doc_id) as component_id from documents d left join z using (doc_id) left join m on m.a = d.doc_id
"""

#: Counts of all phrases, the weakest cut of each, and what longer phrases cover.
COLLOCATIONS = r"""
with recursive p as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from documents),
t as (select lang, sum(len(w)) as n from p group by lang),
g as (select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase from (select lang, w, m, unnest(generate_series(1, len(w) - m + 1)) as i from p, (values (1), (2), (3), (4)) s(m) where len(w) >= m)),
f as (select lang, m, phrase, count(*) as f, string_split(phrase, ' ') as w from g group by lang, m, phrase having count(*) >= 30),
c as (select lang, phrase, m, f as a, k, array_to_string(w[1:k], ' ') as head, array_to_string(w[k + 1:], ' ') as tail from (select *, unnest(generate_series(1, m - 1)) as k from f where m > 1)),
s as (select c.lang, c.phrase, c.a, k, x.f as l, y.f as r, (2000000::hugeint * c.a) // (x.f + y.f) as score from c join f x on x.lang = c.lang and x.phrase = head join f y on y.lang = c.lang and y.phrase = tail),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
o as (select lang, array_to_string(w[i:i + n - 1], ' ') as phrase, max(f) as f from (select *, unnest(generate_series(1, m - n + 1)) as i from (select *, unnest(generate_series(2, m - 1)) as n from f where m > 2)) group by all),
q as (select b.*, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b left join o using (lang, phrase) where o.f is null or 100::hugeint * o.f < 80::hugeint * a)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from q join t using (lang) where rank <= 2000
"""

#: Lines whose key ten documents have.
LINES = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(c.key) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (c.key is null), '')) as kept_sha256 from k left join c using (key) group by doc_id
"""


def _clusters(k: int, rounds: int, dim: int) -> str:
    """Exhaustive assignment in whole numbers, one step for each round."""
    steps = [
        f"""v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)""",
        f"c0 as (select cast(row_number() over (order by h) - 1 as integer) as c, e from (select sha256('2:' || vec_id) as h, e from v where vec_id is not null order by h limit {k}))",
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} as (select v.vec_id, v.e, c, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from v, c{n} c)")
        steps.append(f"a{n} as (select * from d{n} qualify row_number() over (partition by vec_id order by d, c) = 1)")
        if n < rounds:
            steps.append(f"u{n} as (select c, i, sum(x) as s, count(*) as n from (select c, unnest(e) as x, generate_subscripts(e, 1) as i from a{n}) group by c, i)")
            steps.append(f"m{n} as (select c, list((s - ((s % n) + n) % n) // n order by i) as e from u{n} group by c)")
            steps.append(f"c{n + 1} as (select c, cast(coalesce(m.e, o.e) as bigint[]) as e from c{n} o left join m{n} m using (c))")
    last = f"""select vec_id, a.c as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
  sha256(array_to_string(list_transform(z.e, lambda x: cast(x as varchar)), ',')) as centroid_sha256 from a{rounds} a join c{rounds} z using (c)"""
    return "with " + ",\n".join(steps) + "\n" + last


CLUSTERS = _clusters(40, 5, 64)
