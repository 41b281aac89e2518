"""The ranking of op12 in SQL: every document is scored for every item."""

SQL = """
with t as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms
  from documents where text is not null),
d as (
  select r, doc_id, len(terms)::bigint as n, terms from t where len(terms) > 0),
g as (
  select count(*)::bigint as N, sum(n)::bigint as L from d),
p as (
  select r, term, count(*)::bigint as tf from (select r, unnest(terms) as term from d) group by r, term),
q as (
  select row_number() over () as i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms
  from benchmark where text is not null),
u as (
  select distinct i, unnest(terms) as term from q),
f as (
  select term, count(*)::bigint as df from p group by term),
w as (
  select u.i, u.term, floor(1000 * ln((2 * g.N + 2)::double / (2 * f.df + 1)::double))::bigint as w from u join f using (term), g),
s as (
  select w.i, p.r, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 90 + (90 * d.n * g.N) // g.L))))::bigint as score
  from w join p using (term) join d on d.r = p.r, g group by w.i, p.r),
k as (
  select q.item_id, d.doc_id, s.score, row_number() over (partition by s.i order by s.score desc, d.doc_id asc nulls last) as rank
  from s join d on d.r = s.r join q on q.i = s.i where s.score > 0)
select item_id, rank::integer as rank, doc_id, score from k where rank <= 10
"""
