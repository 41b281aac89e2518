"""The figures of op11 in SQL: every document is taken through every order of the filters, one step after another."""

SQL = """
with d as (
  select coalesce(source, '') as part, coalesce(text, '') as text, doc_id from documents),
w as (
  select part, text, doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words from d),
l as (
  select doc_id, max(quality) as quality, max(toxic) as toxic from labels where doc_id is not null group by doc_id),
f as (
  select part, coalesce(l.quality = 1, false) as good, coalesce(l.toxic = 1, false) as bad,
         map {
           'A': len(words) < 200,
           'B': 100 * len(list_distinct(words)) < 50 * len(words),
           'C': 100 * len(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * len(text),
           'D': regexp_matches(text, '[#$%&*|]'),
           'E': coalesce(min(w.doc_id) over (partition by text) < w.doc_id, false)} as fails
  from w left join l on w.doc_id = l.doc_id),
n as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as name),
o as (
  select a.name || b.name || c.name || d.name || e.name as filter_order
  from n a, n b, n c, n d, n e
  where b.name <> a.name and c.name not in (a.name, b.name) and d.name not in (a.name, b.name, c.name) and e.name not in (a.name, b.name, c.name, d.name)),
s as (
  select filter_order, unnest(range(1, 6))::integer as step from o),
g as (
  select part, good, bad, fails['A'] as fa, fails['B'] as fb, fails['C'] as fc, fails['D'] as fd, fails['E'] as fe, count(*) as n from f group by all),
p as (
  select part, s.filter_order, s.step, g.n, good, bad,
         case substr(s.filter_order, s.step, 1) when 'A' then fa when 'B' then fb when 'C' then fc when 'D' then fd else fe end as hit,
         (fa and position('A' in s.filter_order) < s.step) or (fb and position('B' in s.filter_order) < s.step) or (fc and position('C' in s.filter_order) < s.step)
           or (fd and position('D' in s.filter_order) < s.step) or (fe and position('E' in s.filter_order) < s.step) as gone,
         fa::int + fb::int + fc::int + fd::int + fe::int as failing
  from g, s),
r as (
  select part, filter_order, step, substr(filter_order, step, 1) as filter,
         sum(case when not gone and not hit then n else 0 end)::bigint as kept,
         sum(case when not gone and hit then n else 0 end)::bigint as removed,
         sum(case when gone and hit then n else 0 end)::bigint as redundant,
         sum(case when hit and failing = 1 then n else 0 end)::bigint as unique_fails,
         sum(case when not gone and hit and good then n else 0 end)::bigint as good_lost,
         sum(case when not gone and hit and bad then n else 0 end)::bigint as toxic_lost
  from p group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, filter))::bigint as shapley
from r
"""
