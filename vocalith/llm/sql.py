"""SQL of the queries that SQL can express."""

_SUP = "select id, min(text) as text, min(subset) as subset, min(corpus) as corpus from supervisions where id is not null group by id"

_TERMS = f"""
with once as ({_SUP}),
t as (select id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}'']+')) as term from once where text is not null),
c as (select term, count(*) as occurrences, count(distinct id) as records from t group by term),
n as (select count(*) as total from once where text is not null)
select term, occurrences, records,
  case when records <= 2 then 'rare' when records > 0.05 * total then 'common' end as mark from c, n
"""

_NGRAMS = f"""
with once as ({_SUP}),
l as (select id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}'']+') as w from once where text is not null),
g as (select id, cast(n as integer) as n, array_to_string(w[i:i + n - 1], ' ') as term from (select id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from l, range(1, 4) t(n) where len(w) >= n)),
c as (select n, term, count(*) as occurrences, count(distinct id) as records from g group by n, term),
a as (select count(*) as total from once where text is not null)
select n, term, occurrences, records, case when records <= 2 then 'rare' when records > 0.05 * total then 'common' end as mark from c, a
"""

_GROUPS = """
with recursive s as (
  select distinct utt_id, regexp_replace(lower(spk_id), '[^\\p{L}\\p{Nd}]+', '', 'g') as f from utt2spk where utt_id is not null),
us as (
  select distinct utt_id, regexp_extract(f, '^(\\p{L}+)0*([0-9]+)$', 1) || '-' || regexp_extract(f, '^(\\p{L}+)0*([0-9]+)$', 2) as spk
  from s where regexp_matches(f, '^\\p{L}+[0-9]+$')),
link as (select distinct x.spk as a, y.spk as b from us x join us y using (utt_id)),
reach as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a),
root as (select r.a as spk, min(u.utt_id) as group_utt from reach r join us u on u.spk = r.b group by r.a)
select utt_id, min(group_utt) as group_utt from us join root using (spk) group by utt_id
"""

_RUNS = """
with e as (
  select distinct utt_id as u, token as t, start_frame as s, end_frame as e from token_spans
  where utt_id is not null and token is not null and token <> 0 and start_frame is not null and end_frame > start_frame),
k as (
  select e.*, coalesce(lower(replace(symbol, '▁', '')), '#' || t) as kind
  from e left join (select id, min(symbol) as symbol from symbols group by id) y on y.id = e.t),
p as (
  select *, case when lag(kind) over w = kind and s - lag(e) over w <= 25 then 0 else 1 end as fresh
  from k window w as (partition by u order by s, e, t)),
r as (select *, sum(fresh) over (partition by u order by s, e, t rows unbounded preceding) as no from p),
g as (
  select u as utt_id, min(kind) as kind, min(s) as start_frame, max(e) as end_frame, cast(count(*) as integer) as n_spans
  from r group by u, no)
"""

SQL: dict[str, str] = {
    "p2_found": f"select term, mark from ({_TERMS}) where mark is not null",
    "p2_terms": _TERMS,
    "p2_ngrams": _NGRAMS,
    "p3_found": _GROUPS,
    "p7_found": _RUNS + "select utt_id, start_frame, end_frame, n_spans from g where n_spans >= 2",
    "p7_events": _RUNS + "select * from g",
}
