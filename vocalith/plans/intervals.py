"""Queries over the interval operator, with their SQL."""

from __future__ import annotations

from vocalith.operators.intervals import merge_intervals
from vocalith.session import table


def p4_found(spark, sf_dir):
    return merge_intervals(table(spark, sf_dir, "segments"), "recording_id", "start_time", "end_time")


QUERIES = {"p4_found": p4_found}

SQL = {
    "p4_found": """
with iv as (
  select distinct recording_id k, cast(round(start_time * 1000) as bigint) s, cast(round(end_time * 1000) as bigint) e
  from segments where recording_id is not null and start_time is not null and end_time is not null),
g as (select *, max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) pe from iv where e > s),
h as (select *, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by k order by s, e rows unbounded preceding) n from g),
p as (select k, n, min(s) s, max(e) e from h group by k, n)
select k as recording_id, 'period' as kind, s as start_ms, e as end_ms from p
union all
select k, 'gap', e, ns from (select *, lead(s) over (partition by k order by n) ns from p) where ns is not null
""",
}
