"""Queries over manifests: filters, validators, joins, sets, sampling and segmentation, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vocalith.functions import sequences as S
from vocalith.operators import manifests as M
from vocalith.operators import ordering as O
from vocalith.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _sup(spark, d):
    return table(spark, d, "supervisions")


def _words(c="text"):
    return F.filter(F.split(c, " "), lambda w: w != "")


_N = "len(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> ''))"


@query(f"""select id, duration from supervisions where duration between 1.0 and 20.0
  and floor((floor((cast(round(duration * 100) as bigint) - 1) / 2.0) - 1) / 2.0) >= {_N}""")
def filter_duration_tokens(spark, d):
    return M.keep_trainable(_sup(spark, d), F.size(_words())).select("id", "duration")


@query(f"""select id, duration from supervisions where duration between 1.0 and 20.0
  and floor((floor((cast(round(duration * 100) as bigint) - 7) / 2.0) + 1) / 2.0) - 2 >= {_N}""")
def filter_duration_tokens_zipformer(spark, d):
    return M.keep_trainable(_sup(spark, d), F.size(_words()), "zipformer").select("id", "duration")


@query("select id from supervisions where text is not null and not regexp_matches(text, '<(SIL|MUSIC|NOISE|OTHER)>')")
def filter_no_oov_tag(spark, d):
    return _sup(spark, d).where(~F.col("text").rlike("<(SIL|MUSIC|NOISE|OTHER)>")).select("id")


@query("select id from supervisions where text is not null and not contains(text, '((') and not contains(lower(text), '<german')")
def filter_no_unclear(spark, d):
    return _sup(spark, d).where(~F.col("text").contains("((") & ~F.lower("text").contains("<german")).select("id")


@query("select id from supervisions where regexp_replace(coalesce(text, ''), '[\\s\\x{00a0}]+', '', 'g') <> ''")
def filter_blank_text(spark, d):
    return _sup(spark, d).where(~M.has_blank(F.col("text"))).select("id")


@query("select id from supervisions where duration > 12.0")
def filter_long(spark, d):
    return _sup(spark, d).where("duration > 12.0").select("id")


@query("""select distinct id from supervisions where subset is not null and id not in (
  select id from supervisions where subset is not null and not starts_with(lower(subset), 'train') and id is not null)""")
def exclude_ids(spark, d):
    s = _sup(spark, d).where("subset is not null").select("id", "subset")
    held = s.where(~F.lower("subset").startswith("train")).select("id")
    return s.select("id").distinct().join(held, "id", "left_anti")


@query("select doc_id, n_chars from documents order by doc_id limit 100")
def subset_first(spark, d):
    return O.head(table(spark, d, "documents").select("doc_id", "n_chars"), 100, "doc_id")


@query("select doc_id, n_chars from documents order by doc_id desc limit 100")
def subset_last(spark, d):
    return O.tail(table(spark, d, "documents").select("doc_id", "n_chars"), 100, "doc_id")


@query("select doc_id from documents where doc_id not in (select doc_id from documents order by doc_id limit 400)")
def complement_after_head(spark, d):
    return O.without_head(table(spark, d, "documents").select("doc_id"), 400, "doc_id", "doc_id")


_VIOL = """
with r as (select id as recording_id, max(duration) as rd from recordings where duration is not null group by id),
j as (select distinct s.id, s.recording_id, start_sec, duration from supervisions s),
v as (select j.*, rd from j left join r using (recording_id)),
x as (
  select id, 'negative start' as reason from v where start_sec < -0.002
  union all select id, 'no duration' from v where duration <= 0
  union all select id, 'ends after recording' from v where start_sec + duration > rd + 0.002
  union all select id, 'unknown recording length' from v where rd is null)
"""


@query(_VIOL + "select id, reason from x")
def validate_time_bounds(spark, d):
    return M.time_violations(table(spark, d, "recordings"), _sup(spark, d))


@query(_VIOL + "select reason, count(*) as n, count(distinct id) as n_ids from x group by reason")
def validate_rollup(spark, d):
    v = M.time_violations(table(spark, d, "recordings"), _sup(spark, d))
    return v.groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


@query(_VIOL + "select reason, id, cast(rn as integer) as rn from (select reason, id, row_number() over (partition by reason order by id) as rn from x) where rn <= 5")
def validate_samples(spark, d):
    v = M.time_violations(table(spark, d, "recordings"), _sup(spark, d))
    return O.top_per_group(v, 5, ["reason"], F.col("id"))


@query("select recording_id, count(distinct id) as n from supervisions group by recording_id having count(distinct id) <> 1")
def validate_one_supervision(spark, d):
    return _sup(spark, d).groupBy("recording_id").agg(F.count_distinct("id").alias("n")).where("n <> 1")


@query("""select 'recordings' as side, count(distinct id) as n from recordings where id in (select recording_id from supervisions)
  union all select 'supervisions', count(distinct id) from supervisions where recording_id in (select id from recordings)""")
def fix_manifests(spark, d):
    r, s = M.fix_pairs(table(spark, d, "recordings"), _sup(spark, d))
    one = lambda x, n: x.agg(F.count_distinct("id").alias("n")).select(F.lit(n).alias("side"), "n")
    return one(r, "recordings").unionByName(one(s, "supervisions"))


@query("""
with s as (select distinct recording_id, start_sec, id, duration, text from supervisions),
a as (select recording_id, count(*) as n, string_agg(id, ',' order by start_sec nulls first, id) as ids from s group by 1),
r as (select id, max(duration) as duration from recordings group by id)
select r.id, r.duration, coalesce(n, 0) as n_sup, coalesce(ids, '') as ids from r left join a on a.recording_id = r.id""")
def join_cuts(spark, d):
    c = M.cuts(table(spark, d, "recordings"), _sup(spark, d))
    return c.select("id", "duration", F.size("supervisions").cast("bigint").alias("n_sup"), F.array_join("supervisions.id", ",").alias("ids"))


@query("""
with base as (select id, min(text) as fixed from supervisions where not regexp_matches(id, '_sp(0\\.9|1\\.1)$') and text is not null group by id),
c as (select distinct id from supervisions)
select c.id, fixed as text from c join base on base.id = regexp_replace(c.id, '_sp(0\\.9|1\\.1)$', '')""")
def join_text_fix(spark, d):
    s = _sup(spark, d)
    fixed = s.where(M.base_id(F.col("id")) == F.col("id")).where("text is not null").groupBy(F.col("id").alias("b")).agg(F.min("text").alias("text"))
    return s.select("id").distinct().withColumn("b", M.base_id(F.col("id"))).join(fixed, "b").select("id", "text")


@query("""
with t as (select utt_id, string_agg(cast(token as varchar), ' ' order by start_frame, end_frame, token) as tokens from (
  select distinct utt_id, token, start_frame, end_frame from token_spans where token is not null and start_frame is not null and end_frame is not null) group by utt_id)
select id, coalesce(tokens, '') as tokens from (select distinct id from supervisions) left join t on t.utt_id = id""")
def join_attach_tokens(spark, d):
    t = table(spark, d, "token_spans").where("token is not null and start_frame is not null and end_frame is not null")
    t = t.select("utt_id", "token", "start_frame", "end_frame").distinct()
    t = S.token_arrays(t.where("utt_id is not null")).select(F.col("utt_id").alias("id"), S.joined(F.col("a")).alias("tokens"))
    return _sup(spark, d).select("id").distinct().join(t, "id", "left").select("id", F.coalesce("tokens", F.lit("")).alias("tokens"))


@query("select utt_id, start_frame, symbol from token_spans join symbols on token = id")
def join_labels(spark, d):
    t, y = table(spark, d, "token_spans"), table(spark, d, "symbols")
    return t.join(y, t["token"] == y["id"]).select("utt_id", "start_frame", "symbol")


@query("""select count(*) as n_rows, count(symbol) as n_known, count(*) - count(symbol) as n_missing
  from (select token from token_spans where token is not null) left join symbols on token = id""")
def join_strict_check(spark, d):
    t, y = table(spark, d, "token_spans").where("token is not null"), table(spark, d, "symbols")
    j = t.join(y, t["token"] == y["id"], "left")
    return j.agg(F.count("*").alias("n_rows"), F.count("symbol").alias("n_known"), (F.count("*") - F.count("symbol")).alias("n_missing"))


@query("select distinct recording_id from segments where recording_id in (select recording_id from supervisions where gender = 'female')")
def join_semi(spark, d):
    f = _sup(spark, d).where("gender = 'female'").select("recording_id")
    return table(spark, d, "segments").select("recording_id").distinct().join(f, "recording_id", "left_semi")


@query("""select id, case when id in (select utt_id from token_spans where utt_id is not null) then 'cached' else 'pending' end as state
  from (select distinct id from supervisions)""")
def split_cached(spark, d):
    have = table(spark, d, "token_spans").select(F.col("utt_id").alias("id")).distinct().withColumn("c", F.lit(1))
    s = _sup(spark, d).select("id").distinct().join(have, "id", "left")
    return s.select("id", F.when(F.col("c").isNull(), "pending").otherwise("cached").alias("state"))


@query("""
with k as (select distinct utt_id, printf('%s-%06d_%06d', recording_id, cast(trunc(start_time * 100) as bigint), cast(trunc(end_time * 100) as bigint)) as key
  from segments where start_time is not null and end_time is not null),
s as (select distinct id, printf('%s-%06d_%06d', recording_id, cast(trunc(start_sec * 100) as bigint), cast(trunc((start_sec + duration) * 100) as bigint)) as key
  from supervisions where start_sec is not null and duration is not null)
select id, utt_id from s join k using (key)""")
def join_derived_key(spark, d):
    key = lambda a, b: F.format_string("%s-%06d_%06d", F.col("recording_id"), (a * 100).cast("bigint"), (b * 100).cast("bigint")).alias("key")
    g = table(spark, d, "segments").where("start_time is not null and end_time is not null").select("utt_id", key(F.col("start_time"), F.col("end_time"))).distinct()
    s = _sup(spark, d).where("start_sec is not null and duration is not null")
    return s.select("id", key(F.col("start_sec"), F.col("start_sec") + F.col("duration"))).distinct().join(g, "key").select("id", "utt_id")


@query("""
with s as (select distinct id, start_sec, start_sec + duration as e from supervisions where start_sec is not null and duration > 0)
select id, cast(k * 5.0 as double) as edge from (
  select id, unnest(generate_series(cast(floor(start_sec / 5.0) as bigint) + 1, cast(ceil(e / 5.0) as bigint) - 1)) as k from s)""")
def range_crossing(spark, d):
    return M.crossing(_sup(spark, d), 5.0)


@query("""
with s as (select distinct id, recording_id, start_sec a, start_sec + duration b from supervisions where start_sec is not null and duration > 0),
g as (select distinct utt_id, recording_id, start_time c, end_time e from segments where end_time > start_time)
select id, count(*) as n from s join g using (recording_id) where c < b and e > a group by id""")
def range_join_overlaps(spark, d):
    s = _sup(spark, d).where("start_sec is not null and duration > 0").select("id", "recording_id", F.col("start_sec").alias("a0"), (F.col("start_sec") + F.col("duration")).alias("a1")).distinct()
    g = table(spark, d, "segments").where("end_time > start_time").select("utt_id", "recording_id", F.col("start_time").alias("b0"), F.col("end_time").alias("b1")).distinct()
    return M.overlapping(s, g, "recording_id").groupBy("id").agg(F.count("*").alias("n"))


@query("""
with e as (select event_id, user_id, ts, event_type from events)
select c.event_id, max(v.ts) as last_view from (select * from e where event_type = 'purchase') c
left join (select * from e where event_type = 'view') v on v.user_id = c.user_id and v.ts <= c.ts group by c.event_id""")
def join_as_of(spark, d):
    e = table(spark, d, "events").where("event_type in ('purchase', 'view')").select("event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("event_type") == "view", F.col("ts"))).over(w)
    return e.withColumn("last_view", last).where("event_type = 'purchase'").select("event_id", "last_view")


@query(f"""
with w as (select id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) as word, generate_subscripts(list_filter(string_split(text, ' '), lambda x: x <> ''), 1) as pos
  from (select id, min(text) as text from supervisions where id is not null and text is not null group by id)),
y as (select replace(symbol, '▁', '') as word, min(id) as sid from symbols group by 1)
select w.id, string_agg(cast(coalesce(sid, 2) as varchar), ' ' order by pos) as ids from w left join y on y.word = lower(w.word) group by w.id""")
def lookup_word_ids(spark, d):
    s = _sup(spark, d).where("id is not null and text is not null").groupBy("id").agg(F.min("text").alias("text"))
    w = s.select("id", F.posexplode(_words())).withColumnRenamed("col", "word")
    y = table(spark, d, "symbols").groupBy(F.replace("symbol", F.lit("▁"), F.lit("")).alias("key")).agg(F.min("id").alias("sid"))
    j = w.join(y, F.lower("word") == F.col("key"), "left")
    j = j.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("sid", F.lit(2)).alias("sid")))).alias("a"))
    return j.select("id", F.array_join(F.transform("a", lambda x: x["sid"].cast("string")), " ").alias("ids"))


@query("""
with s as (select distinct id, start_sec, duration from supervisions),
f as (select * from (values (null, 1.0), ('0.9', 0.9), ('1.1', 1.1)) t(f, x))
select case when f is null then id else id || '_sp' || f end as id, start_sec / cast(x as double) as start_sec, duration / cast(x as double) as duration from s, f""")
def speed_copies(spark, d):
    return M.speed_copies(_sup(spark, d).select("id", "start_sec", "duration").distinct())


@query("select utt_id as id from segments union all select id from supervisions")
def concat_manifests(spark, d):
    return table(spark, d, "segments").select(F.col("utt_id").alias("id")).unionByName(_sup(spark, d).select("id"))


@query("select utt_id from segments intersect select id from supervisions")
def set_intersect(spark, d):
    return table(spark, d, "segments").select("utt_id").intersect(_sup(spark, d).select("id"))


@query("select id from supervisions except all select utt_id from segments")
def set_except_all(spark, d):
    return _sup(spark, d).select("id").exceptAll(table(spark, d, "segments").select("utt_id"))


@query("select doc_id, ntile(7) over (order by doc_id) - 1 as piece from documents")
def split_pieces(spark, d):
    return O.split_into(table(spark, d, "documents").select("doc_id"), 7, "doc_id")


@query("select doc_id, cast(floor((row_number() over (order by doc_id) - 1) / 64.0) as bigint) as piece from documents")
def split_chunks(spark, d):
    return O.split_by_size(table(spark, d, "documents").select("doc_id"), 64, "doc_id")


@query("select doc_id, row_number() over (order by md5(cast(doc_id as varchar) || '#3'), doc_id) as position from documents")
def shuffle_head(spark, d):
    return O.shuffled(table(spark, d, "documents").select("doc_id"), "doc_id", 3)


_U = "(cast(('0x' || substr(md5(cast({k} as varchar) || '#{s}'), 1, 8)) as bigint) / 4294967296.0)"


@query(f"select doc_id from documents where n_chars > 0 order by -ln(greatest({_U.format(k='doc_id', s=5)}, 1e-12)) / n_chars, doc_id limit 80")
def sample_weighted(spark, d):
    return O.weighted_sample(table(spark, d, "documents").select("doc_id", "n_chars"), 80, "doc_id", F.col("n_chars"), 5).select("doc_id")


@query(f"""
with n as (select source, count(*) as n from documents group by source)
select doc_id, source, {_U.format(k='doc_id', s=9)} * n / case source when 'lectures' then 0.5 when 'meetings' then 0.3 else 0.2 end as at
from documents join n using (source) where source in ('lectures', 'meetings', 'podcasts')""")
def mux_sources(spark, d):
    return O.mux(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", {"lectures": 0.5, "meetings": 0.3, "podcasts": 0.2}, 9)


@query("select doc_id, cast(copy as integer) as copy from documents, range(3) t(copy)")
def repeat_rows(spark, d):
    return O.repeat(table(spark, d, "documents").select("doc_id"), 3)


@query(f"""
with w as (select doc_id, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) - 1 as pos from documents where text is not null),
p as (select *, {_U.format(k="(doc_id || ':' || pos)", s=1)} as u from w)
select doc_id, string_agg(case when u <= 0.05 then '' when u <= 0.15 then '#' when u <= 0.2 then word || ' #' else word end, ' ' order by pos) as text
from p group by doc_id""")
def corrupt_words(spark, d):
    w = table(spark, d, "documents").where("text is not null").select("doc_id", F.split("text", " ").alias("w"))

    def one(x, i):
        u = F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":"), i.cast("string"), F.lit("#1"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
        return F.when(u <= 0.05, F.lit("")).when(u <= 0.15, F.lit("#")).when(u <= 0.2, F.concat(x, F.lit(" #"))).otherwise(x)

    return w.select("doc_id", F.array_join(F.transform("w", one), " ").alias("text"))


@query("""
with r as (select id, max(duration) as duration from recordings where duration > 0 group by id)
select id, window_no, cast(window_no * 8.0 as double) as start_sec, least(window_no * 8.0 + 10.0, duration) as end_sec from (
  select id, duration, unnest(generate_series(0, cast(greatest(ceil((duration - 10.0) / 8.0), 0) as bigint))) as window_no from r)""")
def windows_with_hop(spark, d):
    r = table(spark, d, "recordings").where("duration > 0").groupBy("id").agg(F.max("duration").alias("duration"))
    return M.windows_with_hop(r, 10.0, 8.0)


@query("""
with s as (select distinct recording_id, id, start_sec, start_sec + duration as end_sec from supervisions where recording_id is not null and start_sec is not null and duration is not null),
p as (select *, max(end_sec) over (partition by recording_id order by start_sec, end_sec, id rows between unbounded preceding and 1 preceding) as pe from s),
g as (select *, sum(case when pe is null or start_sec - pe > 0.5 then 1 else 0 end) over (partition by recording_id order by start_sec, end_sec, id rows unbounded preceding) as group_no from p)
select recording_id, cast(group_no as bigint) as group_no, min(start_sec) as start_sec, max(end_sec) as end_sec, count(*) as n from g group by 1, 2""")
def trim_to_groups(spark, d):
    return M.pause_groups(_sup(spark, d), 0.5)


@query("""with recursive d as (select recording_id, id, duration, row_number() over (partition by recording_id order by id) as rn from (
  select recording_id, id, max(duration) as duration from supervisions where recording_id is not null and duration is not null group by 1, 2)),
r as (select recording_id, id, rn, duration as now, 0 as shard from d where rn = 1
  union all select d.recording_id, d.id, d.rn, case when now <> 0 and now + d.duration > 60.0 then d.duration else now + d.duration end, case when now <> 0 and now + d.duration > 60.0 then shard + 1 else shard end
  from r join d on d.recording_id = r.recording_id and d.rn = r.rn + 1)
select recording_id, id, cast(shard as bigint) as shard from r""")
def shard_by_duration(spark, d):
    return M.shard_by_duration(_sup(spark, d), "recording_id", 60.0)


@query("""with recursive x as (select recording_id, id, min({'start_sec': start_sec, 'duration': duration}) as x from supervisions where recording_id is not null and start_sec is not null and duration is not null group by 1, 2),
d as (select recording_id, id, x.start_sec as s, x.start_sec + x.duration as e, row_number() over (partition by recording_id order by x.start_sec, id) as rn from x),
r as (select recording_id, rn, id as first_id, s, e, 0 as g from d where rn = 1
  union all select d.recording_id, d.rn, case when ok then first_id else d.id end, case when ok then r.s else d.s end, case when ok then greatest(r.e, d.e) else d.e end, case when ok then g else g + 1 end
  from (select r.*, d2.s - r.e <= 1.0 and greatest(d2.e, r.e) - r.s <= 10.0 as ok from r join d d2 on d2.recording_id = r.recording_id and d2.rn = r.rn + 1) r join d on d.recording_id = r.recording_id and d.rn = r.rn + 1)
select recording_id, min(first_id) as first_id, min(s) as start_sec, max(e) as end_sec, count(*) as n from r group by recording_id, g""")
def merge_neighbours(spark, d):
    return M.merge_neighbours(_sup(spark, d))


@query()
def boundary_windows(spark, d):
    return M.boundary_windows(_sup(spark, d))


@query("""with recursive d as (select id, duration, cast(floor(log2(greatest(duration, 0.1)) * 2) as bigint) as bucket from (select id, max(duration) as duration from supervisions where duration > 0 and id is not null group by id)),
o as (select *, row_number() over (partition by bucket order by duration, id) as rn from d),
r as (select bucket, id, rn, 1 as size, 0 as batch from o where rn = 1
  union all select o.bucket, o.id, o.rn, case when (size + 1) * o.duration > 200.0 then 1 else size + 1 end, case when (size + 1) * o.duration > 200.0 then batch + 1 else batch end from r join o on o.bucket = r.bucket and o.rn = r.rn + 1)
select bucket, id, 0::bigint as grp, cast(batch as bigint) as batch from r""")
def batch_by_length(spark, d):
    return M.batches_by_length(_sup(spark, d), F.floor(F.log2(F.greatest("duration", F.lit(0.1))) * 2), 200.0)


@query("""
with r as (select id as recording_id, max(duration) as duration from recordings where duration > 0 group by id),
w as (select recording_id, duration, unnest(generate_series(0, cast(greatest(ceil((duration - 10.0) / 8.0), 0) as bigint))) as k from r),
s as (select distinct recording_id, id, cast(round(start_sec * 1000) as bigint) as item from supervisions where start_sec is not null),
j as (select w.recording_id, item, k * 8000 as a, least(k * 8000 + 10000, cast(round(duration * 1000) as bigint)) as b, k = 0 as f, k * 8.0 + 10.0 >= duration as l
  from w join s using (recording_id)),
x as (select * from j where item >= a + case when f then 0 else 1000 end and (l or item < b - 1000) and item <= b)
select recording_id, count(*) as n_items, min(item) as first_ms, max(item) as last_ms from x group by recording_id""")
def merge_chunks(spark, d):
    r = table(spark, d, "recordings").where("duration > 0").groupBy("id").agg(F.max("duration").alias("duration"))
    w = M.windows_with_hop(r, 10.0, 8.0).join(r, "id").select(
        F.col("id").alias("recording_id"), F.col("window_no").alias("chunk_no"), (F.col("window_no") * 8000).alias("start_ms"), F.round(F.col("end_sec") * 1000).cast("bigint").alias("end_ms"),
        (F.col("window_no") == 0).alias("is_first"), (F.col("window_no") * 8.0 + 10.0 >= F.col("duration")).alias("is_last"))
    s = _sup(spark, d).where("start_sec is not null").select("recording_id", "id", F.round(F.col("start_sec") * 1000).cast("bigint").alias("item_ms")).distinct()
    j = w.join(s, "recording_id").where("item_ms <= end_ms")
    return M.merge_chunks(j, 1000)
