"""Aggregations and ordered (window-like) queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vocalith.operators import lexicon as L
from vocalith.operators import ordering as O
from vocalith.plans.registry import Registry
from vocalith.session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_ONCE = "(select id, max(duration) as duration, min(corpus) as corpus, min(lang) as lang, min(subset) as subset, min(text) as text from supervisions where id is not null group by id)"


def _once(spark, d):
    return table(spark, d, "supervisions").where("id is not null").groupBy("id").agg(
        F.max("duration").alias("duration"), *[F.min(c).alias(c) for c in ("corpus", "lang", "subset", "text")])


@query(f"""select count(*) as n, sum(duration) / 3600 as hours, avg(duration) as mean, stddev_samp(duration) as std, min(duration) as shortest, max(duration) as longest,
  quantile_cont(duration, 0.25) as p25, quantile_cont(duration, 0.5) as p50, quantile_cont(duration, 0.99) as p99 from {_ONCE} where duration is not null""")
def describe_durations(spark, d):
    x = F.col("duration")
    pc = lambda p: F.percentile(x, p).alias(f"p{round(p * 100)}")
    return _once(spark, d).where("duration is not null").agg(
        F.count("*").alias("n"), (F.sum(x) / 3600).alias("hours"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("shortest"), F.max(x).alias("longest"), pc(0.25), pc(0.5), pc(0.99))


@query(f"select corpus, lang, sum(duration) / 3600 as hours, count(*) as n, cast(grouping(corpus) as integer) as all_corpora, cast(grouping(lang) as integer) as all_langs from {_ONCE} group by rollup (corpus, lang)")
def hours_rollup(spark, d):
    return _once(spark, d).rollup("corpus", "lang").agg(
        (F.sum("duration") / 3600).alias("hours"), F.count("*").alias("n"), F.grouping("corpus").cast("int").alias("all_corpora"), F.grouping("lang").cast("int").alias("all_langs"))


@query(f"select corpus, subset, count(*) as n, cast(grouping(corpus) as integer) as a, cast(grouping(subset) as integer) as b from {_ONCE} group by cube (corpus, subset)")
def counts_cube(spark, d):
    return _once(spark, d).cube("corpus", "subset").agg(F.count("*").alias("n"), F.grouping("corpus").cast("int").alias("a"), F.grouping("subset").cast("int").alias("b"))


@query(f"select corpus, lang, count(*) as n, cast(grouping(corpus) as integer) as a from {_ONCE} group by grouping sets ((corpus), (lang))")
def counts_grouping_sets(spark, d):
    _once(spark, d).createOrReplaceTempView("vocalith_once")
    return spark.sql("select corpus, lang, count(*) as n, cast(grouping(corpus) as int) as a from vocalith_once group by grouping sets ((corpus), (lang))")


@query(f"""with l as (select cast(floor((len(string_split(text, ' ')) - 1) / 10) as bigint) as bin from {_ONCE} where text <> '')
select bin, count(*) as n, 100.0 * count(*) / (select count(*) from l) as percent from l group by bin""")
def sentence_length_histogram(spark, d):
    b = _once(spark, d).where("text <> ''").select(F.floor((F.size(F.split("text", " ")) - 1) / 10).alias("bin"))
    h = b.groupBy("bin").agg(F.count("*").alias("n"))
    return h.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row per bin


@query("""with c as (select event_type, count(*) as n from events group by 1)
select user_id, sum(1000 / (n + 0.01)) as weight from (select distinct user_id, event_type from events) join c using (event_type) group by user_id""")
def label_weights(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type")
    c = e.groupBy("event_type").agg(F.count("*").alias("n"))
    return e.distinct().join(c, "event_type").groupBy("user_id").agg(F.sum(1000 / (F.col("n") + 0.01)).alias("weight"))


_WF = f"(select word, count(*) as n from (select unnest(string_split(lower(text), ' ')) as word from {_ONCE} where text is not null) where word <> '' group by word)"


def _word_counts(spark, d):
    w = _once(spark, d).where("text is not null").select(F.explode(F.split(F.lower("text"), " ")).alias("word")).where("word <> ''")
    return w.groupBy("word").agg(F.count("*").alias("n"))


@query(f"select word, n from {_WF} order by n desc, word limit 200")
def word_frequency_top(spark, d):
    return _word_counts(spark, d).orderBy(F.desc("n"), "word").limit(200)


@query(f"select word, n from {_WF} where word not in (select word from {_WF} order by n desc, word limit 1000)")
def word_frequency_rare(spark, d):
    c = _word_counts(spark, d)
    return c.join(c.orderBy(F.desc("n"), "word").limit(1000).select("word"), "word", "left_anti")


@query("select count(*) as n, count_if(n_tok > 0) as with_tokens, avg(case when n_tok > 0 then n_tok end) as mean_tokens from (select s.id, count(t.token) as n_tok from (select distinct id from supervisions) s left join token_spans t on t.utt_id = s.id group by s.id)")
def context_coverage(spark, d):
    s = table(spark, d, "supervisions").select("id").distinct()
    t = table(spark, d, "token_spans").groupBy(F.col("utt_id").alias("id")).agg(F.count("token").alias("n_tok"))
    j = s.join(t, "id", "left").select(F.coalesce("n_tok", F.lit(0)).alias("n_tok"))
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("n_tok") > 0).alias("with_tokens"), F.avg(F.when(F.col("n_tok") > 0, F.col("n_tok"))).alias("mean_tokens"))


@query("""select dim, count(*) as n, round(avg(x), 6) as mean, round(var_pop(x), 6) as var from (
  select unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings) group by dim""")
def feature_mean_var(spark, d):
    x = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("dim", "x"))
    x = x.select(F.col("dim").cast("bigint").alias("dim"), F.col("x").cast("double").alias("x"))
    return x.groupBy("dim").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.var_pop("x"), 6).alias("var"))


@query("""select event_type as metric, sum(value) as total, count(*) as frames, sum(value) / count(*) as per_frame, sum(value) / count(distinct user_id) as per_utt
  from events where value is not null and not isnan(value) and not isinf(value) group by 1""")
def metrics_merge(spark, d):
    ok = table(spark, d, "events").where("value - value = 0")  # neither NaN nor infinite
    return ok.groupBy(F.col("event_type").alias("metric")).agg(
        F.sum("value").alias("total"), F.count("*").alias("frames"), (F.sum("value") / F.count("*")).alias("per_frame"), (F.sum("value") / F.count_distinct("user_id")).alias("per_utt"))


@query("""with o as (select user_id, value, count(*) over (partition by user_id) - row_number() over (partition by user_id order by ts, event_id) as later from events where value is not null and not isnan(value))
select user_id, round(sum(value * power(1 - 1.0 / 50, later)), 6) as total from o group by user_id""")
def decayed_total(spark, d):
    w = Window.partitionBy("user_id")
    e = table(spark, d, "events").where("value is not null and not isnan(value)")
    later = F.count("*").over(w) - F.row_number().over(w.orderBy("ts", "event_id"))
    return e.withColumn("later", later).groupBy("user_id").agg(F.round(F.sum(F.col("value") * F.pow(F.lit(1 - 1.0 / 50), F.col("later"))), 6).alias("total"))


@query("""select label, round(avg(abs(x)), 6) as mean_abs, round(sqrt(avg(x * x)), 6) as rms, min(x) as lo, max(x) as hi, avg(case when x > 0 then 1.0 else 0 end) as positive from (
  select label, unnest(embedding)::double as x from embeddings) group by label""")
def tensor_stats(spark, d):
    x = table(spark, d, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    return x.groupBy("label").agg(F.round(F.avg(F.abs("x")), 6).alias("mean_abs"), F.round(F.sqrt(F.avg(F.col("x") * F.col("x"))), 6).alias("rms"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg(F.when(F.col("x") > 0, 1.0).otherwise(0)).alias("positive"))


@query("""select label, unnest([0, 10, 50, 90, 100]) as percent, round(unnest(quantile_cont(r, [0.0, 0.1, 0.5, 0.9, 1.0])), 6) as rms from (
  select label, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)) / len(embedding)) as r from embeddings) group by label""")
def tensor_rms_percentiles(spark, d):
    sq = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    r = table(spark, d, "embeddings").select("label", F.sqrt(sq / F.size("embedding")).alias("r"))
    ps = [0, 10, 50, 90, 100]
    p = r.groupBy("label").agg(*[F.percentile("r", q / 100).alias(f"p{q}") for q in ps])
    return p.select("label", F.inline(F.array(*[F.struct(F.lit(q).alias("percent"), F.round(f"p{q}", 6).alias("rms")) for q in ps])))


@query("""with r as (select label, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)) / len(embedding)) as r from embeddings),
o as (select label, r, row_number() over (partition by label order by r) - 1 as i, count(*) over (partition by label) as n from r)
select label, k, round(r, 6) as rms from o, range(11) t(k) where i = least(k * n // 10, n - 1)""")
def tensor_rms_sorted(spark, d):
    """The 11 values at tenths of the sorted root mean squares of each label, by their number instead of a window."""
    sq = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    r = O.number_rows(table(spark, d, "embeddings").select("label", F.sqrt(sq / F.size("embedding")).alias("r")), "label", "r")
    per = r.groupBy("label").agg(F.min("rn").alias("first"), F.count("*").alias("n"))  # a row for each label
    at = per.select("label", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("k"), "first", "n")
    at = at.select("label", F.col("k").cast("bigint").alias("k"), (F.col("first") + F.least(F.floor(F.col("k") * F.col("n") / 10), F.col("n") - 1)).alias("rn"))
    return r.join(at, ["label", "rn"]).select("label", "k", F.round("r", 6).alias("rms"))


@query("""with x as (select dim_i as i, dim_j as j, sum(a * b) as v from (select e.embedding[i + 1]::double as a, e.embedding[j + 1]::double as b, i as dim_i, j as dim_j from embeddings e, range(4) t(i), range(4) u(j)) group by 1, 2)
select i, j, round(v, 5) as v from x""")
def tensor_product(spark, d):
    """The product of the transposed table of vectors with itself, of the first dimensions: its eigenvalues describe the spread."""
    v = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    x = table(spark, d, "embeddings").select(v.alias("v")).select("v", F.posexplode("v").alias("i", "a")).select("i", "a", F.posexplode("v").alias("j", "b"))
    return x.groupBy(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j")).agg(F.round(F.sum(F.col("a") * F.col("b")), 5).alias("v"))


@query("select c_mktsegment as key, round(sum(c_acctbal * c_nationkey) / sum(c_nationkey), 6) as mean from customer group by 1")
def per_key_weighted_average(spark, d):
    """The weighted variant of averages by key."""
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("key")).agg(F.round(F.sum(F.col("c_acctbal") * F.col("c_nationkey")) / F.sum("c_nationkey"), 6).alias("mean"))


@query("select key, avg(v) as mean, cast(floor(avg(v)) as bigint) as floored from (select c_mktsegment as key, c_acctbal as v from customer) group by key")
def per_key_average(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("key")).agg(F.avg("c_acctbal").alias("mean"), F.floor(F.avg("c_acctbal")).alias("floored"))


@query("select distinct lower(replace(symbol, '▁', '')) as word from symbols order by word")
def vocabulary(spark, d):
    return table(spark, d, "symbols").select(F.lower(F.replace("symbol", F.lit("▁"), F.lit(""))).alias("word")).distinct().orderBy("word")


@query("select id, min(duration) as shortest, count(*) as n from recordings group by id having count(*) > 1")
def duplicate_ids(spark, d):
    return table(spark, d, "recordings").groupBy("id").agg(F.min("duration").alias("shortest"), F.count("*").alias("n")).where("n > 1")


@query("select id, source, sampling_rate from (select *, row_number() over (partition by id order by recorded_at nulls first, source nulls first, sampling_rate nulls first) as rn from recordings where id is not null) where rn = 1")
def first_recording_per_id(spark, d):
    r = table(spark, d, "recordings").where("id is not null")
    return O.first_per_key(r.select("id", "recorded_at", "source", "sampling_rate"), "id", "recorded_at", "source", "sampling_rate").select("id", "source", "sampling_rate")


@query(f"""with t as (select distinct string_split(text, ' ') as ws from {_ONCE} where text is not null)
select distinct array_to_string(list_filter(ws, lambda w: regexp_full_match(w, '[a-z'']+')), ' ') as line from t where len(list_filter(ws, lambda w: regexp_full_match(w, '[a-z'']+'))) > 0""")
def distinct_clean_lines(spark, d):
    ws = F.filter(F.split("text", " "), lambda w: w.rlike("^[a-z']+$"))
    return _once(spark, d).where("text is not null").select(ws.alias("ws")).where(F.size("ws") > 0).select(F.array_join("ws", " ").alias("line")).distinct()


# Lexicon: symbols as words with their characters as tokens, in the order of the ids.
_LEX = "(select id as pos, lower(replace(symbol, '▁', '')) as word, string_split(symbol, '') as tokens from symbols where symbol <> '')"


@query(f"select word, array_to_string(tokens, ' ') as tokens, cast(pos as bigint) as pos from (select *, row_number() over (partition by word order by pos) as rn from {_LEX}) where rn = 1")
def lexicon_first_pronunciation(spark, d):
    x = L.first_pronunciation(L.symbol_lexicon(table(spark, d, "symbols")))
    return x.select("word", F.array_join("tokens", " ").alias("tokens"), "pos")


@query(f"select c, row_number() over (order by first) + 2 as id from (select c, min(pos * 1000 + i) as first from (select pos, unnest(tokens) as c, generate_subscripts(tokens, 1) as i from {_LEX}) group by c)")
def dense_id_by_first_appearance(spark, d):
    return L.ids_by_first_appearance(L.symbol_lexicon(table(spark, d, "symbols")), reserved=3)


@query(f"""with w as (select distinct word from {_LEX}), n as (select count(*) as n from w),
f as (select '<eps>' as word, 0 as id union all select '!SIL', 1 union all select '<SPOKEN_NOISE>', 2 union all select '<UNK>', 3),
m as (select word, row_number() over (order by word) + 3 as id from w)
select word, cast(id as bigint) as id from f union all select word, id from m union all select x, n + 4 + k from n, (values ('#0', 0), ('<s>', 1), ('</s>', 2)) t(x, k)""")
def words_table(spark, d):
    return L.words_table(L.symbol_lexicon(table(spark, d, "symbols")).select("word").distinct())


@query(f"""with x as (select pos, word, array_to_string(tokens, ' ') as s, tokens from {_LEX}),
p as (select distinct array_to_string(tokens[1:k], ' ') as s from (select tokens, unnest(generate_series(1, len(tokens) - 1)) as k from x)),
c as (select *, count(*) over (partition by s) as same, row_number() over (partition by s order by pos) as k, s in (select s from p) as pre from x)
select cast(pos as bigint) as pos, word, case when same > 1 or pre then s || ' #' || k else s end as tokens from c""")
def lexicon_disambiguate(spark, d):
    return L.disambiguate(L.symbol_lexicon(table(spark, d, "symbols")))


@query("""with l as (select distinct utt_id, start_frame, token from token_spans where utt_id is not null and start_frame is not null and token is not null),
o as (select *, row_number() over w - 1 as f, lag(token) over w as before from l window w as (partition by utt_id order by start_frame, token)),
g as (select *, sum(case when before = token then 0 else 1 end) over (partition by utt_id order by f rows unbounded preceding) as run from o)
select utt_id, token, cast(min(f) as bigint) as start, cast(max(f) + 1 as bigint) as stop from g where token <> 0 group by utt_id, run, token""")
def token_runs(spark, d):
    return L.token_runs(_frames(spark, d))


def _frames(spark, d):
    t = table(spark, d, "token_spans").where("utt_id is not null and start_frame is not null and token is not null")
    return t.select("utt_id", "start_frame", "token").distinct()


@query("""with l as (select distinct utt_id, start_frame, token from token_spans where utt_id is not null and start_frame is not null and token is not null),
o as (select *, lag(token) over (partition by utt_id order by start_frame, token) as before from l)
select utt_id, string_agg(cast(token as varchar), ' ' order by start_frame, token) as tokens from o where token <> 0 and before is distinct from token group by utt_id""")
def collapse_repeats_drop_blank(spark, d):
    return L.collapse(_frames(spark, d))


@query(f"select corpus, lang, n, rank() over (partition by corpus order by n desc, lang desc) as place from (select corpus, lang, count(*) as n from {_ONCE} where corpus is not null and lang is not null group by all)")
def rank_by_frequency(spark, d):
    c = _once(spark, d).where("corpus is not null and lang is not null").groupBy("corpus", "lang").agg(F.count("*").alias("n"))
    return c.withColumn("place", F.rank().over(Window.partitionBy("corpus").orderBy(F.desc("n"), F.desc("lang"))).cast("bigint"))


@query(f"select id, duration, row_number() over (order by length(text) desc, id) as position from {_ONCE} where text is not null")
def sort_by_length(spark, d):
    s = _once(spark, d).where("text is not null").select("id", "duration", (-F.length("text")).alias("_n"))
    return O.number_rows(s, "_n", "id", name="position").select("id", "duration", "position")


@query("""with x as (select distinct on (recording_id, id) recording_id, id, start_sec, duration, cast(floor(cast(round(start_sec * 100) as bigint) / 4.0) as bigint) as start, cast(floor(cast(round(duration * 100) as bigint) / 4.0) as bigint) as frames
  from supervisions where start_sec is not null and duration is not null order by recording_id, id, start_sec, duration)
select recording_id, id, start, frames, row_number() over (partition by recording_id order by frames desc, start, id) - 1 as seq from x""")
def reorder_by_frames(spark, d):
    s = table(spark, d, "supervisions").where("start_sec is not null and duration is not null")
    s = s.groupBy("recording_id", "id").agg(F.min(F.struct("start_sec", "duration")).alias("x")).select("recording_id", "id", "x.*")
    f = lambda c: F.floor(F.round(F.col(c) * 100).cast("bigint") / 4)
    s = s.select("recording_id", "id", f("start_sec").alias("start"), f("duration").alias("frames"))
    w = Window.partitionBy("recording_id").orderBy(F.desc("frames"), "start", "id")
    return s.withColumn("seq", (F.row_number().over(w) - 1).cast("bigint"))


@query("""select recording_id, id from (select recording_id, id, row_number() over (partition by recording_id order by duration desc, id) as rn, max(duration) over (partition by recording_id) as longest
  from (select recording_id, id, max(duration) as duration from supervisions where duration > 0 group by 1, 2)) where rn <= floor(60.0 / longest)""")
def keep_uneven_batch(spark, d):
    s = table(spark, d, "supervisions").where("duration > 0").groupBy("recording_id", "id").agg(F.max("duration").alias("duration"))
    w = Window.partitionBy("recording_id")
    s = s.withColumns({"rn": F.row_number().over(w.orderBy(F.desc("duration"), "id")), "longest": F.max("duration").over(w)})
    return s.where(F.col("rn") <= F.floor(60.0 / F.col("longest"))).select("recording_id", "id")


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as n, sum(value) as total from events group by 1, 2")
def tumbling_window(spark, d):
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


@query("select doc_id, source, n_chars, lag(n_chars) over w as before, ntile(4) over w as quarter, sum(n_chars) over (partition by source order by doc_id rows between 2 preceding and current row) as last3 from documents window w as (partition by source order by doc_id)")
def frames_and_lags(spark, d):
    """Neighbours by number instead of a window for each source, which may hold a third of all rows."""
    x = O.number_rows(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id")
    per = x.groupBy("source").agg(F.min("rn").alias("first"), F.count("*").alias("many"))  # a row for each source
    before = lambda k: x.select((F.col("rn") + k).alias("rn"), F.col("source").alias(f"s{k}"), F.col("n_chars").alias(f"n{k}"))
    y = x.join(before(1), "rn", "left").join(before(2), "rn", "left")
    y = y.join(per.withColumnRenamed("source", "ps"), F.col("source").eqNullSafe(F.col("ps")))
    own = lambda k: F.when(F.col("source").eqNullSafe(F.col(f"s{k}")), F.col(f"n{k}"))
    at, big = F.col("rn") - F.col("first"), F.floor(F.col("many") / 4) + 1
    extra = F.col("many") % 4
    quarter = F.when(at < extra * big, F.floor(at / big)).otherwise(extra + F.floor((at - extra * big) / F.greatest(big - 1, F.lit(1)))) + 1
    return y.select("doc_id", "source", "n_chars", own(1).alias("before"), quarter.cast("bigint").alias("quarter"), (F.col("n_chars") + F.coalesce(own(1), F.lit(0)) + F.coalesce(own(2), F.lit(0))).alias("last3"))
