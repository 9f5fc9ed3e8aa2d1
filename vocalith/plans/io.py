"""Queries over sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from vocalith.functions import sequences
from vocalith.operators.lexicon import numbered_frames
from vocalith.plans.registry import Registry
from vocalith.session import ensure_checkpoint_dir, materialize, table
from vocalith.sources import manifests as S
from vocalith.streaming import decode

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _place(spark):
    """A fresh folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/io-{uuid.uuid4().hex}"


_ALL = "id recording_id start_sec duration channel text lang speaker gender corpus subset added_at".split()


@query(f"select {', '.join(_ALL)}, custom['batch'] as batch from supervisions")
def jsonl_roundtrip(spark, d):
    p = _place(spark)
    S.write_jsonl(table(spark, d, "supervisions").select(*_ALL, "custom"), p)
    return S.read_jsonl(spark, p, S.SUPERVISIONS).select(*_ALL, F.col("custom")["batch"].alias("batch"))


@query("select id, recording_id from supervisions")
def jsonl_written_once(spark, d):
    """A second write to the same place does nothing."""
    p = _place(spark)
    s = table(spark, d, "supervisions").select("id", "recording_id")
    S.write_jsonl(s, p)
    S.write_jsonl(s.where("false"), p, mode="ignore")
    return S.read_jsonl(spark, p, "id string, recording_id string")


@query("select id, duration from recordings union all select id, duration from supervisions")
def manifest_parts(spark, d):
    """Two manifests combined."""
    p = _place(spark)
    S.write_jsonl(table(spark, d, "recordings").select("id", "duration"), f"{p}/recordings")
    S.write_jsonl(table(spark, d, "supervisions").select("id", "duration"), f"{p}/supervisions")
    return S.read_parts(spark, [f"{p}/recordings", f"{p}/supervisions"], "id string, duration double").select("id", "duration")


@query("select utt_id, spk_id from utt2spk where utt_id is not null")
def tsv_roundtrip(spark, d):
    p = _place(spark)
    t = table(spark, d, "utt2spk").where("utt_id is not null")
    t.select(F.concat("utt_id", F.lit("\t"), F.coalesce("spk_id", F.lit("NULL!"))).alias("value")).write.text(p)
    return S.read_tsv(spark, p, ["utt_id", "spk_id"]).select("utt_id", F.when(F.col("spk_id") != "NULL!", F.col("spk_id")).alias("spk_id"))


@query("select cast(id as bigint) as pos, lower(replace(symbol, '▁', '')) as word, array_to_string(string_split(symbol, ''), ' ') as tokens from symbols where symbol <> '' and symbol <> '▁'")
def lexicon_roundtrip(spark, d):
    p = _place(spark)
    y = table(spark, d, "symbols").where("symbol <> '' and symbol <> '▁'")
    w = F.concat(F.lower(F.replace("symbol", F.lit("▁"), F.lit(""))), F.lit("|"), F.col("id").cast("string"))
    S.write_lexicon(y.select(F.col("id").cast("bigint").alias("pos"), w.alias("word"), F.split("symbol", "").alias("tokens")), p)
    x = S.read_lexicon(spark, p).where("error is null")
    return x.select(F.substring_index("word", "|", -1).cast("bigint").alias("pos"), F.regexp_extract("word", r"^(.*)\|[^|]*$", 1).alias("word"), F.array_join("tokens", " ").alias("tokens"))


@query("""with l as (select distinct user_id, event_type from events where user_id is not null and event_type is not null), i as (select event_type, row_number() over (order by event_type) - 1 as id from (select distinct event_type from events where event_type is not null))
select cast(user_id as varchar) as key, string_agg(cast(id as varchar), ';' order by event_type) as labels from l join i using (event_type) group by user_id""")
def labels_csv(spark, d):
    """Label lists in lines, the names as ids from a map file."""
    p = _place(spark)
    e = table(spark, d, "events").where("user_id is not null and event_type is not null").select(F.col("user_id").cast("string").alias("k"), "event_type").distinct()
    line = F.concat("k", F.lit(', 0.000, 10.000, "'), F.array_join(F.array_sort(F.collect_list("event_type")), ","), F.lit('"'))
    e.groupBy("k").agg(line.alias("value")).select("value").write.text(f"{p}/labels")
    names = e.select("event_type").distinct()  # a handful of kinds
    names.select((F.row_number().over(Window.orderBy("event_type")) - 1).alias("index"), F.col("event_type").alias("mid"), F.col("event_type").alias("name")).write.option("header", "true").csv(f"{p}/map")
    return S.read_labels_csv(spark, f"{p}/labels", S.read_label_ids(spark, f"{p}/map"), header_rows=0)


@query("""with s as (select utt_id as id, min(recording_id) as recording_id, min(start_time) as start_sec, max(end_time) as e from segments where start_time is not null and end_time is not null group by 1),
t as (select id, min(text) as text from supervisions where regexp_full_match(text, '[ -~]*[!-~][ -~]*') group by id), k as (select utt_id as id, min(spk_id) as speaker from utt2spk where regexp_full_match(spk_id, '[!-~]+') group by 1)
select s.id, s.recording_id, round(s.start_sec, 6) as start_sec, round(e - s.start_sec, 6) as duration, trim(text, ' ') as text, speaker from s left join t using (id) left join k using (id)""")
def kaldi_dir(spark, d):
    p = _place(spark)
    g = table(spark, d, "segments").where("start_time is not null and end_time is not null").groupBy("utt_id").agg(F.min("recording_id").alias("r"), F.min("start_time").alias("a"), F.max("end_time").alias("b"))
    g.select(F.format_string("%s %s %.9f %.9f", "utt_id", "r", "a", "b").alias("value")).write.text(f"{p}/segments")
    table(spark, d, "recordings").where("source is not null").groupBy("id").agg(F.min("source").alias("s")).select(F.concat_ws(" ", "id", "s").alias("value")).write.text(f"{p}/wav.scp")
    t = table(spark, d, "supervisions").where(F.col("text").rlike(r"\A[ -~]*[!-~][ -~]*\z")).groupBy("id").agg(F.min("text").alias("t"))
    t.select(F.concat_ws(" ", "id", "t").alias("value")).write.text(f"{p}/text")
    k = table(spark, d, "utt2spk").where(F.col("spk_id").rlike(r"\A[!-~]+\z")).groupBy("utt_id").agg(F.min("spk_id").alias("s"))
    k.select(F.concat_ws(" ", "utt_id", "s").alias("value")).write.text(f"{p}/utt2spk")
    _, sup = S.read_kaldi_dir(spark, p)
    return sup.select("id", "recording_id", F.round("start_sec", 6).alias("start_sec"), F.round("duration", 6).alias("duration"), "text", "speaker")


_ALI = "(select distinct utt_id, token, start_frame, end_frame from token_spans where utt_id is not null and token is not null and start_frame is not null and end_frame is not null)"


def _ali(spark, d):
    t = table(spark, d, "token_spans").where("utt_id is not null and token is not null and start_frame is not null and end_frame is not null")
    return t.select("utt_id", "token", "start_frame", "end_frame").distinct()


@query(f"select utt_id, count(*) as frames, string_agg(cast(token as varchar), ' ' order by start_frame, end_frame, token) as ali from {_ALI} group by utt_id")
def alignment_saved(spark, d):
    """Alignments as arrays in a columnar table, written and read again."""
    p = _place(spark)
    sequences.token_arrays(_ali(spark, d)).write.parquet(p)
    a = spark.read.schema("utt_id string, a array<int>").parquet(p)
    return a.select("utt_id", F.size("a").cast("bigint").alias("frames"), sequences.joined(F.col("a")).alias("ali"))


@query("select id, recording_id, text from supervisions")
def stream_append(spark, d):
    """Rows appended to a table as they stream in."""
    src = table(spark, d, "supervisions").select("id", "recording_id", "text")
    p = _place(spark)
    src.repartition(4).write.parquet(p)
    return _run(spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(p), spark)


@query("select symbol, id from symbols")
def symbols_roundtrip(spark, d):
    p = _place(spark)
    S.write_symbols(table(spark, d, "symbols"), p)
    return S.read_symbols(spark, p)


@query("select id, '[' || array_to_string(list_transform(list_filter(string_split(text, ' '), lambda x: x <> ''), lambda w: '''' || w || ''''), ', ') || ']' as shown from (select id, min(text) as text from supervisions where id is not null and text is not null group by id)")
def transcripts_shown(spark, d):
    s = table(spark, d, "supervisions").where("id is not null and text is not null").groupBy("id").agg(F.min("text").alias("text"))
    w = F.filter(F.split("text", " "), lambda x: x != "")
    lines = S.transcript_lines(s.select("id", w.alias("ref"), w.alias("hyp"))).where("side = 0")
    return lines.select("id", F.expr("substring(value, length(id) + 7)").alias("shown"))


_T = "(select id, list_filter(string_split(text, ' '), lambda x: x <> '') as w from (select id, min(text) as text from supervisions where id is not null and text is not null group by id))"
_PLAIN = "list_filter(w, lambda x: regexp_full_match(x, '[A-Za-z]+'))"


def _texts(spark, d):
    s = table(spark, d, "supervisions").where("id is not null and text is not null").groupBy("id").agg(F.min("text").alias("text"))
    return s.select("id", F.filter(F.split("text", " "), lambda x: x != "").alias("w"))


@query(f"""with t as (select id, w as ref, list_filter(w, lambda x: not starts_with(x, 'th')) as hyp from {_T}),
n as (select unnest([1, 2, 3, 4]) as n),
h as (select id, n, g, count(*) as c from (select id, n, array_to_string(hyp[i:i + n - 1], chr(1)) as g from (select id, hyp, n, unnest(generate_series(1, len(hyp) - n + 1)) as i from t, n where len(hyp) >= n)) group by all),
r as (select id, n, g, count(*) as c from (select id, n, array_to_string(ref[i:i + n - 1], chr(1)) as g from (select id, ref, n, unnest(generate_series(1, len(ref) - n + 1)) as i from t, n where len(ref) >= n)) group by all),
p as (select h.n, sum(least(h.c, coalesce(r.c, 0))) / sum(h.c) as p from h left join r on r.id = h.id and r.n = h.n and r.g = h.g group by h.n),
l as (select sum(len(hyp)) as h, sum(len(ref)) as r from t)
select round(100 * exp((select avg(ln(greatest(p, 1e-12))) from p) + case when h >= r then 0 else 1 - r / h end), 6) as bleu, h / r as ratio from l""")
def transcripts_bleu(spark, d):
    t = _texts(spark, d).select("id", F.col("w").alias("ref"), F.filter("w", lambda x: ~x.startswith("th")).alias("hyp"))
    return S.corpus_bleu(t).select(F.round("bleu", 6).alias("bleu"), "ratio")


@query(f"select id, array_to_string({_PLAIN}, ' ') as ref, array_to_string(list_filter({_PLAIN}, lambda x: not starts_with(x, 'th')), ' ') as hyp from {_T}")
def transcripts_parsed(spark, d):
    """Lines of results, their words of letters only, written and read again."""
    w = F.filter("w", lambda x: x.rlike(r"\A[A-Za-z]+\z"))
    t = _texts(spark, d).select("id", w.alias("ref"), F.filter(w, lambda x: ~x.startswith("th")).alias("hyp"))
    back = S.parse_transcripts(S.transcript_lines(t))
    return back.select("id", F.array_join("ref", " ").alias("ref"), F.array_join("hyp", " ").alias("hyp"))


@query(f"select id, array_to_string({_PLAIN}, '') as ref from {_T}")
def transcripts_joined(spark, d):
    """The references of lines of results, their words joined without blanks."""
    t = _texts(spark, d).select("id", F.filter("w", lambda x: x.rlike(r"\A[A-Za-z]+\z")).alias("ref"))
    return S.joined_references(S.transcript_lines(t.withColumn("hyp", F.col("ref"))))


@query(f"""with t as (select utt_id as id, list(start_frame order by start_frame, end_frame, token) as a from {_ALI} group by 1)
select id, id || ':' || chr(9) || 'timestamp_ref=[' || array_to_string(list_transform(a, lambda x: printf('%.3f', x * 0.04)), ', ') || ']' as value from t""")
def transcripts_times(spark, d):
    x = sequences.token_arrays(_ali(spark, d), also="start_frame").select(F.col("utt_id").alias("id"), F.transform("a", lambda y: y.cast("string")).alias("ref"), F.transform("b", lambda y: y * 0.04).alias("time_ref"))
    lines = S.transcript_lines(x.withColumns({"hyp": F.col("ref"), "time_hyp": F.col("time_ref")}), times=True)
    return lines.where("side = 2").select("id", "value")


@query("""with w as (select unnest(string_split(lower(replace(symbol, '▁', '')), '')) as word from symbols), c as (select word, count(*) as n from w where word <> '' group by word), t as (select sum(n) as t from c)
select 1 as n, word, round(n / t, 5) as f from c, t""")
def arpa_roundtrip(spark, d):
    p = _place(spark)
    w = table(spark, d, "symbols").select(F.explode(F.split(F.lower(F.replace("symbol", F.lit("▁"), F.lit(""))), "")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("c"))
    m = w.crossJoin(w.agg(F.sum("c").alias("t")))  # by one row
    S.write_arpa(m.select(F.lit(1).alias("n"), F.lit("").alias("history"), "word", (F.col("c") / F.col("t")).alias("f"), F.lit(None).cast("double").alias("bow")), p)
    return S.read_arpa(spark, p).select("n", "word", F.round("f", 5).alias("f"))


def _run(df, spark, mode="append"):
    """The rows a stream gives over all that is there now."""
    name = "s" + uuid.uuid4().hex[:8]
    p = _place(spark)
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{p}/state").trigger(availableNow=True)
    if mode == "append":
        q.format("parquet").option("path", f"{p}/out").start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{p}/out")
    q.format("memory").queryName(name).start().awaitTermination()
    return materialize(spark.table(name))


@query("""with l as (select distinct utt_id, start_frame, token from token_spans where utt_id is not null and start_frame is not null and token is not null),
o as (select *, row_number() over w - 1 as f, lag(token) over w as before from l window w as (partition by utt_id order by start_frame, token)),
g as (select *, sum(case when before = token then 0 else 1 end) over (partition by utt_id order by f rows unbounded preceding) as run from o)
select utt_id, token, cast(min(f) as integer) as start, cast(max(f) + 1 as integer) as stop from g where token <> 0 group by utt_id, run, token""")
def stream_token_runs(spark, d):
    t = table(spark, d, "token_spans").where("utt_id is not null and start_frame is not null and token is not null").select("utt_id", "start_frame", "token")
    t = numbered_frames(t, repeated=True).select("utt_id", F.col("f").cast("int").alias("frame"), "token", F.col("last").alias("is_last"))
    t = materialize(t)
    frames = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 8).parquet(t._written_to)
    return _run(decode.stream_runs(frames), spark).select("utt_id", "token", "start", "stop")


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, sum(value) as total from events group by 1, 2")
def stream_windows(spark, d):
    schema = table(spark, d, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(d)
    return _run(decode.windowed_totals(e), spark, "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""with o as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as before from events),
g as (select *, sum(case when before is null or ts >= before + interval 30 minutes then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as s from o)
select user_id, min(ts) as start, max(ts) + interval 30 minutes as stop, count(*) as n from g group by user_id, s""")
def session_windows(spark, d):
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    g = e.groupBy("user_id", F.session_window("t", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "n")
