"""Queries that attach, cut and index a corpus: alignments, labels, cuts, vocabularies and training data of language models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vocalith.functions import conversation as C
from vocalith.functions import sequences as S
from vocalith.operators import cuts as K
from vocalith.operators import evaluation as E
from vocalith.operators import search
from vocalith.operators.ordering import number_rows
from vocalith.plans.registry import Registry
from vocalith.session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_ONCE = "(select id, min(text) as text, min(recording_id) as recording_id, min(start_sec) as start_sec, max(duration) as duration, min(speaker) as speaker, min(subset) as subset, min(corpus) as corpus, min(lang) as lang from supervisions where id is not null group by id)"
_W = "list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')"


def _once(spark, d):
    low = ("text", "recording_id", "start_sec", "speaker", "subset", "corpus", "lang")
    return table(spark, d, "supervisions").where("id is not null").groupBy("id").agg(*[F.min(c).alias(c) for c in low], F.max("duration").alias("duration"))


def _words(c="text"):
    return F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda w: w != "")


def _spans(spark, d):
    t = table(spark, d, "token_spans").where("utt_id is not null and token is not null and start_frame is not null and end_frame is not null")
    return t.select("utt_id", "token", "start_frame", "end_frame").distinct()


_SPANS = "(select distinct utt_id, token, start_frame, end_frame from token_spans where utt_id is not null and token is not null and start_frame is not null and end_frame is not null)"
_LEXICON = "(select lower(replace(symbol, '▁', '')) as word, min(id) as wid, string_split(lower(replace(arg_min(symbol, id), '▁', '')), '') as tokens from symbols where symbol <> '▁' and symbol <> '' group by 1)"


def _lexicon(spark, d):
    y = table(spark, d, "symbols").where("symbol <> '▁' and symbol <> ''")
    w = F.lower(F.replace("symbol", F.lit("▁"), F.lit("")))
    return y.groupBy(w.alias("word")).agg(F.min("id").alias("wid"), F.split(F.lower(F.replace(F.min_by("symbol", "id"), F.lit("▁"), F.lit(""))), "").alias("tokens"))


# Attaching


@query(f"""with a as (select utt_id as id, count(*) as items, string_agg(cast(token as varchar), ' ' order by start_frame, end_frame, token) as ali from {_SPANS} group by 1)
select s.id, coalesce(items, 0) as items, coalesce(ali, '') as ali from {_ONCE} s left join a on a.id = s.id""")
def attach_alignment(spark, d):
    """Alignments by id; what has none gets an empty list and stays."""
    a = S.token_arrays(_spans(spark, d)).select(F.col("utt_id").alias("id"), "a")
    return _once(spark, d).select("id").join(a, "id", "left").select("id", F.coalesce(F.size("a"), F.lit(0)).cast("bigint").alias("items"), F.coalesce(S.joined(F.col("a")), F.lit("")).alias("ali"))


@query("""with a as (select distinct on (utt_id) utt_id as id, start_time from segments where start_time is not null order by utt_id, start_time),
n as (select regexp_replace(id, '_sp(0\\.9|1\\.1)$', '') as base, id from (select distinct id from supervisions))
select n.id, start_time from n join a on a.id = n.base""")
def attach_by_base_id(spark, d):
    """Attributes by id without the mark of a copy; both sides may come in any order of rows."""
    a = table(spark, d, "segments").where("start_time is not null").groupBy(F.col("utt_id").alias("base")).agg(F.min("start_time").alias("start_time"))
    s = table(spark, d, "supervisions").select("id").distinct().withColumn("base", F.regexp_replace("id", r"_sp(0\.9|1\.1)$", ""))
    return s.join(a, "base").select("id", "start_time")


@query("""with t as (select corpus, id, recording_id, subset from supervisions), test as (select distinct recording_id from utt2spk u join supervisions s on s.id = u.utt_id where regexp_matches(spk_id, '[0-4]$'))
select id, case when recording_id in (select recording_id from test where recording_id is not null) then 'test' else 'train' end as part from (select distinct id, recording_id from t where id is not null)""")
def split_by_speaker(spark, d):
    """Recordings of the chosen speakers are the test part, and their supervisions follow them."""
    s = table(spark, d, "supervisions").where("id is not null").select("id", "recording_id").distinct()
    test = table(spark, d, "utt2spk").where(F.col("spk_id").rlike("[0-4]$")).select(F.col("utt_id").alias("id")).join(s, "id").select("recording_id").distinct().withColumn("t", F.lit("test"))
    return s.join(test, "recording_id", "left").select("id", F.coalesce("t", F.lit("train")).alias("part"))


@query(f"""with x as (select utt_id, list(start_frame order by start_frame, end_frame, token) as a, list(end_frame order by end_frame, start_frame, token) as b from {_SPANS} group by utt_id),
y as (select abs(round(a[i] * 0.04, 2) - round(b[i] * 0.04, 2)) as diff from (select a, b, unnest(generate_series(1, len(a))) as i from x))
select count(*) as n, round(avg(diff), 6) as mean, round(stddev_samp(diff), 6) as std from y""")
def compare_times_by_place(spark, d):
    """Two lists of times of an utterance zipped by place: mean and sample deviation of their rounded differences."""
    return K.place_differences(_spans(spark, d), 0.04)


@query(f"""with l as {_LEXICON}, w as (select id, unnest({_W}) as word, generate_subscripts({_W}, 1) as pos from {_ONCE} where text is not null),
j as (select w.id, pos, coalesce(tokens, ['<unk>']) as tokens from w left join l on l.word = lower(w.word))
select id, array_to_string(flatten(list(tokens order by pos)), ' ') as tokens from j group by id""")
def lexicon_token_index(spark, d):
    """Words to the tokens of their pronunciation, strung together; an unknown word has the unknown token."""
    w = _once(spark, d).where("text is not null").select("id", F.posexplode(_words()).alias("pos", "word"))
    j = w.join(_lexicon(spark, d).select(F.col("word").alias("key"), "tokens"), F.lower("word") == F.col("key"), "left")
    a = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("tokens", F.array(F.lit("<unk>"))).alias("t"))))
    return j.groupBy("id").agg(a.alias("a")).select("id", F.array_join(F.flatten("a.t"), " ").alias("tokens"))


@query(f"""with l as {_LEXICON}, w as (select id, unnest({_W}) as word, generate_subscripts({_W}, 1) as pos from {_ONCE} where text is not null)
select id, string_agg(coalesce(array_to_string(tokens, '+'), 'SPN'), ' ' order by pos) as prons from w left join l on l.word = lower(w.word) group by id""")
def lexicon_pronounce(spark, d):
    w = _once(spark, d).where("text is not null").select("id", F.posexplode(_words()).alias("pos", "word"))
    j = w.join(_lexicon(spark, d).select(F.col("word").alias("key"), "tokens"), F.lower("word") == F.col("key"), "left")
    a = F.array_sort(F.collect_list(F.struct("pos", F.coalesce(F.array_join("tokens", "+"), F.lit("SPN")).alias("p"))))
    return j.groupBy("id").agg(a.alias("a")).select("id", F.array_join("a.p", " ").alias("prons"))


# Cutting


@query(f"""with r as (select id as recording_id, max(duration) as rd from recordings group by id)
select s.recording_id || '-' || s.id as cut_id, s.start_sec as offset_sec, s.duration, rd - (s.start_sec + s.duration) as rest from {_ONCE} s join r using (recording_id) where start_sec is not null and s.duration > 0""")
def trim_to_supervisions(spark, d):
    return K.trim_to_supervisions(table(spark, d, "recordings"), _once(spark, d))


@query("""with r as (select id, max(duration) as duration from recordings where id is not null group by id)
select id, case when id in (select recording_id from supervisions where recording_id is not null) then 'kept' else 'filled' end as state, duration from r""")
def fill_supervisions(spark, d):
    f = K.fill_supervisions(table(spark, d, "recordings"), table(spark, d, "supervisions"))
    return f.select("id", F.when(F.size("supervisions") == 1, F.when(F.get("supervisions", 0)["text"] == "", "filled").otherwise("kept")).otherwise("kept").alias("state"), "duration")


@query("""with r as (select id, max(duration) as duration from recordings where duration > 0 group by id), k as (select *, cast(ceil(30.0 / duration) as bigint) as times from r)
select id, unnest(generate_series(0, times - 1)) as copy, least(duration, 30.0 - unnest(generate_series(0, times - 1)) * duration) as length from k""")
def repeat_to_length(spark, d):
    return K.repeat_to_length(table(spark, d, "recordings"), 30.0)


@query("""with b as (select distinct recording_id, id, start_sec, start_sec + duration as end_sec from supervisions where recording_id is not null and id is not null and start_sec is not null and duration is not null),
s as (select recording_id || x.sfx as recording_id, id || x.sfx as id, start_sec, end_sec from b, (values ('-ihm'), ('-sdm'), ('-gss')) x(sfx)),
p as (select s.*, g.pause, max(end_sec) over (partition by recording_id, g.pause order by start_sec, end_sec, id rows between unbounded preceding and 1 preceding) as reach from s, (values (0.5), (0.0)) g(pause)),
n as (select *, sum(case when reach is null or start_sec - reach > pause then 1 else 0 end) over (partition by recording_id, pause order by start_sec, end_sec, id rows unbounded preceding) as group_no from p)
select recording_id, cast(pause as double) as pause, cast(group_no as bigint) as group_no, min(start_sec) as start_sec, max(end_sec) as end_sec, count(*) as n from n group by 1, 2, 3""")
def union_of_sources(spark, d):
    """Segments of three sources, their ids marked, grouped by two pauses, in one table."""
    return K.grouped_sources(table(spark, d, "supervisions"), ("-ihm", "-sdm", "-gss"), (0.5, 0.0))


@query("""with s as (select id, max(duration) as duration from supervisions where id is not null and duration is not null group by id)
select id, duration, row_number() over (order by duration desc, id) as position from s""")
def sort_by_duration(spark, d):
    s = table(spark, d, "supervisions").where("id is not null and duration is not null").groupBy("id").agg(F.max("duration").alias("duration")).withColumn("_d", -F.col("duration"))
    return number_rows(s, "_d", "id", name="position").select("id", "duration", "position")


@query("""with r as (select recording_id, id from (select distinct recording_id, id from supervisions where id is not null and recording_id is not null))
select recording_id, count(*) as n, min(id) as first_id, max(id) as last_id from r group by recording_id""")
def group_by_recording(spark, d):
    s = table(spark, d, "supervisions").where("id is not null and recording_id is not null").select("recording_id", "id").distinct()
    return s.groupBy("recording_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("""with r as (select id as recording_id, max(duration) as duration from recordings where id is not null group by id), s as (select distinct id, recording_id from supervisions where id is not null)
select count(*) as total, count_if(duration is not null) as kept, count(distinct case when duration is not null then s.recording_id end) as n_recordings from s left join r using (recording_id)""")
def manifest_entries(spark, d):
    """Entries whose recording is there and has a length, beside all of them."""
    r = table(spark, d, "recordings").where("id is not null").groupBy(F.col("id").alias("recording_id")).agg(F.max("duration").alias("duration"))
    s = table(spark, d, "supervisions").where("id is not null").select("id", "recording_id").distinct().join(r, "recording_id", "left")
    there = F.col("duration").isNotNull()
    return s.agg(F.count("*").alias("total"), F.count_if(there).alias("kept"), F.count_distinct(F.when(there, F.col("recording_id"))).alias("n_recordings"))


# Fields


@query("select id, recording_id, coalesce(upper(custom['batch']), '') as batch, custom['batch'] is not null as there from (select distinct id, recording_id, map {'batch': custom['batch']} as custom from supervisions)")
def nested_field_set(spark, d):
    """A field inside a struct read, and written only where it is there."""
    s = table(spark, d, "supervisions").select("id", "recording_id", F.struct(F.struct(F.col("custom")["batch"].alias("batch")).alias("custom")).alias("s")).distinct()
    s = s.withColumn("s", K.set_nested(F.col("s"), ("custom", "batch"), F.upper))
    x = K.get_nested(F.col("s"), ("custom", "batch"))
    return s.select("id", "recording_id", F.coalesce(x, F.lit("")).alias("batch"), x.isNotNull().alias("there"))


@query("select distinct id, coalesce(custom['batch'], text) as text from supervisions where id is not null")
def custom_field_drop(spark, d):
    """The text from a custom field where there is one; the field itself goes."""
    s = table(spark, d, "supervisions").where("id is not null")
    return s.withColumn("text", F.coalesce(F.col("custom")["batch"], "text")).drop("custom").select("id", "text").distinct()


@query(f"select id, upper(trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9'']', ' ', 'g'), ' +', ' ', 'g'), ' ')) as text from {_ONCE} where regexp_matches(text, '[A-Za-z0-9'']')")
def drop_empty_after_normalize(spark, d):
    from vocalith.functions.text import to_upper_words

    return _once(spark, d).select("id", to_upper_words(F.col("text")).alias("text")).where("text <> ''")


@query(f"select id from {_ONCE} where regexp_replace(coalesce(text, ''), '\\s+', '', 'g') <> '' and regexp_replace(coalesce(lang, ''), '\\s+', '', 'g') <> ''")
def filter_text_and_translation(spark, d):
    """Rows where neither the text nor its counterpart (the language field stands in for it) is blank."""
    blank = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "") == ""
    return _once(spark, d).where(~blank("text") & ~blank("lang")).select("id")


@query(f"select id || '\t' || coalesce(text, '') as line from {_ONCE} where len({_W}) > 0")
def kaldi_nonempty_lines(spark, d):
    """Lines with more than the id."""
    return _once(spark, d).where(F.size(_words()) > 0).select(F.concat("id", F.lit("\t"), "text").alias("line"))


@query(f"select id, unnest(case when lang is not null then [text] else [text, corpus] end) as text from {_ONCE} where text is not null")
def texts_of_entries(spark, d):
    """The text of an entry, or all texts of its nested rows."""
    s = _once(spark, d).where("text is not null")
    one = s.select("id", F.when(F.col("lang").isNotNull(), F.col("text")).alias("text"), F.when(F.col("lang").isNull(), F.array(F.struct("text"), F.struct(F.col("corpus").alias("text")))).alias("supervisions"))
    return one.select("id", F.explode(F.coalesce(F.array("text"), F.array())).alias("t"), "supervisions").select("id", F.explode(F.when(F.col("supervisions").isNull(), F.array("t")).otherwise(F.col("supervisions")["text"])).alias("text"))


@query(f"select id, 'source' as side, text as line from {_ONCE} where text is not null and lang is not null union all select id, 'target', lang from {_ONCE} where text is not null and lang is not null")
def parallel_split(spark, d):
    s = _once(spark, d).where("text is not null and lang is not null")
    return s.select("id", F.inline(F.array(F.struct(F.lit("source").alias("side"), F.col("text").alias("line")), F.struct(F.lit("target").alias("side"), F.col("lang").alias("line")))))


@query(f"select id, '' as text, regexp_replace(text, '\\(.*?\\)', '', 'g') as fluent, regexp_replace(text, '[^A-Za-z ]', '', 'g') as plain from {_ONCE} where text is not null")
def transcript_modes(spark, d):
    """A custom field for each way of reading a transcript; the text itself is emptied."""
    s = _once(spark, d).where("text is not null").withColumn("custom", F.create_map(F.lit("fluent"), F.regexp_replace("text", r"\(.*?\)", ""), F.lit("plain"), F.regexp_replace("text", "[^A-Za-z ]", "")))
    return s.select("id", F.lit("").alias("text"), F.col("custom")["fluent"].alias("fluent"), F.col("custom")["plain"].alias("plain"))


# Vocabularies


def _ids(spark, words, head, tail, start=None):
    """(word, id): fixed symbols, the words in order, fixed symbols."""
    n = number_rows(words, "word").select("word", (F.col("rn") + len(head) - 1).cast("bigint").alias("id"))
    total = n.agg(F.count("*").alias("n"))
    a = spark.createDataFrame([(w, i) for i, w in enumerate(head)], "word string, id bigint")
    b = spark.createDataFrame([(w, i) for i, w in enumerate(tail)], "word string, k bigint").crossJoin(total)  # some fixed symbols by one row
    return a.unionByName(n).unionByName(b.select("word", (F.col("n") + len(head) + F.col("k")).alias("id")))


def _ids_sql(words, head, tail):
    h = ", ".join(f"('{w}', {i})" for i, w in enumerate(head))
    t = ", ".join(f"('{w}', {i})" for i, w in enumerate(tail))
    return f"""with w as ({words}), n as (select word, row_number() over (order by word) + {len(head) - 1} as id from w), c as (select count(*) as n from w)
select * from (values {h}) h(word, id) union all select * from n union all select t.word, c.n + {len(head)} + t.id from (values {t}) t(word, id), c"""


@query(_ids_sql("select distinct word from (select unnest(string_split(lower(trim(replace(symbol, '▁', '_'), '-')), '_')) as word from symbols union all select '<unk>') where word = '<unk>' or regexp_full_match(word, '[a-z'']+')", ("<eps>", "!SIL"), ("#0", "<s>", "</s>")))
def word_set_underscore(spark, d):
    w = table(spark, d, "symbols").select(F.explode(F.split(F.lower(F.trim(F.replace("symbol", F.lit("▁"), F.lit("_")), F.lit("-"))), "_")).alias("word"))
    w = w.where(F.col("word").rlike("^[a-z']+$")).unionByName(spark.createDataFrame([("<unk>",)], "word string")).distinct()
    return _ids(spark, w, ("<eps>", "!SIL"), ("#0", "<s>", "</s>"))


@query(_ids_sql(f"select distinct word from (select unnest({_W}) as word from {_ONCE}) where word not in ('<eps>', '!SIL', '<UNK>', '#0', '<s>', '</s>')", ("<eps>", "!SIL", "<UNK>"), ("#0", "<s>", "</s>")))
def word_set_reserved(spark, d):
    """All words of the texts; reserved symbols among them would clash with the fixed ones and are left out."""
    w = _once(spark, d).select(F.explode(_words()).alias("word")).distinct()
    return _ids(spark, w.where(~F.col("word").isin("<eps>", "!SIL", "<UNK>", "#0", "<s>", "</s>")), ("<eps>", "!SIL", "<UNK>"), ("#0", "<s>", "</s>"))


@query(_ids_sql(f"select distinct c as word from (select unnest(string_split(replace(text, ' ', ''), '')) as c from {_ONCE} where not contains(id, '_sp')) where c <> ''", ("<blk>",), ("<unk>", "<sos/eos>")))
def token_set_without_copies(spark, d):
    c = _once(spark, d).where(~F.col("id").contains("_sp")).select(F.explode(F.split(F.replace("text", F.lit(" "), F.lit("")), "")).alias("word")).where("word <> ''").distinct()
    return _ids(spark, c, ("<blk>",), ("<unk>", "<sos/eos>"))


@query("""with f as (select distinct 'corpus' as slot, corpus as value from supervisions where corpus is not null union select distinct 'lang', lang from supervisions where lang is not null union select distinct 'gender', gender from supervisions where gender is not null)
select slot, value, row_number() over (partition by slot order by value) - 1 as id from f""")
def frame_vocabulary(spark, d):
    """The distinct values of each slot of a frame with their ids; slots have few values."""
    s = table(spark, d, "supervisions").select(F.inline(F.array(*[F.struct(F.lit(c).alias("slot"), F.col(c).alias("value")) for c in ("corpus", "lang", "gender")]))).where("value is not null").distinct()
    return s.select("slot", "value", (F.row_number().over(Window.partitionBy("slot").orderBy("value")) - 1).cast("bigint").alias("id"))


@query(f"select word, array_to_string(list_transform(string_split(word, ''), lambda c: case when c = '*' then 'V' else c end), ' ') as tokens from (select distinct word from (select unnest({_W}) as word from {_ONCE}))")
def char_lexicon_star(spark, d):
    w = _once(spark, d).select(F.explode(_words()).alias("word")).distinct()
    return w.select("word", F.array_join(F.transform(F.split("word", ""), lambda c: F.when(c == "*", "V").otherwise(c)), " ").alias("tokens"))


_CHARS = "(select distinct c from (select unnest(string_split(lower(replace(symbol, '▁', '')), '')) as c from symbols))"


def _chars(spark, d):
    return table(spark, d, "symbols").select(F.explode(F.split(F.lower(F.replace("symbol", F.lit("▁"), F.lit(""))), "")).alias("c")).distinct()


@query(f"""with w as (select distinct word from (select unnest({_W}) as word from {_ONCE})), c as (select word, unnest(string_split(word, '')) as c from w),
b as (select distinct word from c where c not in (select c from {_CHARS} where c is not null))
select word, array_to_string(string_split(word, ''), ' ') as tokens from w where word not in (select word from b)""")
def char_lexicon_known(spark, d):
    """Words as their characters; a word with a character outside the table is left out."""
    w = _once(spark, d).select(F.explode(_words()).alias("word")).distinct()
    bad = w.select("word", F.explode(F.split("word", "")).alias("c")).join(_chars(spark, d), "c", "left_anti").select("word").distinct()
    return w.join(bad, "word", "left_anti").select("word", F.array_join(F.split("word", ""), " ").alias("tokens"))


@query(f"""with w as (select distinct word from (select unnest({_W}) as word from {_ONCE})), c as (select word, unnest(string_split(word, '')) as c from w)
select count(distinct word) as words, count(distinct case when c not in (select c from {_CHARS} where c is not null) then word end) as oov_words, count(distinct case when c not in (select c from {_CHARS} where c is not null) then c end) as oov_tokens from c""")
def lexicon_oov_check(spark, d):
    """How many words of the texts have a token outside the table, and which tokens those are."""
    c = _once(spark, d).select(F.explode(_words()).alias("word")).distinct().select("word", F.explode(F.split("word", "")).alias("c"))
    c = c.join(_chars(spark, d).withColumn("known", F.lit(True)), "c", "left")
    out = F.col("known").isNull()
    return c.agg(F.count_distinct("word").alias("words"), F.count_distinct(F.when(out, F.col("word"))).alias("oov_words"), F.count_distinct(F.when(out, F.col("c"))).alias("oov_tokens"))


@query(f"""with l as {_LEXICON} select word, t as piece from (select word, unnest(tokens) as t from l) where t not in (select symbol from symbols where symbol is not null) group by all""")
def lexicon_unknown_pieces(spark, d):
    """Pieces of the lexicon that are not in the vocabulary."""
    p = _lexicon(spark, d).select("word", F.explode("tokens").alias("piece")).distinct()
    return p.join(table(spark, d, "symbols").select(F.col("symbol").alias("piece")), "piece", "left_anti").select("word", "piece")


# Language-model training data


_LM = f"""w as (select id, unnest({_W}) as word, generate_subscripts({_W}, 1) as pos from {_ONCE}),
f as (select word, min(id || chr(1) || lpad(cast(pos as varchar), 9, '0')) as first, length(word) as pieces from w group by word),
x as (select word, pieces, row_number() over (order by first) - 1 as wid from f)"""


def _word_index(spark, d):
    """(id, pos, word) of all texts, and (word, wid) numbered by first appearance, texts in the order of their ids."""
    w = _once(spark, d).select("id", F.posexplode(_words()).alias("pos", "word"))
    first = F.min(F.concat("id", F.lit("\x01"), F.lpad((F.col("pos") + 1).cast("string"), 9, "0")))
    n = number_rows(w.groupBy("word").agg(first.alias("first")), "first")
    return w, n.select("word", (F.col("rn") - 1).alias("wid"))


@query(f"with {_LM} select word, wid, pieces from x")
def lm_word_index(spark, d):
    _, x = _word_index(spark, d)
    return x.select("word", "wid", F.length("word").cast("bigint").alias("pieces"))


@query(f"with {_LM} select w.id, string_agg(cast(wid as varchar), ' ' order by pos) as sentence, cast(sum(pieces) as bigint) as length from w join x using (word) group by w.id")
def lm_sentences(spark, d):
    """Texts as ids of words, with their length in pieces (characters)."""
    w, x = _word_index(spark, d)
    g = w.join(x, "word").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "wid"))).alias("a"), F.sum(F.length("word")).alias("length"))
    return g.select("id", F.array_join(F.transform("a", lambda y: y["wid"].cast("string")), " ").alias("sentence"), "length")


_CID = "(select c, row_number() over (order by c) + 2 as cid from (select distinct c from (select unnest(string_split(lower(replace(symbol, '▁', '')), '')) as c from symbols) where c <> ''))"


def _char_ids(spark, d):
    """The characters of the symbols with ids after three fixed ones; the alphabet is small."""
    return _chars(spark, d).where("c <> ''").select("c", (F.row_number().over(Window.orderBy("c")) + 2).alias("cid"))


@query(f"""with t as (select id, unnest(string_split(replace(text, ' ', ''), '')) as c, generate_subscripts(string_split(replace(text, ' ', ''), ''), 1) as pos from {_ONCE} where replace(text, ' ', '') <> '')
select id, string_agg(cast(coalesce(cid, 2) as varchar), ' ' order by pos) as ids, count(*) as length from t left join {_CID} k on k.c = t.c group by id""")
def char_ids(spark, d):
    """Texts as ids of characters, blanks left out, 2 for an unknown one."""
    t = _once(spark, d).select("id", F.replace("text", F.lit(" "), F.lit("")).alias("t")).where("t <> ''").select("id", F.posexplode(F.split("t", "")).alias("pos", "c"))
    g = t.join(_char_ids(spark, d), "c", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("cid", F.lit(2)).alias("k")))).alias("a"))
    return g.select("id", F.array_join(F.transform("a", lambda y: y["k"].cast("string")), " ").alias("ids"), F.size("a").cast("bigint").alias("length"))


@query(f"""with t as (select id, unnest({_W}) as word, generate_subscripts({_W}, 1) as pos from {_ONCE} where text is not null), y as (select replace(symbol, '▁', '') as piece, min(id) as pid from symbols where symbol <> '▁' group by 1)
select t.id, string_agg(case when lower(word) = '<unk>' then '3 2' else coalesce(cast(pid as varchar), '2') end, ' ' order by pos) as ids from t left join y on y.piece = lower(word) group by t.id""")
def piece_ids_with_unknown(spark, d):
    """Words as ids of pieces; the unknown mark becomes the ids of the word start and of the unknown piece."""
    t = _once(spark, d).where("text is not null").select("id", F.posexplode(_words()).alias("pos", "word"))
    y = table(spark, d, "symbols").where("symbol <> '▁'").groupBy(F.replace("symbol", F.lit("▁"), F.lit("")).alias("piece")).agg(F.min("id").alias("pid"))
    j = t.join(y, F.lower("word") == F.col("piece"), "left").withColumn("k", F.when(F.lower("word") == "<unk>", "3 2").otherwise(F.coalesce(F.col("pid").cast("string"), F.lit("2"))))
    return j.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "k"))).alias("a")).select("id", F.array_join("a.k", " ").alias("ids"))


# Labels and times


@query(f"""with a as (select utt_id, list(token order by start_frame, end_frame, token) as a from {_SPANS} group by utt_id)
select utt_id, len(a) as frames, list_sum(list_transform(generate_series(0, 7), lambda k: len(list_filter(a, lambda t: t % 8 <> k)) * -10.0)) as total from a""")
def alignment_mask(spark, d):
    """The sum of masks with 0 at the aligned class and -10 at the others, of 8 classes."""
    a = S.token_arrays(_spans(spark, d)).select("utt_id", F.transform("a", lambda t: t % 8).alias("a"))
    m = S.one_hot_mask(F.col("a"), 8, -10.0)
    flat = F.aggregate(F.flatten(m), F.lit(0.0), lambda x, y: x + y)
    return a.select("utt_id", F.size("a").cast("bigint").alias("frames"), flat.alias("total"))


@query(f"""with t as (select s.*, y.symbol, row_number() over w as i, lead(y.symbol) over w as nxt from {_SPANS} s join (select id, min(symbol) as symbol from symbols group by id) y on y.id = token where token > 2 window w as (partition by utt_id order by start_frame, end_frame, token))
select utt_id, start_frame, round(start_frame * 0.04, 3) as seconds from t where (i = 1 or starts_with(symbol, '▁')) and not (symbol = '▁' and (nxt is null or starts_with(nxt, '▁')))""")
def word_start_times(spark, d):
    """The time of the first piece of each word; a lone word start before another one, or at the end, is none."""
    y = table(spark, d, "symbols").groupBy(F.col("id").alias("token")).agg(F.min("symbol").alias("symbol"))
    return S.word_starts(_spans(spark, d).where("token > 2").join(y, "token")).select("utt_id", "start_frame", F.round(F.col("start_frame") * 0.04, 3).alias("seconds"))


@query("""with b as (select vec_id // 5 as utt, vec_id, round(embedding[1]::double, 4) as am, label % 3 as words from embeddings)
select utt, words, max(am) as am, count(*) as paths from b group by utt, words""")
def nbest_distinct(spark, d):
    """The distinct word sequences among the paths of an utterance, each with its best score."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("utt"), F.round(F.get("embedding", 0).cast("double"), 4).alias("am"), (F.col("label") % 3).alias("words"))
    return e.groupBy("utt", "words").agg(F.max("am").alias("am"), F.count("*").alias("paths"))


@query("""with b as (select vec_id // 5 as utt, vec_id, round(embedding[1]::double, 4) as am, round(embedding[2]::double, 4) as lm, label from embeddings),
s as (select scale, utt, arg_max(label, am / scale + lm) as got, arg_max(label, am) as want from b, (values (0.5), (1.0), (2.0), (4.0)) t(scale) group by scale, utt)
select cast(scale as double) as scale, round(100.0 * count_if(got <> want) / count(*), 6) as error, rank() over (order by round(100.0 * count_if(got <> want) / count(*), 6), scale) as place from s group by scale""")
def best_scale_table(spark, d):
    """Error rates by scale, the best first."""
    e = table(spark, d, "embeddings")
    r = lambda i, n: F.round(F.get("embedding", i).cast("double"), 4).alias(n)
    b = e.select(F.floor(F.col("vec_id") / 5).alias("utt"), r(0, "am"), r(1, "lm"), "label", F.explode(F.array(*map(F.lit, (0.5, 1.0, 2.0, 4.0)))).alias("scale"))
    s = b.groupBy("scale", "utt").agg(F.max_by("label", F.col("am") / F.col("scale") + F.col("lm")).alias("got"), F.max_by("label", "am").alias("want"))
    return E.error_table(s, "scale")


@query(None)
def keyword_search(spark, d):
    """Keywords in the best labels of the frames of an utterance."""
    e = table(spark, d, "embeddings").withColumn("utt", F.floor(F.col("vec_id") / 20))
    return search.keyword_hits(e, "utt", "vec_id", "embedding", [(3,), (7, 11), (5, 9)], threshold=0.0)


@query(f"""with t as (select id, {_W} as w from {_ONCE}) select id, array_to_string(list_filter(w, lambda x: length(x) > 9), ' ') as words, len(list_filter(w, lambda x: length(x) > 9)) as n from t where len(list_filter(w, lambda x: length(x) > 9)) > 0""")
def biasing_lists(spark, d):
    """Long words of a text written as a list in a line and read back."""
    return K.read_biasing(K.biasing_lines(_once(spark, d).select("id", F.filter(_words(), lambda x: F.length(x) > 9).alias("words")).where(F.size("words") > 0))).select("id", F.array_join("words", " ").alias("words"), F.size("words").cast("bigint").alias("n"))


@query(None)
def sentence_batches(spark, d):
    """Contiguous batches over texts by length, smaller where texts are long."""
    return K.sentence_batches(_once(spark, d).where("text is not null").select("id", F.size(_words()).alias("length")), 50, 20)


@query(f"""with n as (select utt_id, count(*) as n from {_SPANS} group by utt_id)
select utt_id, k as chunk, k * 16 as start, least(n - k * 16, 23) as frames, (k + 1) * 16 >= n as done from (select utt_id, n, unnest(generate_series(0, (n - 1) // 16)) as k from n)""")
def stream_chunks(spark, d):
    """The chunks that a stream of each utterance pulls: 16 frames and 7 behind them, going on by 16."""
    return S.chunks(_spans(spark, d).groupBy("utt_id").agg(F.count("*").alias("n")), "utt_id", 16, 7)


@query(f"""with n as (select utt_id, count(*) as n, (row_number() over (order by utt_id) - 1) // 8 as batch from {_SPANS} group by utt_id),
k as (select batch, utt_id, n, unnest(generate_series(0, (n - 1) // 16)) as step from n)
select cast(batch as bigint) as batch, step, count(*) as streams, cast(sum(least(n - step * 16, 23)) as bigint) as frames from k group by batch, step""")
def stream_schedule(spark, d):
    """Steps of batches of 8 streams: each step pulls one chunk of every stream of the batch that is not done."""
    u = number_rows(_spans(spark, d).groupBy("utt_id").agg(F.count("*").alias("n")), "utt_id").withColumn("batch", F.floor((F.col("rn") - 1) / 8))
    c = S.chunks(u.select("utt_id", "n"), "utt_id", 16, 7).join(u.select("utt_id", "batch"), "utt_id")
    return c.groupBy("batch", F.col("chunk").alias("step")).agg(F.count("*").alias("streams"), F.sum("frames").alias("frames"))


# Normalizers


def _norm(name, f, sql=None, docs=False):
    def run(spark, d):
        s = table(spark, d, "documents").select("doc_id", "text") if docs else _once(spark, d).select("id", "text")
        return s.withColumn("text", f(F.col("text")))

    run.__name__ = name
    query(sql and (f"select doc_id, {sql} as text from documents" if docs else f"select id, {sql} as text from {_ONCE}"))(run)


def _gone(marks, signs, letters, first):
    x = first
    for m in marks:
        x = f"replace({x}, '{m}', '')"
    q = lambda s: s.replace("'", "''")
    return f"upper((translate({x}, '{q(''.join(letters) + signs)}', '{q(''.join(letters.values()))}')))"


_norm("text_phone", C.phone_words)
_norm("text_exam", C.exam_words)
_norm("text_han_meeting", lambda c: F.lower(C.han_meeting(c)), "lower(" + _gone(C.HAN_MARKS, C.HAN_SIGNS + "Ａ", C.HAN_LETTERS, "replace(trim(text, ' '), ' ', '')") + ")")
_norm("text_han_mixed", lambda c: F.lower(C.han_mixed(c)), "lower(" + _gone(C.HAN_MARKS, C.MIXED_SIGNS, C.MIXED_LETTERS, "trim(text, ' ')") + ")", docs=False)
_norm("text_from_buckwalter", C.from_buckwalter, "translate(text, '" + C.BUCKWALTER.replace("'", "''") + "', '" + C.ARABIC + "')")
_norm("text_buckwalter_back", lambda c: C.to_buckwalter(C.from_buckwalter(F.translate(c, C.ARABIC, "?" * len(C.ARABIC)))), "translate(text, '" + C.ARABIC + "', '" + "?" * len(C.ARABIC) + "')")
_norm("text_arabic_chain", C.arabic_chain)
