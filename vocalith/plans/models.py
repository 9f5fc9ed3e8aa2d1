"""Queries over language models, evaluation and search."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from vocalith.operators import evaluation as E
from vocalith.operators import lm, search
from vocalith.operators.ordering import uniform
from vocalith.plans.registry import Registry
from vocalith.session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_ONCE = "(select id, min(text) as text from supervisions where id is not null and text is not null group by id)"


def _lines(spark, d):
    return table(spark, d, "supervisions").where("id is not null and text is not null").groupBy("id").agg(F.min("text").alias("text"))


_NG = f"""
with w as (select id, list_concat(['<s>'], list_filter(string_split(text, ' '), lambda x: x <> ''), ['</s>']) as w from {_ONCE}),
g as (select n, w, unnest(generate_series(0, len(w) - n)) as i from w, range(1, 4) t(n) where len(w) >= n),
c as (select n, array_to_string(w[i + 1:i + n - 1], ' ') as history, w[i + n] as word, case when i > 0 and n < 3 then w[i] end as lft from g),
k as materialized (select cast(n as integer) as n, history, word, count(*) as cnt, count(distinct lft) as ctx from c group by n, history, word)
"""
_DISC = """, dd as materialized (select n, case when n = 1 then 0.0::double else greatest(count_if(cnt = 1), 0.1) / (count_if(cnt = 1) + 2 * count_if(cnt = 2)) end as d from k group by n)
"""
_KN = """, u as (select *, case when n < 3 and (n = 1 or ctx > 0) then ctx else cnt end as x from k),
t as materialized (select n, history, sum(x) as total from u group by n, history),
f as materialized (select u.n, u.history, word, greatest(x - d, 0) / total as f, case when u.history = '' then word else u.history || ' ' || word end as gram,
  case when contains(u.history, ' ') then substr(u.history, instr(u.history, ' ') + 1) else '' end as suffix from u join dd using (n) join t on t.n = u.n and t.history = u.history),
s as materialized (select h.n, h.history, sum(h.f) as sf, sum(coalesce(l.f, 0)) as sg from f h left join f l on l.n = h.n - 1 and l.word = h.word and l.history = h.suffix where h.n > 1 group by h.n, h.history),
m as materialized (select f.n, f.history, f.word, f.f, f.gram, f.suffix, case when sg < 1 then (1 - sf) / (1 - sg) end as bow from f left join s on s.n = f.n + 1 and s.history = f.gram)
"""


@query(_NG + "select * from k")
def ngram_counts(spark, d):
    return lm.ngram_counts(_lines(spark, d), 3)


@query(_NG + _DISC + "select * from dd")
def ngram_discounts(spark, d):
    return lm.discounts(lm.ngram_counts(_lines(spark, d), 3))


@query(_NG + _DISC + _KN + "select n, history, word, round(f, 9) as f, round(bow, 7) as bow from m")
def ngram_kneser_ney(spark, d):
    m = lm.kneser_ney(lm.ngram_counts(_lines(spark, d), 3))
    return m.select("n", "history", "word", F.round("f", 9).alias("f"), F.round("bow", 7).alias("bow"))


_SCORED = """, w3 as (select id, w, unnest(generate_series(2, len(w))) as pos from w),
q as (select id, pos, w[pos] as word, w[pos - 1] as h1, case when pos > 2 then w[pos - 2] || ' ' || w[pos - 1] end as h2 from w3),
lp as (select id, case when c.f is not null then ln(c.f) when b.f is not null then ln(b.f) + coalesce(ln(y.bow), 0) else ln(a.f) + coalesce(ln(x.bow), 0) + coalesce(ln(y.bow), 0) end as logp
  from q left join m c on c.n = 3 and c.history = h2 and c.word = q.word left join m b on b.n = 2 and b.history = h1 and b.word = q.word left join m a on a.n = 1 and a.word = q.word
  left join m x on x.n = 1 and x.word = h1 left join m y on y.n = 2 and y.gram = h2)
"""


@query(_NG + _DISC + _KN + _SCORED + "select round(exp(-sum(logp) / count(*)), 6) as ppl, count(*) as n_tokens from lp")
def ngram_perplexity(spark, d):
    lines = _lines(spark, d)
    p = lm.perplexity(lm.token_log_probs(lines, lm.kneser_ney(lm.ngram_counts(lines, 3)), "id"))
    return p.select(F.round("ppl", 6).alias("ppl"), "n_tokens")


@query(_NG + _DISC + _KN + _SCORED + "select id, round(sum(logp), 6) as logp, count(*) as n_tokens from lp group by id")
def ngram_sentence_scores(spark, d):
    lines = _lines(spark, d)
    p = lm.token_log_probs(lines, lm.kneser_ney(lm.ngram_counts(lines, 3)), "id")
    return p.groupBy("id").agg(F.round(F.sum("logp"), 6).alias("logp"), F.count("*").alias("n_tokens"))


@query(_NG + _DISC + _KN + "select n, count(*) as histories, count_if(total > 1 + 1e-9) as above_one from (select n, history, sum(f) as total from m group by n, history) group by n")
def ngram_validity(spark, d):
    h = lm.history_sums(lm.kneser_ney(lm.ngram_counts(_lines(spark, d), 3)))
    return h.groupBy("n").agg(F.count("*").alias("histories"), F.count_if(F.col("total") > 1 + 1e-9).alias("above_one"))


@query(_NG + _DISC + _KN + """, eos as (select f as pe from m where n = 1 and word = '</s>'),
ph as (select m.gram, case when m.history = '<s>' then pe else p.f end * m.f as ph from m left join m p on p.n = 1 and p.word = m.history cross join eos where m.n = 2),
y3 as (select x.history, x.word, x.f, x.gram, l.f as g from m x left join m l on l.n = 2 and l.history = x.suffix and l.word = x.word where x.n = 3),
s3 as (select history, 1 - sum(f) as num, 1 - sum(coalesce(g, 0)) as den from y3 group by history),
z3 as (select y3.*, num, coalesce(o.bow, 1) as own, (num + y3.f) / (den + g) as nw, ph from y3 join s3 using (history) left join m o on o.n = 2 and o.gram = y3.history left join ph on ph.gram = y3.history),
d3 as (select gram from z3 where g > 0 and exp(-coalesce(ph, 1e-99) * (f * ln(g * nw / f) + num * ln(nw / own))) - 1 < 1e-7),
k3 as materialized (select history, word, f, suffix from m where n = 3 and gram not in (select gram from d3)),
y2 as (select x.history, x.word, x.f, x.gram, l.f as g from m x left join m l on l.n = 1 and l.word = x.word where x.n = 2),
s2 as (select history, 1 - sum(f) as num, 1 - sum(coalesce(g, 0)) as den from y2 group by history),
z2 as (select y2.*, num, coalesce(o.bow, 1) as own, (num + y2.f) / (den + g) as nw, greatest(o.f, 1e-99) as ph from y2 join s2 using (history) left join m o on o.n = 1 and o.word = y2.history),
d2 as (select gram from z2 where g > 0 and exp(-ph * (f * ln(g * nw / f) + num * ln(nw / own))) - 1 < 1e-7 and gram not in (select history from k3)),
k2 as materialized (select history, word, f, gram from m where n = 2 and gram not in (select gram from d2)),
b1 as materialized (select k2.history, (1 - sum(k2.f)) / (1 - sum(a.f)) as bow from k2 join m a on a.n = 1 and a.word = k2.word group by k2.history having sum(a.f) < 1),
b2 as materialized (select k3.history, sum(coalesce(b.f, a.f * coalesce(w.bow, 1))) as sg from k3 left join k2 b on b.history = k3.suffix and b.word = k3.word join m a on a.n = 1 and a.word = k3.word left join b1 w on w.history = k3.suffix group by k3.history)
select 1 as n, (select count(*) from m where n = 1) as kept, (select count(*) from b1) as with_bow
union all select 2, (select count(*) from k2), (select count(*) from b2 where sg < 1) union all select 3, (select count(*) from k3), 0""")
def ngram_pruned(spark, d):
    m = lm.prune(lm.kneser_ney(lm.ngram_counts(_lines(spark, d), 3)), 1e-7)
    return m.groupBy("n").agg(F.count("*").alias("kept"), F.count("bow").alias("with_bow"))


_HYP = f"""
with p as (select id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) as word, generate_subscripts(list_filter(string_split(text, ' '), lambda x: x <> ''), 1) - 1 as pos from {_ONCE} where text is not null)
"""


def _results(spark, d):
    """References and made-up hypotheses: some words left out, some doubled, some replaced, by hash."""
    w = _lines(spark, d).select("id", F.filter(F.split("text", " "), lambda x: x != "").alias("ref"))

    def one(x, i):
        u = uniform(F.concat("id", F.lit(":"), i.cast("string")), 4)
        return F.when(u < 0.05, F.array().cast("array<string>")).when(u < 0.1, F.array(x, x)).when(u < 0.15, F.array(F.lit("xx"))).otherwise(F.array(x))

    return w.withColumn("hyp", F.flatten(F.transform("ref", one)))


@query()
def wer_summary(spark, d):
    return E.error_rate(E.alignments(_results(spark, d)))


@query()
def wer_confusions(spark, d):
    return E.confusions(E.alignments(_results(spark, d)))


@query()
def wer_word_stats(spark, d):
    return E.word_stats(E.alignments(_results(spark, d)))


@query(f"""with t as (select regexp_replace(text, '[^a-z ]', '', 'g') as ref from {_ONCE}),
h as (select ref, replace(ref, 'th', 'd') as hyp from t)
select sum(length(ref)) as n_ref, sum(levenshtein(ref, hyp)) as errors, 100.0 * sum(levenshtein(ref, hyp)) / sum(length(ref)) as cer from h""")
def cer_summary(spark, d):
    t = _lines(spark, d).select(F.regexp_replace("text", "[^a-z ]", "").alias("ref"))
    return E.char_errors(t.withColumn("hyp", F.replace("ref", F.lit("th"), F.lit("d"))), "ref", "hyp")


@query("""with s as (select utt_id, start_frame / 100.0 as time_ref, end_frame / 100.0 as time_hyp, token from token_spans where token <> 0 and start_frame is not null and end_frame is not null)
select count(*) as n, round(avg(time_hyp - time_ref), 9) as mean, round(var_pop(time_hyp - time_ref), 9) as var from s""")
def word_delays(spark, d):
    t = table(spark, d, "token_spans").where("token <> 0 and start_frame is not null and end_frame is not null")
    t = t.select(F.col("token").alias("ref"), F.col("token").alias("hyp"), (F.col("start_frame") / 100).alias("time_ref"), (F.col("end_frame") / 100).alias("time_hyp"))
    return E.delays(t).select("n", F.round("mean", 9).alias("mean"), F.round("var", 9).alias("var"))


_KW = ("window", "hospital", "ladder", "thank you")


@query(f"""with h as (select k as keyword, contains(text, k) as in_ref, contains(replace(text, 'in', ''), k) as in_hyp from (select id, lower(text) as text from {_ONCE}), (select unnest({list(_KW)!r}) as k)),
a as (select * from h union all select 'all', in_ref, in_hyp from h),
c as (select keyword, count_if(in_ref and in_hyp) as tp, count_if(in_ref and not in_hyp) as fn, count_if(not in_ref and in_hyp) as fp, count_if(not in_ref and not in_hyp) as tn from a group by keyword),
m as (select *, coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0) as accuracy, coalesce(tp / nullif(tp + fp, 0), 0) as "precision", coalesce(tp / nullif(tp + fn, 0), 0) as recall, coalesce(fp / nullif(fp + tn, 0), 0) as fpr from c)
select *, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) as f1 from m""")
def keyword_metrics(spark, d):
    t = _lines(spark, d).select(F.lower("text").alias("text"), F.explode(F.array(*map(F.lit, _KW))).alias("keyword"))
    hyp = F.replace("text", F.lit("in"), F.lit(""))
    return E.keyword_metrics(t.select("keyword", F.col("text").contains(F.col("keyword")).alias("in_ref"), hyp.contains(F.col("keyword")).alias("in_hyp")))


@query("""with s as (select label as cls, round(embedding[1]::double, 2) as score, embedding[2] > 0 as hit from embeddings),
t as (select cls, score, sum(hit::int) as h, count(*) as n from s group by 1, 2),
w as (select *, sum(h) over o as ch, sum(n) over o as cn, sum(h) over (partition by cls) as total from t window o as (partition by cls order by score desc rows unbounded preceding))
select cls, round(sum(h / total * ch / cn), 9) as ap from w where total > 0 group by cls""")
def average_precision(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("cls"), F.round(F.get("embedding", 0).cast("double"), 2).alias("score"), (F.get("embedding", 1) > 0).alias("hit"))
    return E.average_precision(e).select("cls", F.round("ap", 9).alias("ap"))


@query("""with s as (select label as cls, round(embedding[1]::double, 2) as score, embedding[2] > 0 as hit from embeddings),
t as (select cls, score, sum(hit::int) as h, count(*) as n from s group by 1, 2),
w as (select *, sum(h) over o as ch, sum(n) over o as cn, sum(h) over (partition by cls) as total from t window o as (partition by cls order by score desc rows unbounded preceding)),
c as (select cls, sum(h / total * ch / cn) as ap from w where total > 0 group by cls) select count(*) as classes, round(avg(ap), 9) as mean_ap from c""")
def mean_average_precision(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("cls"), F.round(F.get("embedding", 0).cast("double"), 2).alias("score"), (F.get("embedding", 1) > 0).alias("hit"))
    return E.average_precision(e).agg(F.count("*").alias("classes"), F.round(F.avg("ap"), 9).alias("mean_ap"))


_NB = """with b as (select vec_id // 5 as utt, vec_id, round(embedding[1]::double, 4) as am, round(embedding[2]::double, 4) as lm, label from embeddings)"""


def _nbest(spark, d):
    e = table(spark, d, "embeddings")
    r = lambda i, n: F.round(F.get("embedding", i).cast("double"), 4).alias(n)
    return e.select(F.floor(F.col("vec_id") / 5).alias("utt"), "vec_id", r(0, "am"), r(1, "lm"), "label")


@query(_NB + """, s as (select utt, scale, vec_id, am / scale + lm as score from b, (values (0.5), (1.0), (2.0)) t(scale))
select utt, cast(scale as double) as scale, vec_id from (select *, row_number() over (partition by utt, scale order by score desc, vec_id) as rn from s) where rn = 1""")
def rescore_nbest(spark, d):
    s = _nbest(spark, d).select("utt", "vec_id", "am", "lm", F.explode(F.array(*map(F.lit, (0.5, 1.0, 2.0)))).alias("scale"))
    best = F.max_by("vec_id", F.struct(F.col("am") / F.col("scale") + F.col("lm"), -F.col("vec_id"))).alias("vec_id")
    return s.groupBy("utt", "scale").agg(best)


@query(_NB + "select utt, vec_id, am from (select *, row_number() over (partition by utt order by am desc, vec_id) as rn from b) where rn <= 2")
def beam_top_k(spark, d):
    from vocalith.operators.ordering import top_per_group

    return top_per_group(_nbest(spark, d), 2, ["utt"], F.desc("am"), F.col("vec_id")).select("utt", "vec_id", "am")


@query(_NB + "select utt, vec_id, round(am / (label + 1), 9) as norm from (select *, row_number() over (partition by utt order by am / (label + 1) desc, vec_id) as rn from b) where rn <= 2")
def beam_top_k_norm(spark, d):
    """As ``beam_top_k`` by the score for each token of a hypothesis."""
    from vocalith.operators.ordering import top_per_group

    norm = F.col("am") / (F.col("label") + 1)
    return top_per_group(_nbest(spark, d), 2, ["utt"], F.desc(norm), F.col("vec_id")).select("utt", "vec_id", F.round(norm, 9).alias("norm"))


@query(_NB + "select utt, vec_id from b where am > 0.1")
def beam_threshold(spark, d):
    return _nbest(spark, d).where("am > 0.1").select("utt", "vec_id")


@query(_NB + "select utt, round(ln(sum(exp(am))), 9) as total, count(*) as n from b group by utt, label % 2")
def merge_hypotheses(spark, d):
    return _nbest(spark, d).groupBy("utt", F.col("label") % 2).agg(F.round(F.log(F.sum(F.exp("am"))), 9).alias("total"), F.count("*").alias("n")).select("utt", "total", "n")


@query("""with h as (select doc_id // 5 as utt, doc_id, regexp_replace(text, '[^a-z ]', '', 'g') as h from documents where text is not null),
r as (select utt, arg_min(h, doc_id) as ref from h group by utt),
e as (select utt, doc_id, levenshtein(h, ref) as e from h join r using (utt) where h <> ref)
select utt, min(e) as errors from e group by utt""")
def nbest_oracle(spark, d):
    h = table(spark, d, "documents").where("text is not null").select(F.floor(F.col("doc_id") / 5).alias("utt"), "doc_id", F.regexp_replace("text", "[^a-z ]", "").alias("h"))
    r = h.groupBy("utt").agg(F.min_by("h", "doc_id").alias("ref"))
    e = E.with_distance(h.join(r, "utt").where("h <> ref"), "utt", "h", "ref")
    return e.groupBy("utt").agg(F.min("errors").alias("errors"))


@query("""with f as (select vec_id // 20 as utt, vec_id, list_position(embedding, list_max(embedding)) - 1 as t from embeddings),
b as (select *, lag(t) over (partition by utt order by vec_id) as before from f)
select utt, string_agg(cast(t as varchar), ' ' order by vec_id) as tokens from b where t <> 0 and before is distinct from t group by utt""")
def ctc_greedy(spark, d):
    e = table(spark, d, "embeddings").withColumn("utt", F.floor(F.col("vec_id") / 20))
    return search.greedy(e, "utt", "vec_id", "embedding")


@query()
def ctc_prefix_beam(spark, d):
    e = table(spark, d, "embeddings").withColumn("utt", F.floor(F.col("vec_id") / 20))
    return search.beam_search(e, "utt", "vec_id", "embedding")


_PHRASES = ("window", "the window", "low", "owl", "hospital")


def _boosts(spark, d, strict, scores=None):
    graph = search.PhraseGraph(list(_PHRASES), scores=scores)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"].astype(object), "boost": [round(graph.score(t, strict), 6) for t in pdf["text"]]})

    return _lines(spark, d).select("id", F.lower("text").alias("text")).mapInPandas(run, "id string, boost double")


@query("select id, cast(" + " + ".join(f"(length(t) - length(replace(t, '{p}', '')))" for p in _PHRASES) + f" as double) as boost from (select id, lower(text) as t from {_ONCE})")
def phrase_boost(spark, d):
    return _boosts(spark, d, True)


@query(f"""with recursive t as (select id, lower(text) as t from {_ONCE}),
r as (select id, t as rest, cast(0 as double) as boost from t
  union all select id, substr(rest, p + case when starts_with(substr(rest, p), 'the window') then 10 when starts_with(substr(rest, p), 'window') then 6 when starts_with(substr(rest, p), 'hospital') then 8 else 3 end),
    boost + case when starts_with(substr(rest, p), 'the window') then 10 when starts_with(substr(rest, p), 'window') then 6 when starts_with(substr(rest, p), 'hospital') then 8 else 3 end
  from (select *, length(rest) - length(regexp_replace(rest, '^.*?(the window|window|hospital|low|owl)', '\\1', 's')) + 1 as p, regexp_matches(rest, 'the window|window|hospital|low|owl') as hit from r) where hit)
select id, max(boost) as boost from r group by id""")
def phrase_boost_single(spark, d):
    """One phrase at a time: each match, the longest that ends there, starts the matching anew."""
    return _boosts(spark, d, False)


@query(f"""with w as (select id, unnest(string_split(lower(text), ' ')) as word, generate_subscripts(string_split(lower(text), ' '), 1) as pos from {_ONCE}),
c as (select word, count(*) as n from w group by word)
select id, string_agg(word, ' ' order by pos) as words from w join c using (word) where n <= 2 and word <> '' group by id""")
def rare_word_context(spark, d):
    w = _lines(spark, d).select("id", F.posexplode(F.split(F.lower("text"), " ")).alias("pos", "word")).where("word <> ''")
    rare = w.groupBy("word").agg(F.count("*").alias("n")).where("n <= 2").select("word")
    g = w.join(rare, "word", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("a"))
    return g.select("id", F.array_join("a.word", " ").alias("words"))
