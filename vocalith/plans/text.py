"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocalith.functions import sequences as S
from vocalith.functions import text as T
from vocalith.operators.ordering import number_rows
from vocalith.plans.registry import Registry
from vocalith.session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_R = "regexp_replace"
_ONCE = "(select id, min(text) as text, min(lang) as lang from supervisions where id is not null group by id)"


def _once(spark, d):
    return table(spark, d, "supervisions").where("id is not null").groupBy("id").agg(F.min("text").alias("text"), F.min("lang").alias("lang"))


def _norm(name, column, sql, docs=False):
    """A query that normalizes every text of a table."""

    def run(spark, d):
        if docs:
            return table(spark, d, "documents").select("doc_id", column(F.col("text"), F.col("lang")).alias("text"))
        return _once(spark, d).select("id", column(F.col("text"), F.col("lang")).alias("text"))

    run.__name__ = name
    query(sql and (f"select doc_id, {sql} as text from documents" if docs else f"select id, {sql} as text from {_ONCE}"))(run)


# Letters whose capitals the two engines write differently are spelled out first, on both sides.
_SPELLED = (("ß", "ss"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ŉ", "n"))
_CASED = "text"
for _a, _b in _SPELLED:
    _CASED = f"replace({_CASED}, '{_a}', '{_b}')"


def _cased(c):
    for a, b in _SPELLED:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _rr(x, *rules):
    for a, b in rules:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


_PUNCT = "[!\"#$%&()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]"
_SP = ("\\s{2,}", " ")
_norm("text_spelled_marks", lambda c, g: T.spelled_marks(c), _rr("text", ("<COMMA>|<PERIOD>|<QUESTIONMARK>|<EXCLAMATIONPOINT>", ""), _SP))
_norm("text_spelled_marks_keep_comma", lambda c, g: T.spelled_marks(c, comma=False), _rr("text", ("<PERIOD>|<QUESTIONMARK>|<EXCLAMATIONPOINT>", ""), _SP))
_X = f"replace({_rr('text', ('-+', ' '))}, '’', '''')"
_norm(
    "text_common_voice",
    lambda c, g: F.lower(T.common_voice(c, g)),
    f"replace(lower(case lang when 'en' then {_rr(_X, ('[^A-Za-z\\s]', ''))} when 'fr' then {_rr(_X, ('[^A-ZÀÂÆÇÉÈÊËÎÏÔŒÙÛÜ'' ]', ''))} when 'pl' then {_rr(_X, ('[^a-ząćęłńóśźżA-ZĄĆĘŁŃÓŚŹŻ'' ]', ''))} else {_X} end), 'ß', 'ss')",
)
_norm("text_remove_punctuation", lambda c, g: T.remove_punctuation(c), f"trim({_rr(f'replace({_rr(f"replace(text, '<space>', chr(1))", (_PUNCT, ''))}, chr(1), {chr(39)}<space>{chr(39)})', _SP)}, ' ')")
_norm("text_german_native", lambda c, g: T.german_native(c), _rr("replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')", ("[^a-z\\s]", ""), ("\\s+", " ")))
_norm("text_alphabetic", lambda c, g: T.alphabetic(c), f"upper({_rr('text', ('[^A-Za-z ]', ''))})")
_norm("text_alphanumeric", lambda c, g: T.alphabetic(c, strict=False), "upper(regexp_replace(text, '[^A-Za-z0-9'' ]', '', 'g'))")
_norm("text_upper_words", lambda c, g: T.to_upper_words(c), "upper(trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9'']', ' ', 'g'), ' +', ' ', 'g'), ' '))")
_norm("text_strip_tags", lambda c, g: F.lower(T.strip_tags(c)), "lower(trim(regexp_replace(regexp_replace(text, '<.*?>|\\[[^\\]]*\\]|\\{[^}]*\\}|\\(\\(|\\)\\)', ' ', 'g'), '\\s+', ' ', 'g'), ' '))")
_norm("text_eastern_digits", lambda c, g: T.eastern_digits(c), "translate(text, '٠١٢٣٤٥٦٧٨٩٪_|ڤ', '0123456789%  ف')")
_norm("text_arabic_repeats", lambda c, g: T.arabic_repeats(c), _rr("text", ("(ه){2,}", "ههه"), ("(أ|ا|آ){2,}", "ا")))
_norm("text_char_pairs", lambda c, g: T.char_pairs(c), "trim(regexp_replace(text, '(.{2})', '\\1 ', 'g'), ' ')")
_WIDE = "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "　"
_norm("text_wide_to_ascii", lambda c, g: T.wide_to_ascii(c), "translate(text, '" + _WIDE + "', '" + "".join(chr(x) for x in range(0x21, 0x7F)).replace("'", "''") + " ')")
_CJK = "([\\x{1100}-\\x{11ff}\\x{2e80}-\\x{a4cf}\\x{a840}-\\x{d7af}\\x{f900}-\\x{faff}\\x{fe30}-\\x{fe4f}\\x{ff65}-\\x{ffdc}\\x{20000}-\\x{2ffff}])"
_norm("text_cjk_spaced", lambda c, g: T.cjk_spaced(_cased(c)), f"trim(regexp_replace(regexp_replace(upper({_CASED}), '{_CJK}', ' \\1 ', 'g'), ' +', ' ', 'g'), ' ')", docs=True)
_norm("text_white_and_marks", lambda c, g: T.white_and_marks(c), "translate(regexp_replace(text, '\\s+', ' ', 'g'), '，。！？；：、‘’“”⁇', ',.!?;:,''''\"\"?')", docs=True)
_norm("text_erhua", lambda c, g: T.remove_erhua(c), _rr("text", (f"({T.ER_WORDS})|儿", "\\1")), docs=True)
_norm("text_join_han", lambda c, g: T.join_han(c), None, docs=True)
_norm("text_arabic_clean", lambda c, g: T.arabic_clean(c), None)


def _spacing_sql(lang):
    """The rules in the other engine's way of writing groups."""
    sql = [(a.replace("'", "''"), b.replace("'", "''").replace("$", "\\")) for a, b in T.punctuation_rules(lang)]
    return _rr("text", *sql)


_norm("text_punctuation_spacing", lambda c, g: T.punctuation_spacing(c), _spacing_sql("en"))
_norm("text_punctuation_spacing_de", lambda c, g: T.punctuation_spacing(c, "de"), _spacing_sql("de"))
_norm("text_punctuation_spacing_cs", lambda c, g: T.punctuation_spacing(c, "cs"), _spacing_sql("cs"))
_WS = "regexp_replace(text, '[\\s\\x0b\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')"
_ALPHABET = "".join(T.BYTE_TO_CHAR[b] for b in range(256)).replace("'", "''")
_norm("text_byte_encode", lambda c, g: T.byte_encode(c), f"array_to_string(list_transform(generate_series(0, octet_length(encode({_WS})) - 1), lambda i: '{_ALPHABET}'[cast(('0x' || substr(hex(encode({_WS})), 2 * i + 1, 2)) as integer) + 1]), '')")
_norm("text_byte_best", lambda c, g: T.byte_decode_best(F.substring(T.byte_encode(c), 2, 1 << 30)), None)
_norm("text_separate_punctuation", lambda c, g: T.separate_punctuation(c), None)
_JA = "([\\x{3041}-\\x{309f}\\x{30a0}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}])"
_norm("text_ja_spaced", lambda c, g: T.ja_spaced(_cased(c)), f"trim(regexp_replace(regexp_replace(upper({_CASED}), '{_JA}', ' \\1 ', 'g'), ' +', ' ', 'g'), ' ')", docs=True)
_norm("text_unicode_basic", lambda c, g: T.unicode_basic(c), None)
_norm("text_english_basic", lambda c, g: T.english_basic(c), None)
_norm("text_sentence_case", lambda c, g: T.sentence_case(c), None)
_norm("text_zh_spoken", lambda c, g: T.zh_spoken(c), None, docs=True)
_norm("text_byte_roundtrip", lambda c, g: T.byte_decode(T.byte_encode(c)), _WS)
_norm(
    "text_language_dispatch",
    lambda c, g: F.when(g.startswith("en"), F.lower(T.to_upper_words(c))).otherwise(T.collapse(F.trim(c))),
    "case when starts_with(lang, 'en') then lower(upper(trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9'']', ' ', 'g'), ' +', ' ', 'g'), ' '))) else regexp_replace(trim(text, ' '), '\\s{2,}', ' ', 'g') end",
)


@query(f"select id, unnest(list_filter(string_split({_rr('text', ('[^a-z ]', ''))}, ' '), lambda x: x <> '')) as word from {_ONCE}")
def text_extract_words(spark, d):
    w = F.split(F.regexp_replace("text", "[^a-z ]", ""), " ")
    return _once(spark, d).select("id", F.explode(F.filter(w, lambda x: x != "")).alias("word"))


@query("select id, cast(split_part(c, ':', 1) as double) * 3600 + cast(split_part(c, ':', 2) as double) * 60 + cast(split_part(c, ':', 3) as double) as seconds from (select id, regexp_extract(text, '[0-9]{2}:[0-9]{2}:[0-9]{2}', 0) as c from supervisions) where c <> ''")
def clock_to_seconds(spark, d):
    s = table(spark, d, "supervisions").select("id", F.regexp_extract("text", "[0-9]{2}:[0-9]{2}:[0-9]{2}", 0).alias("c")).where("c <> ''")
    return s.select("id", T.clock_seconds(F.col("c")).alias("seconds"))


_SEQ = "(select utt_id, list(token order by start_frame, end_frame, token) as a from (select distinct utt_id, token, start_frame, end_frame from token_spans where utt_id is not null and token is not null and start_frame is not null and end_frame is not null) group by utt_id)"


def _spans(spark, d):
    t = table(spark, d, "token_spans").where("utt_id is not null and token is not null and start_frame is not null and end_frame is not null")
    return t.select("utt_id", "token", "start_frame", "end_frame").distinct()


def _seqs(spark, d):
    return S.token_arrays(_spans(spark, d))


def _lengths(spark, d):
    return _spans(spark, d).groupBy("utt_id").agg(F.count("*").cast("int").alias("n"))


@query(f"select utt_id, array_to_string(list_concat([1], a, [1]), ' ') as tokens from {_SEQ}")
def seq_add_sos_eos(spark, d):
    return _seqs(spark, d).select("utt_id", S.joined(S.add_eos(S.add_sos(F.col("a"), 1), 1)).alias("tokens"))


@query(f"select utt_id, array_to_string(list_filter(a, lambda x: x > 0), ' ') as tokens from {_SEQ}")
def seq_drop_blank(spark, d):
    return _seqs(spark, d).select("utt_id", S.joined(S.drop_up_to(F.col("a"), 0)).alias("tokens"))


@query(f"""with n as (select utt_id, len(a) as n from {_SEQ}), r as (select *, (row_number() over (order by n, utt_id) - 1) // 32 as batch from n),
w as (select *, greatest(max(n) over (partition by batch), 20) as longest from r) select utt_id, cast(batch as bigint) as batch, repeat('0', n) || repeat('1', longest - n) as mask from w""")
def seq_pad_mask(spark, d):
    """Masks of batches of 32 utterances in the order of their lengths, each as wide as its longest one and 20 at least."""
    t = number_rows(_lengths(spark, d), "n", "utt_id").select("utt_id", "n", F.floor((F.col("rn") - 1) / 32).alias("batch"))
    t = t.join(t.groupBy("batch").agg(F.greatest(F.max("n"), F.lit(20)).alias("longest")), "batch")
    mask = F.transform(S.pad_mask(F.col("n"), F.col("longest")), lambda x: x.cast("int").cast("string"))
    return t.select("utt_id", "batch", F.array_join(mask, "").alias("mask"))


@query(f"select utt_id, first, least(first + 2, n) as stop, 0 as seen_from, least(first + 2, n) as seen_to from (select utt_id, len(a) as n, unnest(generate_series(0, len(a) - 1, 2)) as first from {_SEQ})")
def seq_chunk_mask(spark, d):
    """The mask of each whole utterance as ranges, a row for each chunk of 2 positions; a square for each would grow with the square of its length."""
    return _lengths(spark, d).select("utt_id", F.inline(S.chunk_ranges(F.col("n"), 2)))


@query("select utt_id, start_frame, round(start_frame * 4 * 10 / 1000.0, 3) as seconds from token_spans where start_frame is not null")
def seq_frames_to_seconds(spark, d):
    return table(spark, d, "token_spans").where("start_frame is not null").select("utt_id", "start_frame", S.frame_seconds(F.col("start_frame"), 4, 10).alias("seconds"))


@query("""with t as (select distinct utt_id, token, start_frame, end_frame from token_spans where token is not null and token > 2 and start_frame is not null and end_frame > start_frame and utt_id is not null),
y as (select id, min(symbol) as symbol from symbols group by id),
o as (select t.*, symbol, starts_with(symbol, '▁') as b from t join y on y.id = token),
g as (select *, sum(case when b then 1 else 0 end) over (partition by utt_id order by start_frame, end_frame, token rows unbounded preceding) as w from o)
select utt_id, w as word_no, min(start_frame) as first, max(end_frame) as last, string_agg(replace(symbol, '▁', ''), '' order by start_frame, end_frame, token) as word from g where w > 0 group by utt_id, w""")
def seq_word_spans(spark, d):
    t = table(spark, d, "token_spans").where("utt_id is not null and token > 2 and start_frame is not null and end_frame > start_frame").select("utt_id", "token", "start_frame", "end_frame").distinct()
    y = table(spark, d, "symbols").groupBy(F.col("id").alias("token")).agg(F.min("symbol").alias("symbol"))
    return S.word_spans(t.join(y, "token"))
