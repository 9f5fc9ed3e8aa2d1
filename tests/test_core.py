import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalith.functions import sequences as S
from vocalith.functions import text as T
from vocalith.operators import evaluation as E
from vocalith.operators import lm, search
from vocalith.operators.intervals import merge_intervals
from vocalith.operators.manifests import boundary_windows, merge_neighbours, shard_by_duration
from vocalith.operators.ordering import number_rows, split_into
from vocalith.sources import manifests as M
from vocalith.streaming import decode


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


SEG = "r string, a double, b double, extra string"


def test_intervals(spark):
    rows = [("x", 0.0, 1.0, None), ("x", 1.0, 2.0, None), ("x", 1.2, 1.5, None), ("x", 3.0, 4.0, "k"), ("x", 3.0, 4.0, "k"), ("x", None, 4.0, None),
            ("x", 5.0, 5.0, None), ("x", 9.0, 8.0, None), (None, 0.0, 9.0, None), ("y", 0.0, 100.0, None), ("y", 50.0, 51.0, None), ("y", float("nan"), 1.0, None)]
    df = spark.createDataFrame(rows, SEG)
    want = {("x", "period", 0, 2000), ("x", "gap", 2000, 3000), ("x", "period", 3000, 4000), ("y", "period", 0, 100000)}
    for size in (600_000, 700, 40_000):  # slices of any size give the same
        assert {tuple(r) for r in merge_intervals(df, "r", "a", "b", size).collect()} == want
    assert merge_intervals(df.limit(0), "r", "a", "b").count() == 0


def test_intervals_clashing_names(spark):
    df = spark.createDataFrame([("x", 0.0, 1.0, "q", 1)], "r string, a double, b double, kind string, start_ms int")
    assert [tuple(r) for r in merge_intervals(df, "r", "a", "b").collect()] == [("x", "period", 0, 1000)]


def test_intervals_random(spark):
    r = np.random.default_rng(1)
    a = r.integers(0, 4000, 300)
    rows = [(f"k{i % 5}", float(x) / 10, float(x + d) / 10) for i, (x, d) in enumerate(zip(a, r.integers(1, 40, 300), strict=True))]
    want = set()
    for k in {x[0] for x in rows}:
        mine = sorted((round(s * 1000), round(e * 1000)) for q, s, e in rows if q == k)
        merged = [list(mine[0])]
        for s, e in mine[1:]:
            if s <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        want |= {(k, "period", s, e) for s, e in merged} | {(k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:], strict=False)}
    df = spark.createDataFrame(rows, "r string, a double, b double")
    assert {tuple(r) for r in merge_intervals(df, "r", "a", "b", 5000).collect()} == want


@pytest.mark.parametrize(("given", "want"), [("a,b'c!#", "ab'c"), ("  ab  ", "ab")])
def test_remove_punctuation(spark, given, want):
    assert one(spark, T.remove_punctuation, given) == want


MARKS = [
    ("a\r\nb\r\n", "a\nb\n"), ("(ab (c", " (ab (c"), ("a)b c)", "a) b c) "), ("  a  b     c  d    ", " a b c d "), *[(f"a)  {x}", f"a){x}") for x in ".!:?;,"],
    ("a(    b", "a (b"), ("ab    ) a", "ab) a"), ("1   %a", "1%a"), ("a  :", "a:"), ("a  ;", "a;"), ("`a`", "'a'"), ("''a''", '"a"'), ('„a"', '"a"'), ("“a„", '"a"'),
    ("“a”", '"a"'), ("a–b", "a-b"), ("a—b", "a - b"), ("a´b", "a'b"), ("a‘B", "a'B"), ("A’B", "A'B"), ("A’b", "A'b"), ("a‘b", "a'b"), ("a‚b", "a'b"), ("’", '"'),
    ("''", '"'), ("´´", '"'), ("…", "..."), ("a\xa0«\xa0b", 'a "b'), ("a «\xa0b", 'a "b'), ("a«b", 'a"b'), ("\xa0»\xa0", '" '), ("\xa0»", '"'), ("»", '"'),
    (" %", "%"), ("\xa0:", ":"), ("2 3", "2.3"), ("2\xa03", "2.3"), ("a\xa0?", "a\\?"), ("a\xa0!", "a\\!"), ("a ?", "a ?"), ("5\xa0cm", "5 cm"), ('he "said", so', 'he "said," so'),
]


def test_punctuation_spacing(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(MARKS)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", T.punctuation_spacing(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(MARKS))] == [b for _, b in MARKS]
    for lang, given, want in (("de", "2 3", "2,3"), ("fr", 'a," b." c', 'a", b". c'), ("cs", 'a," 2 3', 'a," 2,3')):
        assert one(spark, lambda c, g=lang: T.punctuation_spacing(c, g), given) == want


def test_text_goldens(spark):
    assert one(spark, T.german_native, "Ich heiße xxx好的01 fangjun") == "ich heisse xxx fangjun"
    assert one(spark, T.cjk_spaced, "你好世界是 hello world 的中文") == "你 好 世 界 是 HELLO WORLD 的 中 文"
    assert one(spark, T.ja_spaced, "こんにちは世界は hello world の日本語") == "こ ん に ち は 世 界 は HELLO WORLD の 日 本 語"
    assert one(spark, T.separate_punctuation, "This is fine. Yes, you are right.") == "This is fine . Yes , you are right ."
    assert one(spark, T.clock_seconds, "01:02:03.5") == 3723.5
    assert one(spark, T.zh_spoken, "2024年3月5日 12% 3/4") == "二零二四年三月五日 百分之十二 四分之三"
    assert one(spark, T.unicode_basic, None) is None
    assert [T.number_to_zh(n) for n in (0, 10, 105, 20010, 100000000)] == ["零", "十", "一百零五", "二万零一十", "一亿"]
    assert all(T.zh_to_number(T.number_to_zh(n)) == n for n in (0, 7, 10, 105, 1010, 20010, 100001, 123456789, 10**12 + 5))


def test_bytes(spark):
    # Fixed facts of the alphabet: printable ASCII stays, and letters that normalize to others are passed over.
    assert {b: ord(T.BYTE_TO_CHAR[b]) for b in (0, 31, 32, 126, 127, 144, 145, 146, 158, 255)} == {0: 256, 31: 287, 32: 32, 126: 126, 127: 288, 144: 305, 145: 308, 146: 309, 158: 323, 255: 422}
    assert len(set(T.BYTE_TO_CHAR.values())) == 256
    texts = ["hello  wörld", " 你好\n", "", "a\x00b", "🎧", "\x7f\x80", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", "t", T.byte_encode(F.col("t")).alias("x"), T.byte_decode(T.byte_encode(F.col("t"))).alias("y")).collect():
        assert r.x == (None if r.t is None else T.bytes_to_text(r.t)) and r.y == (None if r.t is None else " ".join(r.t.split(" ")).replace("  ", " ").replace("\n", " "))
    broken = T.bytes_to_text("a你b")
    bad = [broken[:2], broken[:3] + broken[4:], "字", "a\u2047b", T.BYTE_TO_CHAR[0xC0] + "x", ""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(bad)], "i int, t string").select("i", T.byte_decode(F.col("t")).alias("y"), T.byte_decode_best(F.col("t")).alias("z")).collect()
    assert [(r.y, r.z) for r in sorted(got)] == [("", "a"), ("", "ab"), ("", ""), ("a b", "a b"), ("", "x"), ("", "")]


def test_sequences(spark):
    a = lambda x: F.array(*map(F.lit, x)) if x else F.array().cast("array<int>")
    r = spark.range(1).select(
        S.add_sos(a([1, 2]), 100), S.add_eos(a([]), 30), S.pad_mask(F.lit(1), 3), S.pad_mask(F.lit(2), 3, left=True), S.chunk_mask(4, 2),
        S.drop_up_to(a([3, 0, 2, -1]), 0), S.collapse_labels(a([0, 1, 1, 1, 2, 0, 2, 2, 3])),
    ).first()
    assert r[0] == [100, 1, 2] and r[1] == [30] and r[2] == [False, True, True] and r[3] == [True, False, False]
    assert r[4] == [[True, True, False, False]] * 2 + [[True] * 4] * 2
    assert r[5] == [3, 2] and r[6] == [1, 2, 2, 3]
    assert S.reordered([1, 3, 9], [20, 30, 10], 4) == [(1, 0, 7), (0, 0, 5), (2, 2, 2)]


PHRASES = "S HE SHE SHELL HIS HERS HELLO THIS THEM".split()
QUERIES = "HEHERSHE HERSHE HISHE SHED SHELF HELL HELLO DHRHISQ THEN".split()


@pytest.mark.parametrize(
    ("each", "strict", "want"),
    [
        (0, True, [14, 12, 9, 6, 6, 2, 7, 4, 2]), (0, False, [7, 5, 5, 3, 3, 2, 2, 3, 2]),
        (5, True, [35.84, 30.84, 24.18, 18.34, 18.34, 5, 13, 10.84, 5]), (5, False, [20, 15, 10.84, 10, 10, 5, 5, 5.84, 5]),
    ],
)
def test_phrase_graph(each, strict, want):
    g = search.PhraseGraph(PHRASES, scores=[round(each / len(p), 2) for p in PHRASES])
    assert [round(g.score(q, strict), 2) for q in QUERIES] == want
    assert search.PhraseGraph([]).score("abc") == 0 and g.score("") == 0


def test_keywords():
    g = search.PhraseGraph([(1, 2), (1, 2, 3)], threshold=0.5, thresholds=[None, 0.9])
    find = lambda labels, probs, tail=1: [(p, a, b, round(m, 3)) for p, a, b, m in search.find_keywords(labels, probs, g, 0, tail)]
    assert find([0, 1, 1, 2, 0, 0], [0.9, 0.5, 0.7, 0.6, 0.9, 0.9]) == [((1, 2), 1, 3, 0.65)]
    assert find([1, 2, 0, 3], [0.9, 0.9, 0.9, 0.95]) == [((1, 2, 3), 0, 3, 0.917)]
    assert find([1, 2, 0, 3], [0.5, 0.5, 0.9, 0.5]) == [] and find([1, 2], [0.2, 0.2]) == [] and find([], []) == []


def test_prefix_beam_against_all_paths():
    r = np.random.default_rng(0)
    p = r.dirichlet(np.ones(3), 4)
    total: dict = {}
    for path in np.ndindex(3, 3, 3, 3):
        out, last = [], None
        for t in path:
            if t != last and t:
                out.append(t)
            last = t
        total[tuple(out)] = total.get(tuple(out), 0) + math.prod(p[i, t] for i, t in enumerate(path))
    got = search.prefix_beam(np.log(p), beam=200)
    assert {k: round(math.exp(v), 9) for k, v in got} == {k: round(v, 9) for k, v in total.items()}


def test_align():
    pairs = E.align("A EDISON B SIR".split(), "A ADDISON B".split())
    assert E.render(pairs) == "A (EDISON->ADDISON) B (SIR->*)"
    r = np.random.default_rng(2)
    for _ in range(50):
        a, b = list(r.integers(0, 4, r.integers(0, 8))), list(r.integers(0, 4, r.integers(0, 8)))
        pr = E.align(a, b)
        assert [x for x, _ in pr if not isinstance(x, str)] == a and [y for _, y in pr if not isinstance(y, str)] == b
    assert E.orc_errors([["a"], ["b", "c"]], [["b", "c"], ["a"]]) == 0 and E.permuted_errors([["a"], ["b"]], [["b"], ["a"]]) == 0


def test_error_rate_without_reference(spark):
    df = spark.createDataFrame([("u", [], ["x"])], "id string, ref array<string>, hyp array<string>")
    assert E.error_rate(E.alignments(df)).first()["wer"] is None
    assert E.error_rate(E.alignments(df.limit(0))).first()["n_ref"] == 0


def test_lm(spark):
    lines = spark.createDataFrame([("1", "a b a"), ("2", "a b"), ("3", "b c d"), ("4", None), ("5", "")], "id string, text string")
    counts = lm.ngram_counts(lines, 2)
    got = {(r.n, r.history, r.word): (r.cnt, r.ctx) for r in counts.collect()}
    assert got[(2, "a", "b")] == (2, 0) and got[(2, "<s>", "a")] == (2, 0) and got[(1, "", "</s>")] == (4, 4) and got[(1, "", "<s>")] == (4, 0)
    assert {r.n: r.d for r in lm.discounts(counts).collect()} == {1: 0.0, 2: pytest.approx(8 / 12)}
    m = lm.kneser_ney(counts)
    assert all(r.total <= 1 + 1e-9 for r in lm.history_sums(m).collect())
    model = {(r.history, r.word): r for r in m.collect()}
    d, uni = 8 / 12, {"a": 2, "b": 2, "c": 1, "d": 1, "</s>": 4}  # distinct left contexts
    assert model["", "<s>"].f == 0 and all(model["", w].f == pytest.approx(k / 10) for w, k in uni.items()) and model["a", "b"].f == pytest.approx((2 - d) / 3)
    # A sentence begins with a, b or its end; what is left goes to the others.
    seen = sum((n - d) / 4 for n in (2, 1, 1))
    assert model["", "<s>"].bow == pytest.approx((1 - seen) / (1 - 8 / 10))
    s = lm.token_log_probs(spark.createDataFrame([("x", "c z")], "id string, text string"), m, "id")
    got = {r.word: r.logp for r in s.collect()}
    assert got["c"] == pytest.approx(math.log(model["", "<s>"].bow / 10)) and got["z"] == -20
    assert lm.kneser_ney(counts.limit(0)).count() == 0


def brute_prune(model, limit):
    """Pruning on dictionaries (gram -> probability), weights computed anew wherever they are needed."""
    order = max(map(len, model))

    def weight(h):
        mine = [g for g in model if g[:-1] == h]
        low = sum(p(g[1:]) for g in mine)
        return (1 - sum(model[g] for g in mine)) / (1 - low) if mine and low < 1 else 1.0

    def p(g):
        return model[g] if g in model else weight(g[:-1]) * p(g[1:])

    for n in range(order, 1, -1):
        gone = set()
        for h in {g[:-1] for g in model if len(g) == n}:
            mine = [g for g in model if g[:-1] == h]
            num, den, old = 1 - sum(model[g] for g in mine), 1 - sum(p(g[1:]) for g in mine), weight(h)
            joint = math.prod(p(h[:k]) if h[:k] != ("<s>",) or len(h) == 1 else model[("</s>",)] for k in range(1, len(h) + 1))
            for g in mine:
                new = (num + model[g]) / (den + p(g[1:]))
                delta = -max(joint, 1e-99) * (model[g] * math.log(p(g[1:]) * new / model[g]) + num * math.log(new / old))
                if math.exp(delta) - 1 < limit and not any(x[:-1] == g for x in model):
                    gone.add(g)
        model = {g: v for g, v in model.items() if g not in gone}
    return model, weight


@pytest.mark.parametrize("limit", [1e-3, 1e-2, 0.2])
def test_prune_against_brute_force(spark, limit):
    r = np.random.default_rng(4)
    lines = spark.createDataFrame([(str(i), " ".join(r.choice(list("aabbcde"), r.integers(1, 7)))) for i in range(40)], "id string, text string")
    m = lm.kneser_ney(lm.ngram_counts(lines, 3))
    gram = lambda x: (*x.history.split(), x.word)
    want, weight = brute_prune({gram(x): x.f for x in m.collect()}, limit)
    got = {gram(x): (x.f, x.bow) for x in lm.prune(m, limit).collect()}
    assert set(got) == set(want) and 5 < len(want) < m.count()
    assert all(b == pytest.approx(weight(g)) for g, (_, b) in got.items() if b is not None)


def test_folds(spark):
    rows = [("r", "a", 0.0, 4.0), ("r", "b", 4.5, 4.0), ("r", "c", 9.0, 4.0), ("r", "d", 28.0, 5.0), ("r", "e", None, 1.0)]
    df = spark.createDataFrame(rows, "recording_id string, id string, start_sec double, duration double")
    got = {(r.first_id, r.end_sec, r.n) for r in merge_neighbours(df).collect()}
    assert got == {("a", 8.5, 2), ("c", 13.0, 1), ("d", 33.0, 1)}
    assert {r.id: r.window_no for r in boundary_windows(df).collect()} == {"a": 0, "b": 0, "c": 0, "d": 1}
    assert {r.id: r.shard for r in shard_by_duration(df, "recording_id", 8.0).collect()} == {"a": 0, "b": 0, "c": 1, "d": 2, "e": 2}
    assert merge_neighbours(df.limit(0)).count() == 0


def test_numbering(spark):
    df = spark.range(1000).withColumn("x", (F.col("id") * 7919) % 1000)
    assert all(r.rn == r.x + 1 for r in number_rows(df, "x").collect())
    sizes = sorted(r["count"] for r in split_into(df, 7, "x").groupBy("piece").count().collect())
    assert sizes == [142] + [143] * 6
    assert number_rows(df.limit(0), "x").count() == 0


def test_sources(spark, tmp_path):
    p = str(tmp_path)
    lex = spark.createDataFrame([(0, "ab", ["a", "b"]), (1, "c", ["c"])], "pos bigint, word string, tokens array<string>")
    M.write_lexicon(lex, f"{p}/lex")
    assert {(r.word, tuple(r.tokens), r.error) for r in M.read_lexicon(spark, f"{p}/lex").collect()} >= {("ab", ("a", "b"), None), ("c", ("c",), None)}
    (tmp_path / "x.tsv").write_text("a\tb\n\nc\n")
    assert {tuple(r) for r in M.read_tsv(spark, f"{p}/x.tsv", ["u", "v"]).collect()} == {("a", "b"), ("c", None)}
    (tmp_path / "s.jsonl").write_text('{"id": "r1", "duration": 1.5}\n\n')
    assert [tuple(r)[:2] for r in M.read_jsonl(spark, f"{p}/s.jsonl", M.RECORDINGS).collect()] == [("r1", 1.5)]
    assert M.read_parts(spark, f"{p}/*.jsonl", M.RECORDINGS).first()["part"] == "s"
    model = spark.createDataFrame([(1, "", "a", 0.5, 0.25), (2, "a", "b", 0.1, None)], "n int, history string, word string, f double, bow double")
    M.write_arpa(model, f"{p}/arpa")
    got = {(r.n, r.history, r.word): (round(r.f, 6), r.bow and round(r.bow, 6)) for r in M.read_arpa(spark, f"{p}/arpa").collect()}
    assert got == {(1, "", "a"): (0.5, 0.25), (2, "a", "b"): (0.1, None)}
    res = spark.createDataFrame([("u", ["it's", "b"], [])], "id string, ref array<string>, hyp array<string>")
    back = M.parse_transcripts(M.transcript_lines(res)).first()
    assert back.ref == ["it's", "b"] and back.hyp == []
    for name, body in (("wav.scp", "r a.wav\n"), ("segments", "u r 0.5 2.0\n"), ("text", "u hello you\n"), ("utt2spk", "u s\n")):
        (tmp_path / name).write_text(body)
    rec, sup = M.read_kaldi_dir(spark, p)
    assert rec.first()["source"] == "a.wav" and sup.first()["duration"] == 1.5 and sup.first()["text"] == "hello you"


def _runs(labels, k=0):
    cut = [i for i in range(len(labels)) if i == 0 or labels[i] != labels[i - 1]] + [len(labels)]
    return {(k + a, k + b, labels[a], b == len(labels)) for a, b in itertools.pairwise(cut)}


def test_join_frames_in_any_order():
    r = np.random.default_rng(5)
    for _ in range(200):
        labels = [r.integers(0, 3, n).tolist() for n in r.integers(1, 40, 3)]
        frames = [(k * decode.PLACES + i, t, i == len(x) - 1) for k, x in enumerate(labels) for i, t in enumerate(x)]
        frames = [frames[i] for i in r.permutation(len(frames))]
        spans, runs, out = (decode.NONE, decode.NONE, decode.NONE.astype(bool)), (decode.NONE,) * 3, []
        while frames:
            new, frames = frames[:7], frames[7:]  # two of them twice
            spans, runs, closed = decode.join_frames(spans, runs, tuple(np.array(x) for x in zip(*new, *new[:2], strict=True)))
            assert len(runs[0]) <= 2 * len(spans[0])  # however many frames came early
            out += zip(*(x.tolist() for x in closed), strict=True)
        assert not len(spans[0]) and sorted(out) == sorted(set().union(*(_runs(x, k * decode.PLACES) for k, x in enumerate(labels))))


def test_stream_runs_in_disorder(spark, tmp_path):
    """A run comes as soon as it is closed on both sides, whatever is missing before it; a frame that comes twice counts once."""
    r = np.random.default_rng(6)
    labels = {"long": r.integers(0, 4, 200).tolist(), "b": [1, 1, 0, 2], "c": [3]}
    rows = [(u, i, t, i == len(x) - 1) for u, x in labels.items() for i, t in enumerate(x)]
    schema = "utt_id string, frame int, token int, is_last boolean"
    chunks = [rows[150:], rows[60:110], rows[100:150], rows[:60]]

    def streamed():
        q = decode.stream_runs(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), groups=2).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        q.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(x) for x in spark.read.schema(decode.OUT).parquet(f"{tmp_path}/out").collect())

    want = sorted((u, *x) for u, y in labels.items() for x in _runs(y) if x[2])
    for chunk, (a, b) in zip(chunks, ((150, 200), (60, 110), (60, 200), (-1, 200)), strict=True):
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = streamed()
        assert {x for x in want if x[0] == "long" and a < x[1] and (x[2] < b or x[4])} <= {*got} <= {*want}
    assert got == want
