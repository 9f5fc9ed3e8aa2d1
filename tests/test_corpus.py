"""Normalizers with goldens, and operators on slices against brute force."""

from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalith.functions import conversation as C
from vocalith.functions import sequences as S
from vocalith.operators import cuts as K
from vocalith.operators import evaluation as E
from vocalith.operators import lexicon as L
from vocalith.operators import manifests as M
from vocalith.operators import search


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("[laughterr] [SILENCE]", "[LAUGHTER]"), ("[laugh] oh this is great [silence] <B_ASIDE> yes", "[LAUGHTER] OH THIS IS GREAT YES"), ("i don't kn- - know A.B.C's", "I DON'T KN KNOW A B C'S"),
        ("so x. corp is good?", "SO X CORP IS GOOD"), ("'absolutely' yes 'aight", "ABSOLUTELY YES 'AIGHT"), ("ABSOLUTE[LY]-", "ABSOLUTE"), ("[AN]Y-", "Y"), ("-[ADV]AN[TAGE]-", "AN"),
        ("[WEA[SONABLE]-/REASONABLE]", "REASONABLE"), ("[VOCALIZED-NOISE]-", "[VOCALIZED-NOISE]"), ("~BULL", "BULL"), ("okay_1 um", "OKAY UM"), ("", ""),
    ],
)
def test_phone_line(given, want):
    assert C.phone_line(given) == want


def test_exam_line():
    assert C.exam_line("<contraction e_form=\"[we=>we]['re=>are]\">we're {breath} un- home. %uh") == "WE'RE UN HOME UH"
    assert C.exam_line("[[drawn out]] yes <foreign> -[a]nd (( )) [uh] ju[st]") == "YES AND UH JUST" and C.exam_line("") == ""


def test_acronyms():
    table = {"I": "i.", "B": "b.", "M": "m.", "NASA": "n._a._s._a."}
    assert C.map_acronyms("u1 I work at I B M for NASA i", table) == "u1 i work at i. b. m. for n._a._s._a. i" and C.map_acronyms("u1", table) == "u1 "
    letters = {"I": "ay", "B": "b iy", "M": "eh m"}
    assert C.acronym_entries("IBM", "ay b iy eh m", letters) == ("i._b._m.", "i b m", "")
    assert C.acronym_entries("IBM's", "ay b iy eh m z", letters) == ("i._b._m.'s", "i b m's", "'s") and C.acronym_entries("IBMs", "ay b iy eh m z", letters)[0] == "i._b._m.s"
    assert C.acronym_entries("cat", "k ae t", letters) is None and C.acronym_entries("x9", "eh k s", letters) is None


def test_arabic(spark):
    assert [hex(ord(c)) for c in C.ARABIC[:3] + C.ARABIC[20:25] + C.ARABIC[-2:]] == ["0x622", "0x624", "0x626", "0x64c", "0x64e", "0x650", "0x652", "0x670", "0x651", "0x671"] and len(C.ARABIC) == len(C.BUCKWALTER)
    one = lambda f, t: spark.createDataFrame([(t,)], "t string").select(f(F.col("t"))).first()[0]
    assert one(C.from_buckwalter, "ktAb") == "كتاب" and one(C.to_buckwalter, "كتاب") == "ktAb"
    assert one(C.arabic_chain, "هههههه  (من) 10الى٢٠ OKنعم أ x") == "ههه من 10 الى 20 ok نعم"
    assert one(C.arabic_chain, None) is None and one(C.arabic_chain, "") == ""
    assert one(C.han_meeting, " 你 好，ａb <sil>Ａ。") == "你好AB" and one(C.han_mixed, "你 好，Ａb'") == "你 好AB"


def full_align(ref, hyp):
    cost = [list(range(len(hyp) + 1))]
    for i, x in enumerate(ref, 1):
        row = [i]
        for j, y in enumerate(hyp, 1):
            row.append(min(cost[-1][j - 1] + (x != y), cost[-1][j] + 1, row[-1] + 1))
        cost.append(row)
    out, i, j = [], len(ref), len(hyp)
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            out.append((ref[i], hyp[j]))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append((ref[i], E.EPS))
        else:
            j -= 1
            out.append((E.EPS, hyp[j]))
    return out[::-1]


def test_banded_alignment_is_the_full_one():
    r = np.random.default_rng(3)
    for n, m, k in [(0, 0, 2), (0, 5, 2), (40, 40, 3), (60, 20, 2), (5, 70, 4), (120, 118, 30), (33, 60, 2), (90, 90, 2)]:
        for _ in range(4):
            a, b = r.integers(0, k, n).tolist(), r.integers(0, k, m).tolist()
            assert E.align(a, b) == full_align(a, b)
    a = r.integers(0, 50, 300).tolist()
    b = [x for i, x in enumerate(a) if i % 17] + [7]
    assert E.align(a, b) == full_align(a, b)


def test_speakers_on_channels():
    errors = lambda x, y: sum(a != b for a, b in E.align(x, y))
    r = np.random.default_rng(4)
    for _ in range(12):
        refs = [list(r.choice(list("abc"), r.integers(0, 4))) for _ in range(4)]
        channels = [list(r.choice(list("abc"), r.integers(0, 6))) for _ in range(2)]
        want = min(sum(errors([w for x, c in zip(refs, to, strict=True) if c == k for w in x], channels[k]) for k in range(2)) for to in product(range(2), repeat=4))
        assert E.orc_errors(refs, channels) == want
        three = [refs[0], refs[1]]
        assert E.permuted_errors(three, channels) == min(sum(errors(x, c) for x, c in zip(p, channels, strict=True)) for p in permutations(three))
    assert E.orc_errors([], [["a"], []]) == 1


def test_frames_in_slices(spark):
    r = np.random.default_rng(5)
    data = sorted({(u, int(f), int(t)) for u in "ab" for f, t in zip(r.integers(-50, 3000, 400), r.integers(0, 3, 400), strict=True)})
    df = spark.createDataFrame(data, "utt_id string, start_frame int, token int")
    want, text = set(), {}
    for u in "ab":
        t = [x[2] for x in data if x[0] == u]
        at = 0
        while at < len(t):
            end = at
            while end < len(t) and t[end] == t[at]:
                end += 1
            if t[at]:
                want.add((u, t[at], at, end))
                text.setdefault(u, []).append(str(t[at]))
            at = end
    for size in (7, 300, 20_000):
        assert {tuple(x) for x in L.token_runs(df, size).collect()} == want
        assert {x.utt_id: x.tokens for x in L.collapse(df, size).collect()} == {u: " ".join(x) for u, x in text.items()}
    assert L.token_runs(df.limit(0)).count() == 0


def test_pauses_and_overlaps_in_slices(spark):
    r = np.random.default_rng(6)
    data = [(f"r{i % 2}", f"s{i:03}", float(a) / 4, float(d) / 4) for i, (a, d) in enumerate(zip(r.integers(0, 2000, 240), r.integers(1, 30, 240), strict=True))]
    df = spark.createDataFrame([*data, data[0], ("r0", "n", None, 1.0), (None, "m", 1.0, 1.0)], "recording_id string, id string, start_sec double, duration double")
    want = []
    for k in ("r0", "r1"):
        group, reach = 0, None
        for s, e, i in sorted((s, s + d, i) for q, i, s, d in data if q == k):
            group += reach is None or s - reach > 0.5
            reach = e if reach is None else max(e, reach)
            want.append((k, i, s, e, group))
    for size in (3.0, 77.0, 600.0):
        assert rows(M.with_pauses(df, 0.5, size)) == sorted(want, key=str)
    a = df.where("duration is not null and recording_id is not null and start_sec is not null").select("recording_id", F.col("id").alias("x"), F.col("start_sec").alias("a0"), (F.col("start_sec") + F.col("duration")).alias("a1")).distinct()
    b = a.select("recording_id", F.col("x").alias("y"), F.col("a0").alias("b0"), F.col("a1").alias("b1"))
    pairs = {(i, j) for q, i, s, d in data for p, j, t, e in data if p == q and s < t + e and t < s + d}
    for size in (1.0, 30.0):
        got = M.overlapping(a, b, "recording_id", size).select("x", "y").collect()
        assert len(got) == len(pairs) and {tuple(x) for x in got} == pairs


def test_boundary_windows_against_rescanning(spark):
    def naive(rows, length=30.0):
        at, no, out, rest = 0.0, 0, {}, list(rows)
        while rest:
            edge = at + length
            keep = [x for x in rest if x[2] <= edge or (x[1] < edge and edge - x[1] > 0.5 * (x[2] - x[1]))]
            late = [x for x in rest if x not in keep]
            if not keep and min(x[1] for x in late) < edge:
                keep = [x for x in late if x[1] == min(y[1] for y in late)]
                late = [x for x in late if x not in keep]
            out |= {x[0]: no for x in keep}
            no += bool(keep)
            rest = late
            if rest:
                first = min(x[1] for x in rest)
                at = first if first < edge else max(edge, first - first % length)
        return out

    r = np.random.default_rng(7)
    data = [(f"s{i:03}", float(a) / 2, float(a + d) / 2) for i, (a, d) in enumerate(zip(np.sort(r.integers(0, 900, 60)), r.choice([3, 9, 40, 90], 60), strict=True))]
    df = spark.createDataFrame([("r", i, s, e - s) for i, s, e in data], "recording_id string, id string, start_sec double, duration double")
    assert {x.id: x.window_no for x in M.boundary_windows(df).collect()} == naive(data)


def test_batches_and_fields(spark):
    df = spark.createDataFrame([(f"u{i:02}", n) for i, n in enumerate([90, 60, 55, 20, 20, 10, 5, 5, 1, 0])], "id string, length int")
    got = {x.id: x.batch for x in K.sentence_batches(df, 50, 4).collect()}
    # 90 tokens: 4 // 2 + 1 = 3 texts; 20 tokens: min(4 // 1 + 1, 4) = 4 texts.
    assert [got[f"u{i:02}"] for i in range(10)] == [0, 0, 0, 1, 1, 1, 1, 2, 2, 2] and K.sentence_batches(df.limit(0), 50, 4).count() == 0
    s = spark.createDataFrame([(("x", ("y",)),), (("x", (None,)),), (None,)], "s struct<a:string,b:struct<c:string>>")
    assert [r.v for r in s.select(K.get_nested(K.set_nested(F.col("s"), ("b", "c"), F.upper), ("b", "c")).alias("v")).collect()] == ["Y", None, None]
    lines = K.biasing_lines(spark.createDataFrame([("u", ["it's", 'a"b'])], "id string, words array<string>"))
    assert [tuple(r) for r in K.read_biasing(lines.unionByName(spark.createDataFrame([("v\t[broken",)], "value string"))).collect()] == [("u", ["it's", 'a"b']), ("v", None)]
    m = spark.range(1).select(S.one_hot_mask(F.array(F.lit(1), F.lit(0)), 3, -10.0).alias("m")).first().m
    assert m == [[-10, 0, -10], [0, -10, -10]]


def test_keyword_hits(spark):
    hot = lambda k: [5.0 if i == k else 0.0 for i in range(4)]
    df = spark.createDataFrame([("u", i, hot(k)) for i, k in enumerate([0, 1, 1, 2, 0, 0, 0, 3])] + [("v", 0, None)], "utt string, i int, s array<double>")
    got = search.keyword_hits(df, "utt", "i", "s", [(1, 2), (3, 3)]).collect()
    assert [(r.utt, r.phrase, r.first, r.last) for r in got] == [("u", "1 2", 1, 3)] and search.keyword_hits(df.limit(0), "utt", "i", "s", [(1,)]).count() == 0


def test_repeated_frames(spark):
    t = [("a", 3, 1), ("a", 3, 1), ("a", 3, 2), ("a", 90_000, 2), ("b", 0, 0), ("a", 90_000, 2)]
    df = spark.createDataFrame(t, "utt_id string, start_frame int, token int")
    want = {tuple(x) for x in L.numbered_frames(df.distinct(), 10).collect()}
    got = [tuple(x) for x in L.numbered_frames(df.repartition(3), 10, repeated=True).collect()]
    assert len(got) == len(want) == 4 and {*got} == want
