"""Queries against whole results: nothing is left out by a join, a length or a limit."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from vocalith.functions import sequences as S
from vocalith.operators import evaluation as E


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def spans(spark, tmp_path):
    """A long utterance without supervision beside short ones, over several slices of frames."""
    r = np.random.default_rng(3)
    t = [(u, int(k), int(f), int(f + e)) for u, n in (("long", 400), ("a", 30), ("b", 3)) for k, f, e in zip(r.integers(0, 6, n), r.integers(0, 90_000, n), r.integers(0, 9, n), strict=True)]
    t += [*t[:5], ("a", None, 3, 4), ("b", 3, None, 4), (None, 3, 1, 4)]
    spark.createDataFrame(t, "utt_id string, token int, start_frame int, end_frame int").write.parquet(f"{tmp_path}/token_spans.parquet")
    spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string").write.parquet(f"{tmp_path}/supervisions.parquet")
    spark.createDataFrame([("<b>", 0), ("<s>", 1), ("<u>", 2), ("▁a", 3), ("b", 4), ("▁c", 5)], "symbol string, id int").write.parquet(f"{tmp_path}/symbols.parquet")
    return str(tmp_path), sorted({x for x in t if None not in x}, key=lambda x: (x[0], x[2], x[3], x[1]))


def tokens(spans, u):
    return [x[1] for x in spans if x[0] == u]


def test_sequences_without_supervision(spark, spans):
    d, t = spans
    q = __spark_entry__.queries()
    for name, f in (("seq_add_sos_eos", lambda a: [1, *a, 1]), ("seq_drop_blank", lambda a: [x for x in a if x > 0])):
        assert dict(rows(q[name](spark, d))) == {u: " ".join(map(str, f(tokens(t, u)))) for u in ("long", "a", "b")}


def test_word_spans_without_supervision(spark, spans):
    d, t = spans
    want, symbol = {}, {3: "▁a", 4: "b", 5: "▁c"}
    for u in ("long", "a", "b"):
        no = 0
        for _, k, s, e in (x for x in t if x[0] == u and x[1] > 2 and x[3] > x[2]):
            no += symbol[k].startswith("▁")
            if no:
                w = want.setdefault((u, no), [s, e, ""])
                want[u, no] = [w[0], max(w[1], e), w[2] + symbol[k].strip("▁")]
    got = {tuple(r)[:2]: list(r)[2:] for r in __spark_entry__.queries()["seq_word_spans"](spark, d).collect()}
    assert got == want and max(no for u, no in want if u == "long") > 50
    df = spark.createDataFrame([(u, k, s, e, symbol[k]) for u, k, s, e in t if k > 2], "utt_id string, token int, start_frame int, end_frame int, symbol string")
    assert rows(S.word_spans(df, 700)) == rows(S.word_spans(df, 10**8))


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def random_text(r, n, letters="ath d"):
    return "".join(r.choice(list(letters), n)) if n else ""


def test_cer_of_long_texts(spark, tmp_path):
    r = np.random.default_rng(5)
    texts = [random_text(r, n) for n in (0, 20, 399, 400, 1500)]
    spark.createDataFrame([(f"u{i}", t) for i, t in enumerate([*texts, None])], "id string, text string").write.parquet(f"{tmp_path}/supervisions.parquet")
    got = __spark_entry__.queries()["cer_summary"](spark, str(tmp_path)).first()
    n, e = sum(map(len, texts)), sum(brute_distance(t, t.replace("th", "d")) for t in texts)
    assert (got.n_ref, got.errors) == (n, e) and got.cer == pytest.approx(100 * e / n)


def test_distance():
    r = np.random.default_rng(6)
    for n, m in ((0, 0), (0, 3), (1, 1), (5, 9), (63, 64), (65, 64), (200, 130)):
        for letters in ("ab", "abcdefgh ", "añ😀"):
            a, b = random_text(r, n, letters), random_text(r, m, letters)
            assert E.distance(a, b) == E.distance(b, a) == brute_distance(a, b)


def test_nbest_oracle_of_whole_texts(spark, tmp_path):
    r = np.random.default_rng(7)
    same = random_text(r, 80)  # two texts that part behind 80 characters
    texts = [same + " ab", same + " dd tt", random_text(r, 300), None, random_text(r, 90), random_text(r, 150), random_text(r, 10), same, same]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for u in (0, 1):
        mine = [t for t in texts[u * 5 : u * 5 + 5] if t is not None]
        want.append((u, min(brute_distance(t, mine[0]) for t in mine if t != mine[0])))
    assert rows(__spark_entry__.queries()["nbest_oracle"](spark, str(tmp_path))) == want


def test_whole_orders(spark, tmp_path):
    r = np.random.default_rng(8)
    sup = [(f"u{i}", "x" * int(r.integers(0, 40)), float(i), None, None, None) for i in range(700)]
    spark.createDataFrame([*sup, *sup[:9], ("n", None, 1.0, None, None, None)], "id string, text string, duration double, corpus string, lang string, subset string").write.parquet(f"{tmp_path}/supervisions.parquet")
    spark.range(300).select("id").withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    q = __spark_entry__.queries()
    got = sorted(q["sort_by_length"](spark, str(tmp_path)).collect(), key=lambda x: x.position)
    assert [tuple(x) for x in got] == [(u[0], u[2], i) for i, u in enumerate(sorted(sup, key=lambda u: (-len(u[1]), u[0])), 1)]
    got = sorted(q["shuffle_head"](spark, str(tmp_path)).collect(), key=lambda x: x.position)
    assert [tuple(x) for x in got] == [(k, i) for i, k in enumerate(sorted(range(300), key=lambda k: (hashlib.md5(f"{k}#3".encode()).hexdigest(), k)), 1)]


def test_masks_of_whole_sequences(spark, spans, tmp_path):
    d, t = spans
    q = __spark_entry__.queries()
    n = {u: len(tokens(t, u)) for u in ("long", "a", "b")}
    assert max(n.values()) > 300 and min(n.values()) < 20
    want = {u: "0" * k + "1" * (max(n.values()) - k) for u, k in n.items()}
    assert {r.utt_id: r.mask for r in q["seq_pad_mask"](spark, d).collect()} == want  # three utterances are one batch
    got: dict = {}
    for r in q["seq_chunk_mask"](spark, d).collect():
        for i in range(r.first, r.stop):
            assert (r.utt_id, i) not in got
            got[r.utt_id, i] = (r.seen_from, r.seen_to)
    assert got == {(u, i): (0, min((i // 2 + 1) * 2, k)) for u, k in n.items() for i in range(k)}


def test_pad_mask_batches(spark, tmp_path):
    spark.createDataFrame([(f"u{k:03}", 1, i, i + 1) for k in range(1, 71) for i in range(k)], "utt_id string, token int, start_frame int, end_frame int").write.parquet(f"{tmp_path}/token_spans.parquet")
    got = {r.utt_id: (r.batch, r.mask) for r in __spark_entry__.queries()["seq_pad_mask"](spark, str(tmp_path)).collect()}
    wide = (32, 64, 70)
    assert got == {f"u{k:03}": ((k - 1) // 32, "0" * k + "1" * (wide[(k - 1) // 32] - k)) for k in range(1, 71)}


@pytest.mark.parametrize("left", [-1, 0, 1, 2])
def test_chunk_ranges_as_mask(spark, left):
    for size, chunk in ((1, 2), (4, 2), (7, 3), (6, 4)):
        x = spark.range(1).select(S.chunk_ranges(F.lit(size), chunk, left).alias("r"), S.chunk_mask(size, chunk, left).alias("m")).first()
        assert [[r.seen_from <= j < r.seen_to for j in range(size)] for r in x.r for _ in range(r.first, r.stop)] == x.m


def test_seconds_of_late_frames(spark, tmp_path):
    t = [("a", 1, 25, 26), ("a", 1, 53_687_092, 53_687_093), ("a", 1, 2**31 - 2, 2**31 - 1), ("b", 1, None, 4)]
    spark.createDataFrame(t, "utt_id string, token int, start_frame int, end_frame int").write.parquet(f"{tmp_path}/token_spans.parquet")
    got = __spark_entry__.queries()["seq_frames_to_seconds"](spark, str(tmp_path))
    assert {tuple(x) for x in got.collect()} == {("a", 25, 1.0), ("a", 53_687_092, 2147483.68), ("a", 2**31 - 2, 85899345.84)} and dict(got.dtypes)["seconds"] == "double"
