import base64
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalith.llm import forms, pii, tagger
from vocalith.llm.encode import decode_ids, encode_texts, load
from vocalith.llm.mixing import mix_sources
from vocalith.llm.overlap import allowed, block_sizes, cross_split_pairs, longest_partner, overlap_links, overlap_report, word_distance
from vocalith.llm.runs import collapse_runs
from vocalith.llm.splits import components, grouped_split, utterance_groups
from vocalith.llm.terms import marked_terms, suffix_counts, term_counts
from vocalith.llm.turns import speaker_turns
from vocalith.llm.unify import LookTrie, look_classes, same_look_pairs, unify_texts

SUP = "id string, text string, lang string, subset string, corpus string"


def sup(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, "c") for i, t, s in rows], SUP)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Speaker 1: hi\nSPEAKER_01: uh [noise]\nS2: yes\nspk1: so", [(1, 1), (2, 2), (3, 1)]),
        ("[00:10] A: late\n[00:05] Speaker B: early\n(00:20) B: more", [(1, 1), (2, 2), (3, 1)]),
        ("Ann Lee: hello\nA. Lee: um...\nBob Ray: yes\nAnn: no", [(1, 1), (2, 2), (3, 1)]),
        ("<v Agent>so: ready\nat 10:30\n<v Agt>fine", [(1, 1)]),
        ("Customer: um\nAgent: (coughs)", []),
        ("no labels [noise] at 10:30", []),
        (None, []),
        ("", []),
    ],
)
def test_turns(spark, text, want):
    df = sup(spark, [("x", text, "train"), ("x", text, "train")])
    assert sorted((r.turn_no, r.speaker_no) for r in speaker_turns(df).collect()) == want


def test_turn_words(spark):
    df = sup(spark, [("x", "1\n00:00:01,000 --> 00:00:02,000\n>> Guest: the um, cat [door slams] sat\nagain", "train")])
    r = speaker_turns(df).first()
    assert r.text == "the cat sat again" and r.start_sec == 1.0


def test_suffix_counts_against_brute_force():
    r = np.random.default_rng(0)
    docs = [list(r.integers(0, 4, r.integers(0, 12))) for _ in range(30)]
    tokens = np.array([t for d in docs for t in d], dtype=np.int64)
    record = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    for n, first, occ, rec in suffix_counts(tokens, record, 4):
        want: dict = {}
        for i, d in enumerate(docs):
            for k in range(len(d) - n + 1):
                want.setdefault(tuple(d[k : k + n]), []).append(i)
        got = {tuple(tokens[f : f + n]): (o, c) for f, o, c in zip(first, occ, rec, strict=True)}
        assert got == {k: (len(v), len(set(v))) for k, v in want.items()}


def test_terms(spark):
    df = sup(spark, [("a", "It's it's CAT", "x"), ("b", "cat é", "x"), ("c", "cat", "x"), ("d", None, "x"), ("e", "", "x"), ("b", "cat é", "x")])
    got = {r.term: (r.occurrences, r.records, r.mark) for r in marked_terms(df).collect()}
    assert got == {"it's": (2, 1, "rare"), "cat": (3, 3, "common"), "é": (1, 1, "rare")}
    small, whole = ({tuple(r) for r in term_counts(df, max_n=3, block=b).collect()} for b in (2, 100))
    assert small == whole
    assert marked_terms(df.limit(0)).count() == 0


def test_groups_and_splits(spark):
    rows = [("u1", "ab-001"), ("u2", "AB_1"), ("u2", "ab 2"), ("u3", "ab.00002"), ("u4", "unknown"), ("u5", None), ("u6", "cd7"), (None, "cd7"), ("u1", "ab-001"), ("u7", "n/a")]
    g = utterance_groups(spark.createDataFrame(rows, "utt_id string, spk_id string"))
    assert {tuple(r) for r in g.collect()} == {("u1", "u1"), ("u2", "u1"), ("u3", "u1"), ("u6", "u6")}
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)]
    up = {i: i for e in edges for i in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    df = spark.createDataFrame([e for e in edges if e[0] != e[1]], "a bigint, b bigint")
    assert {tuple(x) for x in components(df).collect()} == {(n, root(n)) for e in edges if e[0] != e[1] for n in e}
    many = spark.createDataFrame([(f"u{i}", f"g{i // 7}") for i in range(7000)], "utt_id string, group_utt string")
    labels = spark.createDataFrame([(f"u{i}", "rare" if i % 50 == 0 else None) for i in range(7000)], "utt_id string, label string")
    out = grouped_split(many, labels, per_task=300)
    assert out.groupBy("group_utt").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    share = {x.split: x["count"] / 7000 for x in out.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["test"] - 0.1) < 0.02
    assert grouped_split(many.limit(0), labels).count() == 0


def test_forms_and_trie():
    assert forms.look_key("ｃаt​ ﬁne é") == forms.look_key("cat  fine é")
    assert forms.look_key("Cat") != forms.look_key("cat") and forms.look_key("a.") != forms.look_key("a")
    assert forms.is_plain("школа") and not forms.is_plain("шkола") and not forms.is_plain("оса")
    t = LookTrie()
    t.add("cat", 5)
    t.add("car", 9)
    assert t.match("сａt")[0][2] == "cat" and [m[2] for m in t.match("caz", budget=1)] == ["car", "cat"]
    assert t.match("dog") == []


def test_unify(spark):
    rows = [("a", "the cat", "x"), ("b", "the cаt", "x"), ("c", "the c​at", "x"), ("d", "The cat", "x"), ("e", None, "x"), ("f", "  ", "x"), ("g", "", "x"), ("h", "the cat", "x")]
    df = sup(spark, rows)
    assert {tuple(r) for r in same_look_pairs(df).collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "h"), ("c", "h")}
    got = {r.id: r.text for r in unify_texts(df).collect()}
    assert got["b"] == got["c"] == "the cat" and got["d"] == "The cat" and got["e"] is None and got["f"] == ""
    assert same_look_pairs(df.limit(0)).count() == 0


def test_overlap_against_brute_force(spark):
    r = random.Random(1)
    base = [[r.choice("abcdefghijklmnop") * 2 for _ in range(r.randint(6, 30))] for _ in range(25)]
    rows = []
    for k in range(120):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 1)] = ["zz"] * r.randint(0, 2)
        rows.append((f"i{k}", " ".join(w), r.choice(["train", "TRAIN-x", "dev", "test", None])))
    want = set()
    for i, t, s in rows:
        for j, u, v in rows:
            if s and v and s.lower().startswith("train") and not v.lower().startswith("train"):
                a, b = t.split(), u.split()
                most = max(len(a), len(b)) * 15 // 100
                if min(len(a), len(b)) >= 8 and word_distance(a, b, most) <= most:
                    want.add((min(i, j), max(i, j)))
    df = sup(spark, rows)
    assert want and {tuple(x) for x in cross_split_pairs(df).collect()} == want
    assert overlap_report(df).agg(F.sum("n_found")).first()[0] == len({x for p in want for x in p if next(s for i, _, s in rows if i == x) in ("dev", "test")})
    assert cross_split_pairs(df.limit(0)).count() == 0


def test_bounds():
    for n in range(8, 300):
        m = int(longest_partner(n))
        assert m - allowed(m) <= n < (m + 1) - allowed(m + 1) and min(block_sizes(n)) >= 4
    assert word_distance([], [], 0) == 0 and word_distance(["a"], [], 1) == 1 and word_distance(["a"] * 9, ["b"] * 9, 3) == 4


def test_runs(spark):
    y = spark.createDataFrame([("<blk>", 0), ("▁a", 1), ("A", 2), ("b", 3)], "symbol string, id int")
    rows = [("u", 1, 0, 5), ("u", 0, 5, 6), ("u", 2, 30, 40), ("u", 2, 30, 40), ("u", 2, 66, 70), ("u", 3, 70, 80), ("u", 3, 79, 79), ("u", None, 80, 81), ("u", 3, 90, 95), (None, 1, 0, 1), ("u", 9, 200, 201)]
    df = spark.createDataFrame(rows, "utt_id string, token int, start_frame int, end_frame int")
    want = {(0, 40, 2), (66, 70, 1), (70, 95, 2), (200, 201, 1)}
    for size in (20_000, 7):
        assert {(r.start_frame, r.end_frame, r.n_spans) for r in collapse_runs(df, y, slice_frames=size).collect()} == want
    long = spark.range(3000).selectExpr("'v' as utt_id", "1 as token", "cast(id * 10 as int) as start_frame", "cast(id * 10 + 5 as int) as end_frame")
    assert [r.n_spans for r in collapse_runs(long, y, slice_frames=500).collect()] == [3000]
    assert collapse_runs(df.limit(0), y).count() == 0


def test_encoding(spark):
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "hello  world", "<|endoftext|> x", "我们终于在新文州", "a" * 5000, "naïve 🎧 \n\n\t x", " ", "don't", "𝒳" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in encode_texts(df).collect()}
    assert got == {i: ref.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in decode_ids(encode_texts(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert load().decode([]) == ""


def test_mixing(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["red green blue", "one two three"][i % 2].split()) for _ in range(20)), ["col", "num"][i % 2] if i % 10 else None) for i in range(600)]
    rows += [(1000, None, "col"), (1001, "", "num"), (1002, "x y", "other")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("col", 0.7, 1), ("num", 0.3, 2), ("none", 0.1, 3), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    used, shares = mix_sources(docs, targets)
    got = {x.source: x for x in shares.collect()}
    assert abs(got["col"].reached_share - 0.7) < 0.03 and abs(got["num"].reached_share - 0.3) < 0.03 and got["none"].used == 0
    tokens = {x.source: x.n for x in used.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("n")).collect()}
    assert abs(tokens["col"] / (tokens["col"] + tokens["num"]) - got["col"].labelled_share) < 1e-9
    assert used.where("source = 'col' and repeats > 1").count() == 0 and used.where("source = 'other' or doc_id in (1000, 1001)").count() == 0
    empty, _ = mix_sources(docs.limit(0), targets)
    assert empty.count() == 0


def test_tagger_gradients():
    m = {k: v.astype(np.float64) for k, v in tagger.new_model(4, 3).items()}
    r = np.random.default_rng(0)
    idx, y = r.integers(1, tagger.V, (2, 6)), r.integers(0, 3, (2, 6))
    _, g = tagger._gradients(m, idx, y)
    for k, v in m.items():
        i = int(np.abs(g[k]).argmax())
        flat = v.reshape(-1)
        old = flat[i]
        flat[i] = old + 1e-3
        up = tagger._gradients(m, idx, y)[0]
        flat[i] = old - 1e-3
        down = tagger._gradients(m, idx, y)[0]
        flat[i] = old
        assert abs((up - down) / 2e-3 - g[k].reshape(-1)[i]) < 1e-5


def test_checker():
    c = pii.Checker({"marit", "corwin"}, {"baker", "field"})
    find = lambda t: [(a, k) for a, _, k in c.find(t)]
    assert find("write to a.b@c.org now") == [(9, "email")]
    assert find("ask verity dot field at mail dot example") == [(0, "email")] or find("ask verity dot field at mail dot example")[0][1] == "email"
    assert find("call +44 20 7946 0289, ticket 55-0192-7376 is closed") == [(5, "phone")]
    assert find("my social security number is 666-17-2275") == [(29, "idnum")]
    assert find("I live at 45 W. Falmor Blvd") == [(10, "address")]
    assert find("Dr. Marit Baker and Field, Corwin") == [(4, "name"), (20, "name")]
    assert find("the baker saw a field") == []


FILLER = "the lively basket opens the quiet window near the harbor while eleven 42 Grey Kettle 7:30 boats".split()
FORMS = ("My name is {n}.", "write to {e}!", "call me back on {p},", "{n} joined late.", "my passport number is {i}.", "this is {n} speaking;")


def _letters(r, names):
    """A text with entities put in, and where they are: labels that no pattern made."""
    t, want = " ".join(r.choice(FILLER) for _ in range(12)) + ". ", set()
    for form in r.sample(FORMS, 3):
        k = form[form.index("{") + 1]
        g, f = r.choice(names[0]), r.choice(names[1])
        v = {"n": f"{g} {f}", "e": f"{g}.{f}@mail.example".lower(), "p": f"+44 20 7946 {r.randrange(1000, 9999)}", "i": f"XK{r.randrange(10**6, 10**7)}"}[k]
        want.add(({"n": "name", "e": "email", "p": "phone", "i": "idnum"}[k], len(t) + form.index("{")))
        t += form.replace("{" + k + "}", v) + " " + " ".join(r.choice(FILLER) for _ in range(r.randrange(4, 20))) + ". "
    return t, want


def test_personal_held_out(spark, monkeypatch):
    """Fitted on some texts, scored on others whose names are neither listed nor in the fit."""
    monkeypatch.setattr(pii, "STEPS", 160)
    r = random.Random(2)
    known = "Marit Corwin Hedda Tessa Odrin Florian Jolanta Verity Bastian Severin".split(), "Baker Marlow Winter Kestrin Thorncliff Vantrell Ostrander Pickersley Orsatti Nordhagen".split()
    new = ["Isolde", "Bertrand", "Quillon", "Ysabel", "Anselm"], ["Trevanion", "Hollisworth", "Dravemont", "Pennick", "Oswin"]
    parts = spark.createDataFrame([(g, "given") for g in known[0]] + [(f, "family") for f in known[1]], "name_part string, part_kind string")
    train = spark.createDataFrame([(i, _letters(r, known)[0]) for i in range(400)], "doc_id bigint, text string")
    fitted = pii.fit_on(train, parts)
    held = [_letters(r, new if i % 2 else known) for i in range(200)]
    rows = [(i, t) for i, (t, _) in enumerate(held)]
    df = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "x" * 3000), (903, "nothing here")], "doc_id bigint, text string").withColumn("kind", F.lit("clash"))
    got = {(x.doc_id, x.kind, x.start_char) for x in pii.find_personal(df, parts, fitted).collect()}
    want = {(i, k, a) for i, (_, w) in enumerate(held) for k, a in w}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    unlisted = {x for x in want if x[0] % 2 and x[1] == "name"}
    assert len(unlisted) > 80 and len(got & unlisted) >= 0.85 * len(unlisted)
    masked = {x.doc_id: (x.text, x.n_masked) for x in pii.mask_personal(df, parts, fitted).where("doc_id >= 900").collect()}
    assert masked == {900: (None, 0), 901: ("", 0), 902: ("x" * 3000, 0), 903: ("nothing here", 0)}


def test_nothing_without_a_tagger():
    """Taggers that have learned nothing find next to nothing, whatever the patterns know."""
    known = ["Marit", "Corwin"], ["Baker", "Winter"]
    found = all_ = 0
    for seed in range(1, 9):
        r = random.Random(seed)
        texts, want = zip(*[_letters(r, known) for _ in range(40)], strict=True)
        fitted = {"model": tagger.new_model(pii.HIDDEN, 6, seed), "given": {x.lower() for x in known[0]}, "family": {x.lower() for x in known[1]}}
        true = {(i, *x) for i, w in enumerate(want) for x in w}
        found += len({(i, k, a) for i, spans in enumerate(pii.detect(fitted, list(texts))) for a, _, k in spans} & true)
        all_ += len(true)
    assert found <= 0.2 * all_
    fitted["model"] = {k: v * 0 for k, v in fitted["model"].items()}
    assert pii.detect(fitted, list(texts)) == [[]] * len(texts)


def test_long_entities_are_whole():
    check, s = pii.Checker(set(), set()), "write to " + "very.long." * 12 + "name@" + "sub." * 15 + "example now"
    tags = np.zeros(len(s), dtype=np.int8)
    tags[40:120] = pii.TAG["email"]
    assert [s[a:b] for a, b, _ in pii.settle(s, tags, check, {})] == [s[9:-4]]
    assert pii.settle(s, np.zeros(len(s), dtype=np.int8), check, {}) == []



def test_split_of_label_with_a_group_for_each_task(spark):
    label = {f"g{i:04}": "rare" if i % 130 == 0 else "often" for i in range(2600)}
    members = spark.createDataFrame([(g, g) for g in label], "utt_id string, group_utt string")
    got = {r.utt_id: r.split for r in grouped_split(members, spark.createDataFrame(list(label.items()), "utt_id string, label string"), per_task=130).collect()}
    assert len(got) == 2600
    count = Counter(got[g] for g in label if label[g] == "rare")
    assert sorted(count.values()) == [2, 2, 16]


def test_overlap_of_a_phrase_in_many_texts(spark):
    """A run of words that more than HOT texts of both sides share, with near pairs among them."""
    from vocalith.llm import overlap

    r = random.Random(9)
    rows = [(f"t{k}", "thank you very much for the " + " ".join(r.choice("abcdefghijklmnop") * 3 + str(r.randrange(40)) for _ in range(5)), "train") for k in range(300)]
    rows += [(f"e{k}", (t if k % 3 else t.replace("thank", "thanks")) + (" now" if k % 2 else ""), "dev") for k, (_, t, _) in enumerate(rows[:240])]
    want = {(f"e{k}", f"t{k}") for k in range(240) if k % 3 or not k % 2}
    got = {tuple(x) for x in cross_split_pairs(sup(spark, rows)).collect()}
    assert got == want and len(rows) > overlap.HOT


def test_turns_without_limits(spark):
    name, other = "Bartholomew-Alexander Featherstonehaugh-Cholmondeley", "Ottoline Wigglesworth-Ramsbottom-Higginbotham-Smith"
    text = f"{name}: hello [laughter from all over the very large and crowded room here] you\n{other}: um\n{other}: yes\n[{name}] bye"
    got = sorted((r.turn_no, r.speaker_no, r.text) for r in speaker_turns(sup(spark, [("x", text, "train")])).collect())
    assert got == [(1, 1, "hello you"), (2, 2, "yes"), (3, 1, "bye")]


def test_classes_and_links(spark):
    words = "one two three four five six seven eight nine ten"
    rows = [("a", words, "train"), ("b", words, "dev"), ("c", words.replace("ten", "tenth"), "dev"), ("d", words.upper(), "train"), ("e", "too short", "dev"), ("f", "other " * 9, "test"), ("g", None, "dev")]
    df = sup(spark, rows)
    assert {tuple(r) for r in overlap_links(df).collect()} == {("a", "a", 2), ("b", "a", 2), ("c", "c", 2), ("d", "a", 2), ("f", "f", 0)}
    df = sup(spark, [("a", "the cat", "x"), ("b", "the c\u0430t", "x"), ("c", "the cat", "x"), ("d", "The cat", "x"), ("e", None, "x"), ("f", " ", "x")])
    assert {tuple(r) for r in look_classes(df).collect()} == {("a", "a", 2), ("b", "a", 2), ("c", "a", 2), ("d", "d", 1)}
    assert overlap_links(df.limit(0)).count() == look_classes(df.limit(0)).count() == 0


def test_overlap_of_long_texts_in_one_manner(spark, monkeypatch):
    """Long texts that have a phrase in common are no candidates for that alone."""
    from vocalith.llm import overlap

    r = random.Random(4)
    noun, verb = lambda: f"noun{r.randrange(150)}", lambda: f"verb{r.randrange(40)}"
    pick = lambda: f"the {noun()} {verb()} a {noun()} " + "we do not think that " * (r.random() < 0.4)
    texts = [" ".join("".join(pick() for _ in range(25)).split()) for _ in range(160)]
    rows = [(f"x{k}", t, "train" if k < 110 else "dev") for k, t in enumerate(texts)]
    rows += [(f"y{k}", " ".join(w if i % 9 else "changed" for i, w in enumerate(texts[k].split())), "dev") for k in range(4)]
    made, real = [], overlap.candidates
    monkeypatch.setattr(overlap, "candidates", lambda c: made.append(real(c)) or made[-1])
    got = {tuple(x) for x in cross_split_pairs(sup(spark, rows)).collect()}
    assert got == {(f"x{k}", f"y{k}") for k in range(4)}
    assert made[0].count() < 400  # of 5940


def test_overlap_of_common_blocks_and_long_texts(spark, monkeypatch):
    """Every block told apart by fingerprints, with few and with many edits, against all pairs."""
    from vocalith.llm import overlap

    for n in range(overlap.MIN_WORDS, 500):
        for m in range(n, int(longest_partner(n)) + 1):
            assert m - overlap.RUN + 1 - overlap.RUN * allowed(m) >= overlap.runs_needed(n)
    monkeypatch.setattr(overlap, "HOT", 1)
    r = random.Random(11)
    base = [[r.choice("abcdefghijkl") * 2 for _ in range(n)] for n in (8, 13, 14, 20, 27, 40, 53, 54, 60, 90, 130)]
    rows = []
    for k in range(130):
        w = list(r.choice(base))
        for _ in range(r.randint(0, len(w) // 5)):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 1)] = [r.choice("abcz") * 2] * r.randint(0, 2)
        rows.append((f"i{k}", " ".join(w), r.choice(["train", "dev"])))
    want = set()
    for i, t, s in rows:
        for j, u, v in rows:
            if s == "train" and v == "dev" and min(len(t), len(u)) >= 23:
                a, b = t.split(), u.split()
                most = allowed(max(len(a), len(b)))
                if min(len(a), len(b)) >= 8 and word_distance(a, b, most) <= most:
                    want.add((min(i, j), max(i, j)))
    assert len(want) > 100 and {tuple(x) for x in cross_split_pairs(sup(spark, rows)).collect()} == want
