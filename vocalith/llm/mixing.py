"""Mixing sources to target shares of tokens (problem 9)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocalith.llm.encode import TOKENIZER, TOKENIZER_DIR, _pieces, load
from vocalith.session import materialize

#: Labelled documents of each source that the classifier is fitted on, at most; chosen by the hash of the id.
FIT_PER_SOURCE = 400
#: Hashed features of the classifier, and its passes over the sample.
FEATURES, PASSES = 4096, 30
#: Weight of the classifier in the posteriors of a document that has a label: how often labels are taken to be wrong.
LABEL_NOISE = 0.02
#: The projected gradient ends when no source is further from its tokens than this share of the mixture, or nothing moves.
CLOSE = 1e-4
#: Documents that are rounded to whole repeats together, about.
PER_GROUP = 5000
_WORD = re.compile(r"\w+|[^\w\s]")


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, word pairs and shape of a text: indices and weights of unit length."""
    ws = [w.lower() for w in _WORD.findall(text)]
    shape = [f"#lines{min(9, text.count(chr(10)))}", f"#colons{min(9, text.count(':'))}", f"#len{len(text).bit_length()}"]
    idx = [xxhash.xxh32_intdigest(w) % FEATURES for w in (*ws, *(a + " " + b for a, b in zip(ws, ws[1:], strict=False)), *shape)]
    if not idx:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    i, n = np.unique(np.array(idx), return_counts=True)
    v = np.log1p(n)
    return i, v / np.sqrt((v * v).sum())


def fit_classifier(rows: list[tuple[int, np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """Softmax regression on hashed features by full-batch gradient steps; the last row of the result is the bias."""
    x = np.zeros((len(rows), FEATURES + 1), dtype=np.float32)
    for r, (_, i, v) in enumerate(rows):
        x[r, i] = v
    x[:, -1] = 0.3
    y = np.eye(k, dtype=np.float32)[np.array([r[0] for r in rows], dtype=np.int64)] if rows else np.zeros((0, k), dtype=np.float32)
    w = np.zeros((FEATURES + 1, k), dtype=np.float32)
    for _ in range(PASSES if rows else 0):
        z = x @ w
        z = np.exp(z - z.max(axis=1, keepdims=True))
        p = z / z.sum(axis=1, keepdims=True)
        w += 20.0 * (x.T @ (y - p)) / len(rows)
    w[-1, y.sum(axis=0) == 0] = -1e9  # a class without a labelled document gets no share
    return w


def posteriors(w: np.ndarray, text: str) -> np.ndarray:
    i, v = _features(text)
    z = (w[i] * v[:, None]).sum(axis=0) + 0.3 * w[-1]
    z = np.exp(z - z.max())
    return z / z.sum()


def _documents(docs: DataFrame, sources: list[str], w: np.ndarray | None, tokenizer: str, folder: str) -> DataFrame:
    """(doc_id, source, size, post): tokens, and the posterior of each target source."""
    at = {s: i for i, s in enumerate(sources)}
    k = len(sources)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(tokenizer, folder)
        for pdf in batches:
            post = []
            for s, t in zip(pdf["source"], pdf["text"], strict=True):
                p = posteriors(w, t).astype(float) if w is not None and t else np.full(k, 0.0)
                if s is not None:
                    own = np.zeros(k)
                    own[at[s]] = 1.0
                    p = own if not p.any() else LABEL_NOISE * p + (1 - LABEL_NOISE) * own
                post.append(p)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"].astype(object), "size": [len(bpe.encode(t)) for t in pdf["text"]], "post": post})

    d = _pieces(docs.where(F.col("source").isNull() | F.col("source").isin(sources)).select("doc_id", "source", "text"))
    return d.mapInPandas(run, "doc_id bigint, source string, size bigint, post array<double>")


def _sample(docs: DataFrame, sources: list[str]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Features of at most FIT_PER_SOURCE labelled documents of each source, the first by the hash of their ids. What the
    driver gets is bounded by the number of features."""
    at = {s: i for i, s in enumerate(sources)}
    own = docs.where(F.col("source").isin(sources) & (F.length("text") > 0)).select("source", "text", "doc_id")
    counts = {r["source"]: r["n"] for r in own.groupBy("source").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return []
    frac = F.lit(0.0)
    for s, n in counts.items():  # about FIT_PER_SOURCE documents each, by hash, before the exact cut below
        frac = F.when(F.col("source") == s, F.lit(min(1.0, 1.5 * FIT_PER_SOURCE / n))).otherwise(frac)
    u = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)).alias("u")
    some = own.select("*", u).where(F.col("u") < frac)
    some = some.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("u", "doc_id"))).where(F.col("rn") <= FIT_PER_SOURCE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = [_features(t) for t in pdf["text"]]
            yield pd.DataFrame({"source": pdf["source"].astype(object), "rn": pdf["rn"], "i": [x[0] for x in f], "v": [x[1] for x in f]})

    rows = some.select("source", "rn", "text").mapInPandas(run, "source string, rn int, i array<bigint>, v array<double>").collect()
    return [(at[r["source"]], np.array(r["i"], dtype=np.int64), np.array(r["v"])) for r in sorted(rows, key=lambda r: (r["source"], r["rn"]))]


def _tops(post: np.ndarray, label: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """The most often that each document may be used: by its label, else by its most probable source."""
    return cap[np.where(label >= 0, label, post.argmax(axis=1))]


def _fold(post: np.ndarray, top: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The rates of documents after the steps, each kept between 0 and the most that is allowed."""
    r = np.zeros(len(post))
    for s in steps:
        r = np.clip(r + post @ s, 0, top)
    return r


def _round(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole repeats for rates, from large to small documents: what a document gets too much or too little in tokens goes on
    to the next one, so a group misses its tokens by half of its smallest document."""
    pdf = pdf.sort_values(["size", "doc_id"], ascending=False, kind="stable")
    carry, out = 0.0, []
    for size, rate, top in zip(pdf["size"], pdf["rate"], pdf["top"], strict=True):
        carry += size * rate
        n = min(int(top), max(0, int(np.floor(carry / size + 0.5))))
        carry -= n * size
        out.append(n)
    return pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"].astype(object), "size": pdf["size"], "post": pdf["post"], "repeats": np.array(out, dtype=np.int32)})


def mix_sources(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> tuple[DataFrame, DataFrame]:
    """(documents, shares) of a mixture of sources.

    documents: (doc_id, source, size, repeats) of all documents that are used; shares: (source, target_share,
    reached_share, labelled_share, available, used, wanted) with sizes in tokens.

    A classifier, fitted on at most FIT_PER_SOURCE labelled documents of each source, gives every document its posteriors; a
    label counts as evidence that is wrong in the share LABEL_NOISE of cases. Documents of sources without a target are not
    used. Each document has a rate of its own between 0 and the repeats allowed (of its label, else of its most probable
    source). Projected gradient steps on the squared differences between expected and target tokens of each source move all
    rates from 0 on; a round reads the documents once and sends one sum for each source to the driver, and rounds go on
    until the totals match or nothing moves any more. The size of the mixture is the largest at which no source lacks
    tokens; target sources without documents are reported with what is reached, mostly 0, and the others keep their
    proportions. ``reached_share`` counts tokens by posteriors, ``labelled_share`` by the labels of the documents.

    Null, empty or repeated targets: null sources and shares are dropped, the largest share of a repeated source counts.
    Null and empty texts have size 0 and are not used.
    """
    spark = docs.sparkSession
    t = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    rows = sorted(t.collect())  # one row for each target source, a table written by hand
    sources = [r["source"] for r in rows]
    share = np.array([r["share"] for r in rows], dtype=float)
    cap = np.array([max(0, r["cap"] if r["cap"] is not None else 1) for r in rows], dtype=float)
    k = len(sources)
    if not k:
        raise ValueError("no target share is given")
    at = {s: i for i, s in enumerate(sources)}
    fitted = _sample(docs, sources)
    w = fit_classifier(fitted, k) if fitted else None
    d = materialize(_documents(docs, sources, w, tokenizer, folder).where("size > 0"))
    own = {r["source"]: (r["size"], r["n"]) for r in d.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    have = np.array([float(own.get(s, (0, 0))[0]) for s in sources])
    goal = np.where(have * cap > 0, share, 0.0)
    goal = goal / goal.sum() if goal.sum() else goal

    def labels(pdf: pd.DataFrame) -> np.ndarray:
        return pdf["source"].map(lambda x: at.get(x, -1)).to_numpy(dtype=np.int64)

    def sums(steps: list[np.ndarray] | None) -> np.ndarray:
        """Expected tokens of each source: with the rates after the steps, or with all documents as often as allowed."""
        so_far = None if steps is None else np.array(steps)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    post = np.stack(pdf["post"].to_numpy())
                    top = _tops(post, labels(pdf), cap)
                    rate = top if so_far is None else _fold(post, top, so_far)
                    yield pd.DataFrame([((rate * pdf["size"].to_numpy())[:, None] * post).sum(axis=0)], columns=[f"s{i}" for i in range(k)])

        part = d.select("source", "size", "post").mapInPandas(run, ", ".join(f"s{i} double" for i in range(k)))
        got = part.agg(*[F.sum(f"s{i}") for i in range(k)]).first()
        return np.array([float(x or 0) for x in got])

    most = sums(None)
    usable = goal > 0
    total = float(np.min(most[usable] / goal[usable])) if usable.any() else 0.0
    want = goal * total
    scale = np.where(most > 0, most, 1.0)
    steps: list[np.ndarray] = []
    worst = np.inf
    while total:
        gap = want - (sums(steps) if steps else 0.0)
        now = float(np.abs(gap).max())
        if now <= CLOSE * total or now > 0.99 * worst:
            break
        # The gradient of a rate is its size times the gaps by its posteriors; dividing by what a source could give at
        # most frees the step of units, and repeats count as often as they are allowed.
        worst = now
        steps.append(gap / scale * cap.clip(1))
    so_far = np.array(steps).reshape(-1, k)

    def rates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            post = np.stack(pdf["post"].to_numpy()) if len(pdf) else np.zeros((0, k))
            top = _tops(post, labels(pdf), cap) if len(pdf) else np.zeros(0)
            yield pdf.assign(source=pdf["source"].astype(object), rate=_fold(post, top, so_far), top=top)

    # Documents are rounded in groups of about PER_GROUP.
    groups = F.lit(1)
    for s, (_, n) in own.items():
        groups = F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(max(1, n // PER_GROUP))).otherwise(groups)
    r = d.mapInPandas(rates, "doc_id bigint, source string, size bigint, post array<double>, rate double, top double")
    r = r.withColumn("g", F.pmod(F.xxhash64("doc_id"), groups)).groupBy("source", "g").applyInPandas(lambda p: _round(p), "doc_id bigint, source string, size bigint, post array<double>, repeats int")
    used = materialize(r.where("repeats > 0"))
    tokens = F.col("size") * F.col("repeats")
    got = used.agg(*[F.sum(tokens * F.col("post")[i]) for i in range(k)], *[F.sum(F.when(F.col("source") == s, tokens)) for s in sources]).first()
    got = np.array([float(x or 0) for x in got])
    soft, hard = got[:k], got[k:]
    whole, named = soft.sum() or 1.0, hard.sum() or 1.0
    report = [(s, float(a), float(g / whole), float(b / named), int(h), float(g), float(x)) for s, a, g, b, h, x in zip(sources, share, soft, hard, have, want, strict=True)]
    shares = spark.createDataFrame(report, "source string, target_share double, reached_share double, labelled_share double, available bigint, used double, wanted double")
    return used.select("doc_id", "source", "size", "repeats"), shares
