"""Edit alignment, error rates, keyword spotting and ranking metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = "*"


def align(ref: list, hyp: list) -> list[tuple]:
    """Pairs (ref, hyp) of a cheapest alignment; ``*`` stands for nothing. Ties prefer the diagonal, then deletion.

    Only cells within ``band`` of the main diagonal are filled; the band doubles until it is as wide as the cost, when it holds
    every cheapest path. Texts that are nearly the same take time in proportion to their length.
    """
    n, m = len(ref), len(hyp)
    band = max(8, abs(n - m))
    while True:
        rows = _band(ref, hyp, band)
        if rows[n][m - max(0, n - band)] <= band or band >= max(n, m):
            break
        band *= 2
    far = n + m + 1

    def cost(i: int, j: int) -> int:
        k = j - max(0, i - band)
        return rows[i][k] if 0 <= k < len(rows[i]) else far

    out, i, j = [], n, m
    while i or j:
        now = cost(i, j)
        if i and j and now == cost(i - 1, j - 1) + (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            out.append((ref[i], hyp[j]))
        elif i and now == cost(i - 1, j) + 1:
            i -= 1
            out.append((ref[i], EPS))
        else:
            j -= 1
            out.append((EPS, hyp[j]))
    return out[::-1]


def _band(ref: list, hyp: list, band: int) -> list[list[int]]:
    """The rows of the table of costs; row i begins at column max(0, i - band) and ends at i + band."""
    n, m = len(ref), len(hyp)
    far = n + m + 1
    rows = [list(range(min(m, band) + 1))]
    for i in range(1, n + 1):
        lo, hi, above, start = max(0, i - band), min(m, i + band), rows[-1], max(0, i - 1 - band)
        row: list[int] = []
        left, word, size = far, ref[i - 1], len(above)
        for j in range(lo, hi + 1):
            k = j - start
            best = left + 1
            if j and 0 < k <= size and (d := above[k - 1] + (word != hyp[j - 1])) < best:
                best = d
            if k < size and above[k] + 1 < best:
                best = above[k] + 1
            row.append(best)
            left = best
        rows.append(row)
    return rows


def render(pairs: list[tuple]) -> str:
    """An alignment as text, neighbouring errors joined: ``(EDISON->ADDISON)``."""
    out, r, h = [], [], []

    def flush() -> None:
        if r or h:
            out.append(f"({' '.join(r) or EPS}->{' '.join(h) or EPS})")
            r.clear()
            h.clear()

    for a, b in pairs:
        if a == b:
            flush()
            out.append(a)
        else:
            r.extend([a] if a != EPS else [])
            h.extend([b] if b != EPS else [])
    flush()
    return " ".join(out)


def alignments(results: DataFrame, key: str = "id") -> DataFrame:
    """(key, pos, ref, hyp): alignment of the word arrays ``ref`` and ``hyp``; null arrays count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (k, i, a, b)
                for k, r, h in zip(pdf["k"], pdf["ref"], pdf["hyp"], strict=True)
                for i, (a, b) in enumerate(align(list(r) if r is not None else [], list(h) if h is not None else []))
            ]
            yield pd.DataFrame(rows, columns=[key, "pos", "ref", "hyp"])

    return results.select(F.col(key).alias("k"), "ref", "hyp").mapInPandas(run, f"{key} string, pos int, ref string, hyp string")


def _kind() -> Column:
    return F.when(F.col("ref") == F.col("hyp"), "cor").when(F.col("ref") == EPS, "ins").when(F.col("hyp") == EPS, "del").otherwise("sub")


def error_rate(aligned: DataFrame) -> DataFrame:
    """(n_ref, cor, sub, ins, del, wer): wer in percent, null without reference words."""
    k = aligned.select(_kind().alias("k"))
    g = k.agg(*[F.count_if(F.col("k") == x).alias(x) for x in ("cor", "sub", "ins", "del")])
    n = F.col("cor") + F.col("sub") + F.col("del")
    return g.select(n.alias("n_ref"), "cor", "sub", "ins", "del", F.try_divide(100.0 * (F.col("sub") + F.col("ins") + F.col("del")), n).alias("wer"))


def confusions(aligned: DataFrame) -> DataFrame:
    """(kind, ref, hyp, n): errors by frequency."""
    return aligned.withColumn("kind", _kind()).where("kind <> 'cor'").groupBy("kind", "ref", "hyp").agg(F.count("*").alias("n"))


def word_stats(aligned: DataFrame) -> DataFrame:
    """(word, cor, ref_errors, hyp_errors) of every word on either side."""
    k = _kind()
    r = aligned.where(F.col("ref") != EPS).select(F.col("ref").alias("word"), (k == "cor").alias("c"), F.lit(True).alias("r"))
    h = aligned.where((F.col("hyp") != EPS) & (k != "cor")).select(F.col("hyp").alias("word"), F.lit(False).alias("c"), F.lit(False).alias("r"))
    g = r.unionByName(h).groupBy("word")
    return g.agg(F.count_if("c").alias("cor"), F.count_if(F.col("r") & ~F.col("c")).alias("ref_errors"), F.count_if(~F.col("r")).alias("hyp_errors"))


def distance(a: str, b: str) -> int:
    """Edit distance of two texts that may have nothing in common: a column of the table at a time, as bits of one integer."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, total = full, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq
        right, left = down | (full & ~(x | up)), up & x
        total += bool(right & top) - bool(left & top)
        right, left = (right << 1 | 1) & full, (left << 1) & full
        eq |= down
        up, down = left | (full & ~(eq | right)), right & eq
    return total


def with_distance(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, errors): edit distance of each pair of whole texts, null if one is; the pairs are spread over the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf["k"], "errors": pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(pdf["a"], pdf["b"], strict=True)], dtype="Int64")})

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = pairs.select(F.col(key).alias("k"), F.col(a).alias("a"), F.col(b).alias("b")).repartition(n)
    return d.mapInPandas(run, f"{key} {pairs.schema[key].dataType.simpleString()}, errors bigint")


def char_errors(results: DataFrame, ref: str, hyp: str) -> DataFrame:
    """(n_ref, errors, cer): characters by edit distance, weighted by length."""
    d = with_distance(results.withColumn("n_ref", F.length(ref)), "n_ref", ref, hyp).agg(F.sum("n_ref").alias("n_ref"), F.sum("errors").alias("errors"))
    return d.withColumn("cer", F.try_divide(100.0 * F.col("errors"), F.col("n_ref")))


def delays(aligned_times: DataFrame) -> DataFrame:
    """(n, mean, var): difference of hypothesis and reference time over correct words."""
    x = F.col("time_hyp") - F.col("time_ref")
    return aligned_times.where(F.col("ref") == F.col("hyp")).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"))


def orc_errors(refs: list[list], channels: list[list]) -> int:
    """Fewest word errors over all assignments of utterances, in order, to channels.

    A table over the positions in all channels holds the fewest errors so far; each utterance moves it on along one channel
    or another. The time grows with the words of the references times the product of the channels' lengths.
    """
    shape = tuple(len(c) + 1 for c in channels)
    best = np.full(shape, 1 << 40, dtype=np.int64)
    best[(0,) * len(channels)] = 0
    for words in refs:
        ways = []
        for axis, hyp in enumerate(channels):
            row = np.moveaxis(best, axis, 0).copy()
            for w in (None, *words):
                new = row.copy() if w is None else row + 1
                for j in range(1, len(hyp) + 1):
                    if w is not None:
                        np.minimum(new[j], row[j - 1] + (w != hyp[j - 1]), out=new[j])
                    np.minimum(new[j], new[j - 1] + 1, out=new[j])
                row = new
            ways.append(np.moveaxis(row, 0, axis))
        best = np.minimum.reduce(ways)
    rest = sum(np.ix_(*[np.arange(n - 1, -1, -1) for n in shape]))
    return int((best + rest).min())


def permuted_errors(refs: list[list], channels: list[list]) -> int:
    """Fewest word errors over assignments of whole references to channels, one to one; a table over sets of references."""
    n = len(refs)
    cost = [[sum(a != b for a, b in align(r, c)) for r in refs] for c in channels]
    best = {0: 0}
    for row in cost:
        new: dict[int, int] = {}
        for used, so_far in best.items():
            for i in range(n):
                if not used >> i & 1:
                    k = used | 1 << i
                    new[k] = min(new.get(k, 1 << 40), so_far + row[i])
        best = new
    return best.get((1 << n) - 1, 0)


def keyword_metrics(hits: DataFrame) -> DataFrame:
    """Per keyword, and over all: tp, fn, fp, tn and ratios. ``hits`` has (keyword, in_ref, in_hyp)."""
    c = lambda x, n: F.count_if(x).alias(n)
    r, h = F.col("in_ref"), F.col("in_hyp")
    g = hits.withColumn("keyword", F.explode(F.array("keyword", F.lit("all")))).groupBy("keyword").agg(c(r & h, "tp"), c(r & ~h, "fn"), c(~r & h, "fp"), c(~r & ~h, "tn"))
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fn, fp, tn = (F.col(x) for x in ("tp", "fn", "fp", "tn"))
    g = g.withColumns({"accuracy": div(tp + tn, tp + tn + fp + fn), "precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "fpr": div(fp, fp + tn)})
    return g.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def average_precision(scored: DataFrame, cls: str = "cls") -> DataFrame:
    """(cls, ap): step-wise area under precision and recall; equal scores count together. ``scored`` has (cls, score, hit)."""
    t = scored.groupBy(cls, "score").agg(F.sum(F.col("hit").cast("int")).alias("h"), F.count("*").alias("n"))
    w = Window.partitionBy(cls).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"ch": F.sum("h").over(w), "cn": F.sum("n").over(w), "all": F.sum("h").over(Window.partitionBy(cls))})
    return t.where(F.col("all") > 0).groupBy(cls).agg(F.sum(F.col("h") / F.col("all") * F.col("ch") / F.col("cn")).alias("ap"))


def error_table(results: DataFrame, setting: str) -> DataFrame:
    """(setting, error, place): percent of wrong results of each setting, the best first. ``results`` has (setting, got, want)."""
    g = results.groupBy(setting).agg(F.round(100.0 * F.count_if(F.col("got") != F.col("want")) / F.count("*"), 6).alias("error"))
    return g.withColumn("place", F.rank().over(Window.orderBy("error", setting)).cast("bigint"))  # a row for each setting
