"""CTC decoding, prefix beam search and phrase boosting."""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def greedy(frames: DataFrame, key: str, order: str, scores: str, blank: int = 0) -> DataFrame:
    """(key, tokens): best label of each frame, repeats collapsed, blanks dropped; the first of equal scores wins."""
    best = frames.where(F.col(scores).isNotNull()).select(key, order, (F.array_position(scores, F.array_max(scores)) - 1).cast("int").alias("t"))
    w = Window.partitionBy(key).orderBy(order)
    x = best.withColumn("b", F.lag("t").over(w)).where((F.col("t") != blank) & (F.col("b").isNull() | (F.col("b") != F.col("t"))))
    x = x.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "t"))).alias("a"))
    return x.select(key, F.array_join(F.transform("a", lambda y: y["t"].cast("string")), " ").alias("tokens"))


def log_add(a: float, b: float) -> float:
    if a == -math.inf:
        return b
    if b == -math.inf:
        return a
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def prefix_beam(log_probs: np.ndarray, beam: int = 4, blank: int = 0) -> list[tuple[tuple[int, ...], float]]:
    """The best prefixes with their log probabilities; paths of one prefix are added up."""
    beams: dict[tuple, tuple[float, float]] = {(): (0.0, -math.inf)}  # ends in blank, ends in label
    for row in log_probs:
        nxt: dict[tuple, list[float]] = {}
        for t in np.argsort(-row, kind="stable")[:beam]:
            p = float(row[t])
            for prefix, (pb, pn) in beams.items():
                if t == blank:
                    c = nxt.setdefault(prefix, [-math.inf, -math.inf])
                    c[0] = log_add(c[0], log_add(pb, pn) + p)
                    continue
                t = int(t)
                if prefix and prefix[-1] == t:
                    c = nxt.setdefault(prefix, [-math.inf, -math.inf])
                    c[1] = log_add(c[1], pn + p)
                    if pb > -math.inf:  # the same label again needs a blank between
                        c = nxt.setdefault((*prefix, t), [-math.inf, -math.inf])
                        c[1] = log_add(c[1], pb + p)
                else:
                    c = nxt.setdefault((*prefix, t), [-math.inf, -math.inf])
                    c[1] = log_add(c[1], log_add(pb, pn) + p)
        best = sorted(nxt.items(), key=lambda x: (-log_add(*x[1]), x[0]))[:beam]
        beams = {k: (v[0], v[1]) for k, v in best}
    return [(k, log_add(*v)) for k, v in sorted(beams.items(), key=lambda x: (-log_add(*x[1]), x[0]))]


def beam_search(frames: DataFrame, key: str, order: str, scores: str, beam: int = 4, blank: int = 0) -> DataFrame:
    """(key, tokens, score) of the best prefix of each utterance; one task holds the frames of one utterance."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o")
        x = np.stack(pdf["s"].to_numpy()).astype(float)
        x = x - x.max(axis=1, keepdims=True)
        x = x - np.log(np.exp(x).sum(axis=1, keepdims=True))
        best, p = prefix_beam(x, beam, blank)[0]
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "tokens": [" ".join(map(str, best))], "score": [p]})

    d = frames.where(F.col(scores).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(order).alias("o"), F.col(scores).alias("s"))
    return d.groupBy("k").applyInPandas(run, "k string, tokens string, score double").withColumnRenamed("k", key)


class PhraseGraph:
    """A trie of phrases with failure links, stepped through one label at a time.

    Each phrase has a boost for each of its labels and a threshold of acoustic probability (``None``: the defaults). A
    state that phrases share has the largest boost among them. Labels may be characters or ids.
    """

    def __init__(self, phrases: list, score: float = 1.0, threshold: float = 1.0, scores: list[float | None] | None = None, thresholds: list[float | None] | None = None) -> None:
        self.next: list[dict] = [{}]
        self.boost, self.total, self.end, self.phrase, self.limit = [0.0], [0.0], [False], [None], [0.0]
        for k, p in enumerate(phrases):
            each = (scores[k] if scores else None) or score
            at = 0
            for c in p:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    for column, empty in ((self.boost, 0.0), (self.total, 0.0), (self.end, False), (self.phrase, None), (self.limit, 0.0)):
                        column.append(empty)
                self.boost[to] = max(self.boost[to], each)
                self.total[to] = self.total[at] + self.boost[to]
                at = to
            if at:
                self.end[at], self.phrase[at], self.limit[at] = True, p, (thresholds[k] if thresholds else None) or threshold
        self.fail, self.out, self.gain = [0] * len(self.next), [0] * len(self.next), [0.0] * len(self.next)
        queue = deque([0])
        while queue:
            s = queue.popleft()
            f = self.fail[s]
            self.out[s] = f if self.end[f] else self.out[f]
            # What all phrases that end here are worth together.
            self.gain[s] = (self.total[s] if self.end[s] else 0.0) + self.gain[self.out[s]]
            for c, t in self.next[s].items():
                self.fail[t] = self._go(f, c) if s else 0
                queue.append(t)

    def _go(self, at: int, c) -> int:
        while at and c not in self.next[at]:
            at = self.fail[at]
        return self.next[at].get(c, 0)

    def matched(self, at: int) -> int:
        """The state of the longest phrase that ends here, 0 if none does."""
        return at if self.end[at] else self.out[at]

    def step(self, at: int, c, strict: bool = True) -> tuple[float, int, int]:
        """(change of the boost, next state, state of the matched phrase or 0).

        An open match counts from its first label on and is taken back where it breaks off. ``strict`` adds each phrase
        that ends here and goes on; otherwise the longest one counts alone and matching starts anew at the root.
        """
        child = self.next[at].get(c)
        to = self._go(at, c) if child is None else child
        change = self.boost[to] if child is not None else self.total[to] - self.total[at]
        hit = self.matched(to)
        if strict or not self.gain[to]:
            return change + self.gain[to], to, hit
        return change + self.total[hit] - self.total[to], 0, hit

    def finish(self, at: int) -> float:
        """What an open match has to give back at the end."""
        return -self.total[at]

    def score(self, query, strict: bool = True) -> float:
        """The boost of a whole query."""
        at, total = 0, 0.0
        for c in query:
            change, at, _ = self.step(at, c, strict)
            total += change
        return total + self.finish(at)


def find_keywords(labels: list, probs: list[float], graph: PhraseGraph, blank=0, tail: int = 1) -> list[tuple[object, int, int, float]]:
    """(phrase, first frame, last frame, mean probability) of keywords in the best labels of the frames.

    Repeated labels count once, at their most probable frame. A keyword fires when more than ``tail`` blank frames follow
    its last label, or the frames end, and the mean probability of its labels reaches its threshold; then matching starts
    anew.
    """
    out, at, held, wait, before = [], 0, [], 0, None
    size = len(labels)
    for i, (c, p) in enumerate(zip(labels, probs, strict=True)):
        if c == blank:
            wait += 1
        elif c == before:
            if held and p > held[-1][1]:
                held[-1] = (held[-1][0], p, i)
            wait = 0
        else:
            _, at, _ = graph.step(at, c)
            held.append((i, p, i))
            wait = 0
        before = c
        hit = graph.matched(at)
        if hit and (wait > tail or i == size - 1):
            own = held[-len(graph.phrase[hit]) :]
            mean = sum(x[1] for x in own) / len(own)
            if mean >= graph.limit[hit]:
                out.append((graph.phrase[hit], own[0][0], own[-1][2], mean))
                at, held = 0, []
    return out


def keyword_hits(frames: DataFrame, key: str, order: str, scores: str, phrases: list[tuple[int, ...]], threshold: float = 0.5, tail: int = 1, blank: int = 0) -> DataFrame:
    """(key, phrase, first, last, prob): keywords in the best labels of each utterance; one task holds the frames of one
    utterance. ``first`` and ``last`` count frames from 0."""
    graph = PhraseGraph(phrases, threshold=threshold or 1e-9)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o")
        x = np.stack(pdf["s"].to_numpy()).astype(float)
        p = np.exp(x - x.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        hits = find_keywords(best.tolist(), p.max(axis=1).tolist(), graph, blank, tail)
        return pd.DataFrame([(pdf["k"].iloc[0], " ".join(map(str, a)), b, c, m) for a, b, c, m in hits], columns=["k", "phrase", "first", "last", "prob"])

    d = frames.where(F.col(scores).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(order).alias("o"), F.col(scores).alias("s"))
    return d.groupBy("k").applyInPandas(run, "k string, phrase string, first int, last int, prob double").withColumnRenamed("k", key)
