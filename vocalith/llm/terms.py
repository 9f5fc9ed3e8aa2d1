"""Frequencies of all terms and n-grams of a collection (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalith.llm.common import once_per_id

#: A term: a maximal run of letters, digits of any kind, combining marks and apostrophes.
TERM = regex.compile(r"[\p{L}\p{N}\p{M}']+")
#: Records whose suffixes are sorted at once.
BLOCK = 20_000
#: A term is rare in at most so many records, and common in more than this share of the records with text.
RARE, COMMON = 2, 0.05


def suffix_array(tokens: np.ndarray, record: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the one before, tokens left of each) of a block of records.

    Ranks are doubled until they cover ``depth`` tokens; behind a record's end there is a token smaller than all others, so
    no prefix goes on into the next record. Common prefixes count ``depth`` tokens at most; suffixes equal so far stay in
    the order of the text.
    """
    size = len(tokens)
    ends = np.searchsorted(record, record, side="right")
    left = ends - np.arange(size)
    rank = tokens.astype(np.int64)
    width = 1
    while width < depth:
        nxt = np.arange(size) + width
        ahead = np.where(nxt < ends, rank[np.minimum(nxt, size - 1)] + 1, 0) if size else rank
        _, rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + ahead, return_inverse=True)
        width *= 2
    sa = np.argsort(rank, kind="stable")
    lcp = np.zeros(size, dtype=np.int64)
    go = np.arange(1, size)
    for n in range(depth):
        a, b = sa[go - 1] + n, sa[go] + n
        inside = (left[sa[go - 1]] > n) & (left[sa[go]] > n)
        go = go[inside][tokens[a[inside]] == tokens[b[inside]]]
        lcp[go] += 1
    return sa, lcp, left[sa]


def suffix_counts(tokens: np.ndarray, record: np.ndarray, max_n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, a start of each distinct n-gram, occurrences, records) from the suffix array of a block of records.

    ``tokens`` are the codes of all records one after the other, ``record`` the ascending record numbers. An n-gram is an
    interval of the array inside which neighbours share n tokens at least; its length is the number of occurrences. A
    record occurs in it once, and once more for each neighbour in its own order that lies in the same interval; these
    adjacencies are subtracted.
    """
    if not len(tokens):
        return
    sa, lcp, left = suffix_array(tokens, record, max_n)
    of = record[sa]
    own = np.argsort(of, kind="stable")  # each record's suffixes in the order of the array
    again = own[1:][of[own[1:]] == of[own[:-1]]]
    before = own[:-1][of[own[1:]] == of[own[:-1]]]
    for n in range(1, max_n + 1):
        interval = np.cumsum(lcp < n) - 1
        starts = np.flatnonzero(lcp < n)
        occ = np.diff(np.append(starts, len(sa)))
        twice = np.bincount(interval[again][interval[again] == interval[before]], minlength=len(starts))
        long = left[starts] >= n
        if long.any():
            yield n, sa[starts[long]], occ[long], (occ - twice)[long]


def _count(max_n: int, block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(texts: list[str]) -> Iterator[pd.DataFrame]:
            codes: dict[str, int] = {}
            flat: list[int] = []
            lens = np.empty(len(texts), dtype=np.int64)
            find = TERM.findall
            for i, t in enumerate(texts):
                ws = find(t.lower())
                lens[i] = len(ws)
                flat.extend([codes.setdefault(w, len(codes)) for w in ws])
            tokens = np.array(flat, dtype=np.int64)
            words = np.array(list(codes), dtype=object)
            for n, first, occ, rec in suffix_counts(tokens, np.repeat(np.arange(len(texts)), lens), max_n):
                term = words[tokens[first]]
                for k in range(1, n):
                    term = term + " " + words[tokens[first + k]]
                yield pd.DataFrame({"n": np.full(len(first), n, dtype=np.int32), "term": term, "occurrences": occ, "records": rec})

        held: list[str] = []
        for pdf in batches:
            held.extend(pdf["text"])
            while len(held) >= block:
                yield from flush(held[:block])
                held = held[block:]
        if held:
            yield from flush(held)

    return run


def term_counts(texts: DataFrame, text_col: str = "text", max_n: int = 1, block: int = BLOCK) -> DataFrame:
    """(n, term, occurrences, records): every distinct n-gram up to ``max_n`` terms, over all rows.

    Each block of records is counted by a suffix array; the partial counts add up, since no record is in two blocks.
    Null and empty texts have no terms. Rows are records: repeated rows count each time. ``block`` bounds the memory
    of a task and changes nothing in the result.
    """
    t = texts.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    part = t.mapInPandas(_count(max_n, block), "n int, term string, occurrences bigint, records bigint")
    return part.groupBy("n", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(sup: DataFrame, rare: int = RARE, common: float = COMMON, max_n: int = 1) -> DataFrame:
    """(n, term, occurrences, records, mark): each n-gram of the supervisions with its mark ``rare``, ``common`` or null.

    Each id counts once. Rare: in at most ``rare`` supervisions; common: in more than the share ``common`` of the
    supervisions with non-null text. If both hold, the term is rare.
    """
    once = once_per_id(sup, "text").where(F.col("text").isNotNull())
    n = sup.where(F.col("text").isNotNull() & F.col("id").isNotNull()).agg(F.count_distinct("id").alias("total"))
    counts = term_counts(once, max_n=max_n).join(F.broadcast(n))  # one row
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * F.col("total"), "common")
    return counts.select("n", "term", "occurrences", "records", mark.alias("mark"))
