"""Encoding of texts with a byte-level BPE of public tokenizers (problem 8)."""

from __future__ import annotations

import base64
import heapq
import importlib
import os
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Name of the vocabulary file of ranks, and where the public tokenizers are.
TOKENIZER = "byte_bpe_50k.tiktoken"
TOKENIZER_DIR = "/opt/tokenizers"
#: Distinct pieces whose ids a worker remembers.
REMEMBERED = 500_000


class RankedBPE:
    """Byte-level BPE from a file of ranks.

    The pieces of a text are merged by a priority queue of ranks over a doubly linked list of symbols; an entry of the
    queue whose symbols have changed since is stale and skipped.
    """

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.vocab = {v: k for k, v in self.ranks.items()}
        self.known: dict[str, tuple[int, ...]] = {}

    def piece(self, raw: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        if (whole := ranks.get(raw)) is not None:
            return (whole,)
        n = len(raw)
        sym: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, size = heapq.heappop(queue)
            left = sym[i]
            if left is None or (j := after[i]) >= n or len(left) + len(sym[j]) != size:
                continue  # stale: one of the two was merged since
            merged = left + sym[j]
            sym[i], sym[j] = merged, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(merged + sym[k])) is not None:
                    heapq.heappush(queue, (r, i, size + len(sym[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(sym[h] + merged)) is not None:
                heapq.heappush(queue, (r, h, size + len(sym[h])))
        return tuple(ranks[s] for s in sym if s is not None)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for p in self.split(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8", "replace"))
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(p) < 64:
                    known[p] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.vocab[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(tokenizer: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> RankedBPE:
    """The tokenizer, once in each worker."""
    parent, name = os.path.split(os.path.realpath(folder))
    try:
        module = importlib.import_module(name)
    except ImportError:
        sys.path.append(parent)
        module = importlib.import_module(name)
    return RankedBPE(os.path.join(folder, tokenizer), module.PATTERN)


def _pieces(df: DataFrame) -> DataFrame:
    """Rows in enough partitions for a stage in Python; documents may come in a single file."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens.

    A null or empty text has the empty list. Text that looks like a special token is ordinary text. Each row is encoded
    as a whole, however long; repeated rows and null keys come out as they are. Other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(tokenizer, folder)
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                p = pdf.iloc[at : at + 500]
                yield pd.DataFrame({key: p[key], "ids": [np.array(bpe.encode(t), dtype=np.int32) for t in p["text"]]})

    kind = docs.schema[key].dataType.simpleString()
    return _pieces(docs.select(key, F.col(text).alias("text"))).mapInPandas(run, f"`{key}` {kind}, ids array<int>")


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, text): the texts of lists of ids, by joining the strings of the vocabulary; a null list gives null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(tokenizer, folder)
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "text": [None if x is None else bpe.decode(list(x)) for x in pdf["ids"]]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(ids).alias("ids")).mapInPandas(run, f"`{key}` {kind}, text string")
