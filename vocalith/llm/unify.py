"""Texts that look the same but are encoded in different characters (problem 5)."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalith.llm import forms
from vocalith.llm.common import once_per_id
from vocalith.session import materialize

#: Tokens of a trie, about: the vocabulary is cut into so many groups by the look of the tokens.
PER_TRIE = 5000


class LookTrie:
    """A vocabulary trie that is traversed by a weighted edit automaton.

    Replacing a character by a look-alike and skipping an ignorable one cost nothing, every other edit costs 1. The
    default budget 0 finds the spellings of exactly the same look.
    """

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, token: str, weight: int) -> None:
        node = self.root
        for c in forms.unicodedata.normalize("NFD", token):
            node = node.setdefault(c, {})
        node[""] = (weight, token)

    def match(self, token: str, budget: int = 0) -> list[tuple[int, int, str]]:
        """(cost, -weight, spelling) of the spellings within the budget, the best first."""
        key = forms.unicodedata.normalize("NFD", forms.look_key(token))
        shown: dict[str, str] = {}

        def look(c: str) -> str:
            if c not in shown:
                shown[c] = forms.unicodedata.normalize("NFD", c.translate(forms.LOOK))
            return shown[c]

        out = []
        # A state: a node, and for each reached position of the token its cost.
        stack = [(self.root, {0: 0} | {i: i for i in range(1, min(budget, len(key)) + 1)})]
        while stack:
            node, row = stack.pop()
            if "" in node and len(key) in row:
                out.append((row[len(key)], -node[""][0], node[""][1]))
            for c, child in node.items():
                if not c:
                    continue
                k = look(c)
                new: dict[int, int] = {}
                for i, cost in row.items():
                    if key.startswith(k, i):  # the same look, or nothing visible
                        new[i + len(k)] = min(cost, new.get(i + len(k), cost))
                    if cost < budget:
                        new[i] = min(cost + 1, new.get(i, cost + 1))
                        if i < len(key):
                            new[i + 1] = min(cost + 1, new.get(i + 1, cost + 1))
                for i in sorted(new) if budget else ():
                    if new[i] < budget and i < len(key):
                        new[i + 1] = min(new[i] + 1, new.get(i + 1, new[i] + 1))
                if new:
                    stack.append((child, new))
        return sorted(out)


def _digest(s: str) -> bytes:
    return xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass"))


def _look_hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        c: Counter = Counter()
        for t in pdf["text"]:
            c.update(forms.SPACES.split(t))
        c.pop("", None)
        toks = list(c)
        if not toks:
            continue
        yield pd.DataFrame({
            "token": toks,
            "n": [c[t] for t in toks],
            "look": [_look_hash(forms.look_key(t)) for t in toks],
            "plain": [forms.is_plain(t) for t in toks],
        })


def _canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    trie = LookTrie()
    for t, n, usable in zip(pdf["token"], pdf["n"], pdf["plain"], strict=True):
        if usable or (forms.plain_form(t) == t and forms.one_script(t)):
            trie.add(t, int(n) + (1 << 50 if usable else 0))
    out: dict[str, str] = {}
    for t in pdf.loc[~pdf["plain"], "token"]:
        found = trie.match(t)
        out[t] = found[0][2] if found else forms.table_form(t)
    return pd.DataFrame({"token": list(out), "canon": list(out.values())}, dtype=object)


def canonical_tokens(texts: DataFrame, text_col: str = "text", per_trie: int = PER_TRIE) -> DataFrame:
    """(token, canon): the chosen spelling of every token that is not an unmistakable spelling itself.

    Tokens are the runs between white space of any kind. The vocabulary is counted over all rows in batches; of the
    plain spellings only those whose look some variant shares go into the tries. A plain spelling, of which a look has
    one at most, wins; then the most frequent spelling in one encoding and script; ties go to the smaller string.
    Tokens that match no spelling are normalized by table. Null texts have no tokens.
    """
    t = texts.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    voc = t.mapInPandas(_counts, "token string, n bigint, look bigint, plain boolean")
    voc = voc.groupBy("token", "look", "plain").agg(F.sum("n").alias("n"))
    voc = voc.withColumn("needed", F.min("plain").over(_by_look()))
    voc = materialize(voc.where(~F.col("needed")).drop("needed"))
    tries = max(1, voc.count() // per_trie)
    return voc.withColumn("g", F.pmod("look", F.lit(tries))).groupBy("g").applyInPandas(_canonical, "token string, canon string")


def _by_look():
    from pyspark.sql import Window

    return Window.partitionBy("look")


def _first_look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    plain: dict[str, bool] = {}
    for pdf in batches:
        if not len(pdf):
            continue
        if len(plain) > 500_000:
            plain.clear()
        keys, odd, texts = [], [], []
        for t in pdf["text"]:
            toks = [x for x in forms.SPACES.split(t) if x]
            var = []
            if not t.isascii() or not t.isprintable():
                for x in toks:
                    if x not in plain:
                        plain[x] = forms.is_plain(x)
                    if not plain[x]:
                        var.append(x)
            odd.append(sorted(set(var)) or None)
            texts.append(" ".join(toks))
            keys.append(None if var else _digest(texts[-1]) if toks else b"")
        yield pd.DataFrame({
            "id": pdf["id"].astype(object), "raw": [_digest(t) for t in pdf["text"]], "key": keys, "odd": odd,
            "text": [t if o else None for t, o in zip(texts, odd, strict=True)],
        })


def _rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if not len(pdf):
            continue
        out = []
        for t, pairs in zip(pdf["text"], pdf["pairs"], strict=True):
            m = {p["token"]: p["canon"] for p in pairs}
            # A token may come out with white space inside or as nothing.
            out.append(" ".join(forms.look_spaces(" ".join(m.get(x, x) for x in t.split(" ")))))
        yield pd.DataFrame({"id": pdf["id"].astype(object), "raw": pdf["raw"], "text": out, "key": [_digest(t) if t else b"" for t in out]})


def _with_keys(sup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose text is one form already, rewritten rows): id, raw, key, and text of the second."""
    texts = once_per_id(sup, "text").where(F.col("text").isNotNull())
    first = materialize(texts.mapInPandas(_first_look, "id string, raw binary, key binary, odd array<string>, text string"))
    canon = canonical_tokens(sup)
    odd = first.where("odd is not null")
    pairs = odd.select("id", F.explode("odd").alias("token")).join(canon, "token")
    pairs = pairs.groupBy("id").agg(F.collect_list(F.struct("token", "canon")).alias("pairs"))
    done = odd.select("id", "raw", "text").join(pairs, "id").mapInPandas(_rewrite, "id string, raw binary, text string, key binary")
    return first.where("odd is null").select("id", "raw", "key"), done


def unify_texts(sup: DataFrame) -> DataFrame:
    """(id, text): each supervision id once with its text in the one consistent form.

    A null text stays null; a text without any visible character becomes the empty text; white space of any kind and
    length becomes one space. Case, punctuation and words stay. Other columns are not read.
    """
    texts = once_per_id(sup, "text")
    _, done = _with_keys(sup)
    done = done.select("id", F.col("text").alias("new"))
    flat = F.trim(F.regexp_replace("text", forms.JAVA_SPACES, " "))
    return texts.join(done, "id", "left").select("id", F.coalesce("new", flat).alias("text"))


def same_look_pairs(sup: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: ids whose raw texts differ but come out of the unification as the same text.

    Null texts and texts without a visible character are in no pair. Distinct texts of one form are paired first and
    then brought out to their ids, so equal texts never meet each other.
    """
    clean, done = _with_keys(sup)
    rows = clean.unionByName(done.select("id", "raw", "key")).where(F.length("key") > 0)
    rows = materialize(rows)
    kinds = rows.select("key", "raw").distinct()
    several = kinds.groupBy("key").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a < b").select("key")
    kinds = kinds.join(several, "key")
    pairs = kinds.alias("x").join(kinds.alias("y"), F.expr("x.key = y.key and x.raw < y.raw"))
    pairs = pairs.select(F.col("x.key").alias("key"), F.col("x.raw").alias("ra"), F.col("y.raw").alias("rb"))
    members = rows.join(several, "key").select("key", "raw", "id")
    a = members.select(F.col("key"), F.col("raw").alias("ra"), F.col("id").alias("ia"))
    b = members.select(F.col("key"), F.col("raw").alias("rb"), F.col("id").alias("ib"))
    out = pairs.join(a, ["key", "ra"]).join(b, ["key", "rb"])
    return out.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))


def look_classes(sup: DataFrame) -> DataFrame:
    """(id, class_id, n_raw): each supervision id with the smallest id of its class, the texts of the same look, and how many
    different encodings the class has. Null texts and texts without a visible character are in no class."""
    clean, done = _with_keys(sup)
    rows = materialize(clean.unionByName(done.select("id", "raw", "key")).where(F.length("key") > 0))
    # A class may hold a third of all rows: it is counted before it meets its members.
    kinds = rows.groupBy("key", "raw").agg(F.min("id").alias("i")).groupBy("key").agg(F.min("i").alias("class_id"), F.count("*").alias("n_raw"))
    return rows.select("id", "key").join(kinds, "key").select("id", "class_id", "n_raw")
