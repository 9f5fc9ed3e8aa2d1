"""Splits that keep related records together (problem 3)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalith.session import materialize

#: Default proportions.
SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Components placed together in one task of the stratification.
PER_TASK = 20_000
#: A label of fewer groups than this for each task is placed in the first step.
FEW = 20
#: A component with at least this share of all records is placed before the others; there are at most 1 / share.
HEAVY = 0.001


def speaker_key(c: Column) -> Column:
    """A speaker id without the differences of writing: lower-case prefix and number; null if it names nobody.

    A real id is letters, then a number; separators, blanks, case and leading zeros do not count.
    """
    flat = F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]+", "")
    m = F.regexp_extract(flat, r"^(\p{L}+)0*(\d+)$", 1)
    return F.when(m != "", F.concat(m, F.lit("-"), F.regexp_extract(flat, r"^\p{L}+0*(\d+)$", 1)))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component of the undirected edges (a, b), a != b.

    Alternating large-star and small-star rounds (Kiveris et al., Connected Components in MapReduce and Beyond); each
    round is checkpointed, and the edges of a node are aggregated before they are shuffled, so a large node costs no
    single task. Nodes without edges are not in the result.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # Large-star: larger neighbours of a node are linked to the smallest of its neighbourhood.
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        big = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small-star: smaller neighbours of a node and the node itself are linked to the smallest.
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = now


def utterance_groups(utt2spk: DataFrame) -> DataFrame:
    """(utt_id, group_utt): each utterance with a real speaker and the smallest utterance of its group.

    Speakers are linked where an utterance has several; only these links go through the component search, so a
    speaker with a third of all utterances is one node. Null utterances and speakers without a real id are left out.
    """
    us = utt2spk.select("utt_id", speaker_key(F.col("spk_id")).alias("spk")).where("utt_id is not null and spk is not null").distinct()
    us = materialize(us)
    first = us.groupBy("utt_id").agg(F.min("spk").alias("b"), F.max("spk").alias("m"))
    edges = us.join(first.where("b < m"), "utt_id").where("spk <> b").select(F.col("spk").alias("a"), "b")
    comp = components(edges)
    spk = us.groupBy("spk").agg(F.min("utt_id").alias("least"))
    spk = spk.join(comp, spk["spk"] == comp["node"], "left").select("spk", F.coalesce("root", "spk").alias("root"), "least")
    root = spk.groupBy("root").agg(F.min("least").alias("group_utt"))
    spk = spk.select("spk", "root").join(root, "root").select("spk", "group_utt")
    # One speaker may have a third of all rows; AQE splits such a partition of this join.
    return first.select("utt_id", F.col("b").alias("spk")).join(spk, "spk").select("utt_id", "group_utt")


def place_groups(vectors: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Iterative stratification: the split of each group.

    ``vectors`` has the label counts of each group, ``want`` the counts that each split still needs of each label.
    The label with the fewest outstanding records comes first; its groups, largest first, go to the split that needs
    most of it; ties go to the split that needs most records in all, then to the first.
    """
    left = vectors.sum(axis=0).astype(float)
    open_ = np.ones(len(vectors), dtype=bool)
    out = np.zeros(len(vectors), dtype=np.int64)
    want = want.astype(float).copy()
    total = vectors.sum(axis=1)
    while open_.any():
        rest = np.where(left > 0, left, np.inf)
        k = int(np.argmin(rest))
        which = np.flatnonzero(open_ & (vectors[:, k] > 0)) if np.isfinite(rest[k]) else np.flatnonzero(open_)
        for i in which[np.lexsort((which, -total[which], -vectors[which, k]))]:
            s = max(range(len(want)), key=lambda j: (want[j, k], want[j].sum(), -j))
            out[i] = s
            want[s] -= vectors[i]
            left -= vectors[i]
            open_[i] = False
        left[k] = 0
    return out


def grouped_split(members: DataFrame, labels: DataFrame, splits: dict[str, float] | None = None, per_task: int = PER_TASK) -> DataFrame:
    """(utt_id, group_utt, split): groups placed by iterative stratification over the labels of their members.

    ``members`` has (utt_id, group_utt), ``labels`` (utt_id, label); a missing or null label counts as a label of its
    own. Label vectors are aggregated per group. Groups of at least a thousandth of all records (1000 at most) are
    placed first, in one task, and with them all groups of a label that has fewer than ``FEW`` groups for each task; the
    others are spread over tasks by hash, each with its part of what is still needed.
    Proportions are reached up to the size of the groups. An empty table gives an empty result.
    """
    splits = splits or SPLITS
    names, share = list(splits), np.array(list(splits.values()), dtype=float) / sum(splits.values())
    members = materialize(members)
    lab = labels.groupBy("utt_id").agg(F.min("label").alias("label"))
    lv = members.join(lab, "utt_id", "left").groupBy("group_utt", F.coalesce("label", F.lit("")).alias("label")).agg(F.count("*").alias("n"))
    lv = lv.groupBy("group_utt").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("v"), F.sum("n").alias("n"))
    lv = materialize(lv)
    n_groups, n_rows = lv.agg(F.count("*"), F.sum("n")).first()
    heavy_at = HEAVY * (n_rows or 0)
    tasks = max(1, -(-(n_groups or 0) // per_task))
    lv = lv.withColumn("first", F.col("n") >= heavy_at)
    if tasks > 1:
        e = lv.select("group_utt", F.explode("v.label").alias("label"))
        few = e.groupBy("label").agg(F.count("*").alias("c")).where(F.col("c") < FEW * tasks)
        few = e.join(few, "label", "left_semi").select("group_utt").distinct().withColumn("few", F.lit(True))
        lv = materialize(lv.join(few, "group_utt", "left").withColumn("first", F.col("first") | F.coalesce("few", F.lit(False))).drop("few"))

    def place(pdf: pd.DataFrame, need: pd.DataFrame | None = None) -> pd.DataFrame:
        pdf = pdf.sort_values("group_utt").reset_index(drop=True)
        found = sorted({x["label"] for v in pdf["v"] for x in v})
        col = {x: i for i, x in enumerate(found)}
        vec = np.zeros((len(pdf), len(found)))
        for i, v in enumerate(pdf["v"]):
            for x in v:
                vec[i, col[x["label"]]] = x["n"]
        want = share[:, None] * vec.sum(axis=0)[None, :]
        if need is not None:
            for lbl, s, w in zip(need["label"], need["s"], need["w"], strict=True):
                if lbl in col:
                    want[s, col[lbl]] += w
        got = place_groups(vec, want)
        return pd.DataFrame({"group_utt": pdf["group_utt"].astype(object), "split": [names[g] for g in got]})

    cols = "group_utt string, split string"
    heavy = lv.where("first").select("group_utt", "v", F.lit(0).alias("t"))
    placed = materialize(heavy.groupBy("t").applyInPandas(lambda p: place(p), cols))
    # What the heavy groups took beyond (or below) their share of each label is spread over the tasks.
    took = heavy.join(placed, "group_utt").select("split", F.inline("v"))
    sums = took.groupBy("label").pivot("split", names).agg(F.sum("n"))
    owed = F.array(*[F.struct(F.lit(i).alias("s"), (F.lit(float(p)) * F.col("all") - F.coalesce(F.col(n), F.lit(0))).alias("w")) for i, (n, p) in enumerate(zip(names, share, strict=True))])
    whole = sum((F.coalesce(F.col(n), F.lit(0)) for n in names), F.lit(0))
    need = sums.withColumn("all", whole).select("label", F.inline(owed))
    need = need.select("label", "s", (F.col("w") / tasks).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("t"))
    light = lv.where("not first").select("group_utt", "v", F.pmod(F.xxhash64("group_utt"), F.lit(tasks)).cast("int").alias("t"))

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return place(left, right) if len(left) else pd.DataFrame(columns=["group_utt", "split"])

    rest = light.groupBy("t").cogroup(need.groupBy("t")).applyInPandas(both, cols)
    return members.join(placed.unionByName(rest), "group_utt").select("utt_id", "group_utt", "split")
