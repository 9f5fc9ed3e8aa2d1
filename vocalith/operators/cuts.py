"""Cuts of recordings: trimming, filling, repeating, batching, and fields inside them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalith.operators.manifests import pause_groups
from vocalith.operators.ordering import number_rows


def trim_to_supervisions(recordings: DataFrame, sup: DataFrame) -> DataFrame:
    """(cut_id, offset_sec, duration, rest): one cut for each supervision of a known recording; ``rest`` is what the recording
    has behind it, null for an unknown length. Supervisions without start or length have none."""
    rec = recordings.groupBy(F.col("id").alias("recording_id")).agg(F.max("duration").alias("rd"))
    s = sup.where("start_sec is not null and duration > 0").join(rec, "recording_id")
    return s.select(F.concat("recording_id", F.lit("-"), "id").alias("cut_id"), F.col("start_sec").alias("offset_sec"), "duration", (F.col("rd") - (F.col("start_sec") + F.col("duration"))).alias("rest"))


def fill_supervisions(recordings: DataFrame, sup: DataFrame) -> DataFrame:
    """(id, duration, supervisions): recordings with a sign of their supervisions; one without any gets an empty one as long as
    itself. Only the first supervision of a recording is carried, so a long recording stays a small row."""
    rec = recordings.where("id is not null").groupBy("id").agg(F.max("duration").alias("duration"))
    own = sup.where("recording_id is not null").groupBy(F.col("recording_id").alias("id")).agg(F.min(F.struct(F.coalesce("start_sec", F.lit(0.0)).alias("start"), F.coalesce("duration", F.lit(0.0)).alias("duration"), F.concat(F.lit("*"), F.coalesce("text", F.lit(""))).alias("text"))).alias("one"))
    j = rec.join(own, "id", "left")
    return j.select("id", "duration", F.array(F.coalesce("one", F.struct(F.lit(0.0).alias("start"), F.coalesce("duration", F.lit(0.0)).alias("duration"), F.lit("").alias("text")))).alias("supervisions"))


def repeat_to_length(recordings: DataFrame, length: float) -> DataFrame:
    """(id, copy, length): a recording again and again until ``length`` is reached, the last copy cut off."""
    r = recordings.where("duration > 0").groupBy("id").agg(F.max("duration").alias("duration"))
    r = r.select("id", "duration", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.lit(length) / F.col("duration")) - 1)).alias("copy"))
    return r.select("id", "copy", F.least("duration", F.lit(length) - F.col("copy") * F.col("duration")).alias("length"))


def grouped_sources(sup: DataFrame, marks: tuple[str, ...], pauses: tuple[float, ...]) -> DataFrame:
    """(recording_id, pause, group_no, start_sec, end_sec, n): the segments of several sources, whose ids get a mark, grouped
    once for each pause."""
    x = sup.where("recording_id is not null and id is not null").select("recording_id", "id", "start_sec", "duration", F.explode(F.array(*map(F.lit, marks))).alias("m"))
    x = x.select(F.concat("recording_id", "m").alias("recording_id"), F.concat("id", "m").alias("id"), "start_sec", "duration")
    out = None
    for p in pauses:
        g = pause_groups(x, p).withColumn("pause", F.lit(float(p)))
        out = g if out is None else out.unionByName(g)
    return out


def get_nested(c: Column, path: tuple[str, ...]) -> Column:
    """A field of a struct inside structs."""
    for p in path:
        c = c[p]
    return c


def set_nested(c: Column, path: tuple[str, ...], f: Callable[[Column], Column]) -> Column:
    """The struct with one field changed; where the path leads to null, it stays as it is."""
    old = get_nested(c, path)
    return F.when(old.isNotNull(), c.withField(".".join(path), f(old))).otherwise(c)


def place_differences(spans: DataFrame, seconds: float, slice_frames: int = 20_000) -> DataFrame:
    """(n, mean, std): the sorted starts and the sorted ends of each utterance zipped by place; absolute differences of the
    times rounded to hundredths."""

    def placed(first: str, second: str, name: str) -> DataFrame:
        x = number_rows(spans.select("utt_id", F.col(first).alias("_a"), F.col(second).alias("_b"), "token"), "utt_id", "_a", "_b", "token", name="_n")
        return x.select(F.col("_n"), F.round(F.col("_a") * seconds, 2).alias(name))

    # Both orders go by utterance first, so equal numbers are equal places.
    j = placed("start_frame", "end_frame", "a").join(placed("end_frame", "start_frame", "b"), "_n")
    x = F.abs(F.col("a") - F.col("b"))
    return j.agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("std"))


def biasing_lines(lists: DataFrame) -> DataFrame:
    """(value): an id and a list of words in a line, as a literal list."""
    return lists.select(F.concat("id", F.lit("\t"), F.to_json("words")).alias("value"))


def read_biasing(lines: DataFrame) -> DataFrame:
    """(id, words) of such lines; a broken list is null and is never evaluated as code."""
    f = F.split("value", "\t")
    return lines.select(F.get(f, 0).alias("id"), F.from_json(F.get(f, 1), "array<string>").alias("words"))


def sentence_batches(lengths: DataFrame, most: int, batch: int, part: int = 100_000) -> DataFrame:
    """(id, length, part, batch): contiguous batches over texts sorted by length, the longest first. A batch that begins with a
    text of n tokens has min(batch // (n // most + 1) + 1, batch) texts; the next one begins where it ends.

    Where a batch ends depends on the one before, so the fold runs over parts of ``part`` neighbouring texts, which
    begin with a batch of their own.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        n = pdf["length"].to_numpy()
        out, at, no = np.zeros(len(n), dtype=np.int64), 0, 0
        while at < len(n):
            size = min(batch // (int(n[at]) // most + 1) + 1, batch)
            out[at : at + size] = no
            at, no = at + size, no + 1
        return pd.DataFrame({"id": pdf["id"].astype(object), "length": n, "part": pdf["part"], "batch": out})

    x = number_rows(lengths.select("id", "length", (-F.col("length")).alias("_l")), "_l", "id").withColumn("part", F.floor((F.col("rn") - 1) / part))
    return x.groupBy("part").applyInPandas(fold, "id string, length int, part bigint, batch bigint")
