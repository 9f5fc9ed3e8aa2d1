"""Functions on arrays of labels and on their times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames that one task sorts of an utterance.
SLICE = 20_000


def joined(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), " ")


def add_sos(a: Column, v: int) -> Column:
    return F.array_prepend(a, F.lit(v))


def add_eos(a: Column, v: int) -> Column:
    return F.array_append(a, F.lit(v))


def drop_up_to(a: Column, v: int) -> Column:
    """Without values of at most v."""
    return F.filter(a, lambda x: x > v)


def pad_mask(length: Column, longest: Column | int, left: bool = False) -> Column:
    """True where a padded position is: behind the length, or before it with padding on the left."""
    pos = F.sequence(F.lit(0), F.lit(longest) - 1)
    return F.transform(pos, (lambda i: i < F.lit(longest) - length) if left else (lambda i: i >= length))


def chunk_mask(size: int, chunk: int, left_chunks: int = -1) -> Column:
    """Which positions each position sees: its chunk, and the chunks before it (all, or so many)."""
    pos = F.sequence(F.lit(0), F.lit(size - 1))

    def row(i: Column) -> Column:
        c = F.floor(i / chunk)
        low = F.lit(0) if left_chunks < 0 else F.greatest((c - left_chunks) * chunk, F.lit(0))
        return F.transform(pos, lambda j: (j >= low) & (j < (c + 1) * chunk))

    return F.transform(pos, row)


def chunk_ranges(size: Column, chunk: int, left_chunks: int = -1) -> Column:
    """``chunk_mask`` of any size without its square: for each chunk of positions first .. stop - 1, that these see seen_from .. seen_to - 1."""

    def one(i: Column) -> Column:
        low = F.lit(0) if left_chunks < 0 else F.greatest(i - left_chunks * chunk, F.lit(0))
        stop = F.least(i + chunk, size)
        return F.struct(i.alias("first"), stop.alias("stop"), low.alias("seen_from"), stop.alias("seen_to"))

    return F.transform(F.sequence(F.lit(0), size - 1, F.lit(chunk)), one)


def frame_seconds(frame: Column, subsampling: int, shift_ms: int = 10) -> Column:
    """The time of a frame; milliseconds of late frames are beyond 32 bits."""
    return F.round(frame * F.lit(subsampling * shift_ms).cast("bigint") / 1000.0, 3)


def collapse_labels(a: Column, blank: int = 0) -> Column:
    """Repeats collapsed, then blanks dropped."""
    keep = F.filter(F.transform(a, lambda x, i: F.struct(x.alias("v"), i.alias("i"))), lambda s: (s["i"] == 0) | (F.try_element_at(a, F.greatest(s["i"], F.lit(1))) != s["v"]))
    return F.filter(F.transform(keep, lambda s: s["v"]), lambda x: x != blank)


def reordered(starts: list[int], frames: list[int], factor: int) -> list[tuple[int, int, int]]:
    """(row, start, frames) after subsampling, longest first."""
    rows = [(i, s // factor, f // factor) for i, (s, f) in enumerate(zip(starts, frames, strict=True))]
    return sorted(rows, key=lambda r: (-frames[r[0]], r[0]))


def token_arrays(t: DataFrame, slice_frames: int = SLICE, also: str | None = None) -> DataFrame:
    """(utt_id, a): the tokens of each utterance by start, end and token, sorted in slices of frames and strung together; with
    ``also`` another column in the same order, as b."""
    t = t.withColumn("_s", F.floor(F.col("start_frame") / slice_frames))
    t = t.groupBy("utt_id", "_s").agg(F.array_sort(F.collect_list(F.struct("start_frame", "end_frame", "token"))).alias("x"))
    parts = [F.col("x.token").alias("a"), *([F.col(f"x.{also}").alias("b")] if also else [])]
    t = t.groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("_s", *parts))).alias("x"))
    return t.select("utt_id", F.flatten("x.a").alias("a"), *([F.flatten("x.b").alias("b")] if also else []))


def word_spans(t: DataFrame, slice_frames: int = SLICE) -> DataFrame:
    """(utt_id, word_no, first, last, word): pieces joined to words, a word beginning at each ``▁``; pieces before the first are left out.

    Words are numbered in slices of frames; each slice then adds the words that begin in the slices before it.
    """
    t = t.withColumns({"_b": F.col("symbol").startswith("▁").cast("int"), "_s": F.floor(F.col("start_frame") / slice_frames)})
    w = Window.partitionBy("utt_id").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    before = t.groupBy("utt_id", "_s").agg(F.sum("_b").alias("n")).select(F.col("utt_id").alias("_u"), F.col("_s").alias("_t"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_n"))
    g = t.withColumn("_w", F.sum("_b").over(Window.partitionBy("utt_id", "_s").orderBy("start_frame", "end_frame", "token")))
    g = g.join(before, (F.col("utt_id") == F.col("_u")) & (F.col("_s") == F.col("_t"))).withColumn("word_no", F.col("_n") + F.col("_w")).where("word_no > 0")
    piece = F.struct("start_frame", "end_frame", "token", F.replace("symbol", F.lit("▁"), F.lit("")).alias("s"))
    g = g.groupBy("utt_id", "word_no").agg(F.min("start_frame").alias("first"), F.max("end_frame").alias("last"), F.array_sort(F.collect_list(piece)).alias("x"))
    return g.select("utt_id", "word_no", "first", "last", F.array_join("x.s", "").alias("word"))


def one_hot_mask(a: Column, classes: int, score: float) -> Column:
    """For each label of an alignment a row of ``classes`` values: 0 at the label, ``score`` elsewhere."""
    return F.transform(a, lambda t: F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.when(k == t, 0.0).otherwise(score)))


def word_starts(t: DataFrame, slice_frames: int = SLICE) -> DataFrame:
    """The rows of ``t`` (utt_id, start_frame, end_frame, token, symbol) that begin a word: those with ``▁`` and the first one of an
    utterance, but not a lone ``▁`` before another word or at the end. Neighbours across slices of frames come from one row for each slice."""
    t = t.withColumn("_s", F.floor(F.col("start_frame") / slice_frames))
    w = Window.partitionBy("utt_id", "_s").orderBy("start_frame", "end_frame", "token")
    t = t.withColumns({"_i": F.row_number().over(w), "_next": F.lead("symbol").over(w)})
    over = Window.partitionBy("utt_id").orderBy("_s")
    edge = t.where("_i = 1").select("utt_id", "_s", "symbol")
    edge = edge.select("utt_id", "_s", F.lag("_s").over(over).isNull().alias("_first"), F.lead("symbol").over(over).alias("_behind"))
    t = t.join(edge, ["utt_id", "_s"]).withColumn("_next", F.coalesce("_next", "_behind"))
    begins = F.col("symbol").startswith("▁") | (F.col("_first") & (F.col("_i") == 1))
    lone = (F.col("symbol") == "▁") & (F.col("_next").isNull() | F.col("_next").startswith("▁"))
    return t.where(begins & ~lone).drop("_s", "_i", "_next", "_first", "_behind")


def chunks(lengths: DataFrame, key: str, size: int, pad: int) -> DataFrame:
    """(key, chunk, start, frames, done): the chunks of streams of ``n`` frames, ``size`` frames apart, each with ``pad`` frames
    more if there are so many; ``done`` with the last one. A stream without frames has none."""
    x = lengths.where("n > 0").select(key, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / size))).alias("chunk"))
    return x.select(key, "chunk", (F.col("chunk") * size).alias("start"), F.least(F.col("n") - F.col("chunk") * size, F.lit(size + pad)).alias("frames"), ((F.col("chunk") + 1) * size >= F.col("n")).alias("done"))
