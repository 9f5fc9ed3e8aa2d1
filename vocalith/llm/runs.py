"""Runs of the same event in ordered sequences (problem 7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocalith.session import materialize, release

#: Frames of a slice of time; events are put in order slice by slice, so a long sequence is spread over tasks.
SLICE = 20_000
#: The most frames between the end of an event and the start of the next of its run.
MAX_GAP = 25


#: An event's number: its slice times so much, plus its place in the slice.
PLACES = 1 << 40


def _events(spans: DataFrame, symbols: DataFrame, slice_frames: int) -> DataFrame:
    """(u, b, t, s, e, kind): the events once, with their slice and what makes two of them equal.

    One shuffle by sequence and slice serves for dropping repeated rows and for the order in the slice.
    """
    ev = spans.select(F.col("utt_id").alias("u"), F.col("token").alias("t"), F.col("start_frame").alias("s"), F.col("end_frame").alias("e"))
    ev = ev.where("u is not null and t is not null and t <> 0 and s is not null and e > s").withColumn("b", F.floor(F.col("s") / slice_frames))
    ev = ev.repartition("u", "b").distinct()
    # The table of symbols is fixed and small, yet its size is left to the planner's own threshold.
    sym = symbols.where("id is not null").groupBy(F.col("id").alias("t")).agg(F.min("symbol").alias("symbol"))
    kind = F.coalesce(F.lower(F.replace("symbol", F.lit("▁"), F.lit(""))), F.concat(F.lit("\u0000"), F.col("t").cast("string")))
    return ev.join(sym, "t", "left").withColumn("kind", kind).drop("symbol")


def _across(ev: DataFrame, max_gap: int) -> DataFrame:
    """(u, id, ptr, e): first events of slices that go on with the run of the last event of the slice before. There is one
    row for each sequence and slice."""
    per = ev.groupBy("u", "b").agg(F.max(F.struct("id", "kind", "e")).alias("last"), F.min(F.struct("id", "kind", "s", "e")).alias("head"))
    per = per.select("u", "head", F.lag("last").over(Window.partitionBy("u").orderBy("b")).alias("last"))
    per = per.where((F.col("last.kind") == F.col("head.kind")) & (F.col("head.s") - F.col("last.e") <= max_gap))
    return per.select("u", "head.id", F.col("last.id").alias("ptr"), "head.e")


def run_starts(linked: DataFrame) -> DataFrame:
    """(u, id, ptr, e): each linked event with the start of its run.

    Every round replaces the pointer of an event by its pointer's pointer, in a join on (u, event); after log2(n) rounds
    a run of n events is resolved. An event is done when it points to an event without pointer, or to one that is done.
    Only unfinished events go on, beside those that they point to; the table of targets of a round is dropped after the next.
    """
    todo = targets = materialize(linked.withColumn("done", F.lit(False)))
    finished = []
    while True:
        up = targets.select("u", F.col("id").alias("ptr"), F.col("ptr").alias("up"), F.col("done").alias("up_done"))
        x = todo.where("not done").join(up, ["u", "ptr"], "left")
        now = materialize(x.select("u", "id", F.coalesce("up", "ptr").alias("ptr"), "e", F.coalesce("up_done", F.lit(True)).alias("done")))
        finished.append(now.where("done").drop("done"))
        if now.where("not done").isEmpty():
            release(targets)
            return reduce(DataFrame.unionByName, finished)
        seen = now.select("u", "id", "ptr", "done").unionByName(targets.where("done").select("u", "id", "ptr", "done"))
        wanted = now.where("not done").select("u", F.col("ptr").alias("id")).distinct()
        targets = materialize(seen.join(wanted, ["u", "id"], "left_semi"), targets)
        todo = now


def collapse_runs(spans: DataFrame, symbols: DataFrame, max_gap: int = MAX_GAP, slice_frames: int = SLICE, single: bool = True) -> DataFrame:
    """(utt_id, kind, start_frame, end_frame, n_spans): maximal runs of the same event; ``single`` says whether runs of
    one event are among them.

    Events of a sequence are ordered by start, end and token. Neighbours link if their symbols are equal but for case
    and the word-start mark and the later one starts at most ``max_gap`` frames after the earlier one's end. The starts
    of runs come from pointer doubling (``run_starts``), which spreads one long sequence over all tasks.

    Rows with a null field, blanks (token 0) and empty or reversed spans are no events and do not part others; repeated
    rows count once; a token without symbol is equal to itself only. ``end_frame`` is the largest end of the run.
    """
    ev = _events(spans, symbols, slice_frames)
    in_slice = Window.partitionBy("u", "b").orderBy("s", "e", "t")
    linked = (F.lag("kind").over(in_slice) == F.col("kind")) & (F.col("s") - F.lag("e").over(in_slice) <= max_gap)
    number = F.col("b") * PLACES + F.row_number().over(in_slice)
    ev = materialize(ev.select("u", "b", number.alias("id"), "kind", "s", "e", F.coalesce(linked, F.lit(False)).alias("linked")))
    over = materialize(_across(ev, max_gap))
    links = ev.where("linked").select("u", "id", (F.col("id") - 1).alias("ptr"), "e").unionByName(over)
    # One row for each run of several events, by its start.
    runs = run_starts(links).groupBy("u", F.col("ptr").alias("id")).agg(F.max("e").alias("end"), F.count("*").alias("n"))
    heads = ev.where("not linked").select("u", "id", "kind", "s", "e").join(over, ["u", "id"], "left_anti")
    out = heads.join(runs, ["u", "id"], "left" if single else "inner")
    return out.select(F.col("u").alias("utt_id"), "kind", F.col("s").alias("start_frame"), F.greatest("e", "end").alias("end_frame"), (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("n_spans"))
