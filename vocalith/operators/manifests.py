"""Filters, validators, joins and segmentation of recordings and supervisions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 2e-3


def floor_div(a: Column, b: int) -> Column:
    """Integer division that rounds down, also for negative numbers."""
    return F.floor(a / b)


def frames_after_subsampling(duration: Column, style: str = "conformer") -> Column:
    """Frames left after the front end, at 100 frames a second."""
    n = F.round(duration * 100).cast("bigint")
    if style == "conformer":
        return floor_div(floor_div(n - 1, 2) - 1, 2)
    return floor_div(floor_div(n - 7, 2) + 1, 2)


def keep_trainable(sup: DataFrame, tokens: Column, style: str = "conformer", shortest: float = 1.0, longest: float = 20.0) -> DataFrame:
    """Rows of a usable duration with at least as many frames as tokens. Null durations are dropped; null tokens count 0."""
    t = frames_after_subsampling(F.col("duration"), style)
    t = t if style == "conformer" else t - 2
    return sup.where(F.col("duration").between(shortest, longest) & (t >= F.coalesce(tokens, F.lit(0))))


def has_blank(c: Column) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(F.regexp_replace(c, r"[\s ]+", ""), F.lit("")) == ""


def cuts(recordings: DataFrame, supervisions: DataFrame) -> DataFrame:
    """One row per recording with its supervisions nested, ordered by start and id; recordings without any keep an empty array.

    Recordings delivered twice count once (largest duration); supervisions without recording are dropped.
    """
    rec = recordings.groupBy("id").agg(F.max("duration").alias("duration"))
    s = F.struct("start_sec", F.col("id"), "duration", "text")
    sup = supervisions.groupBy("recording_id").agg(F.array_sort(F.collect_set(s)).alias("supervisions"))
    j = rec.join(sup, rec["id"] == sup["recording_id"], "left").drop("recording_id")
    return j.withColumn("supervisions", F.coalesce("supervisions", F.array().cast(sup.schema["supervisions"].dataType)))


def time_violations(recordings: DataFrame, supervisions: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """(id, reason): supervisions that start before 0, last no time, or end after their recording."""
    rec = recordings.where("duration is not null").groupBy(F.col("id").alias("recording_id")).agg(F.max("duration").alias("rec_duration"))
    j = supervisions.select("id", "recording_id", "start_sec", "duration").distinct().join(rec, "recording_id", "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("start_sec") < -tol, "negative start"),
            F.when(F.col("duration") <= 0, "no duration"),
            F.when(F.col("start_sec") + F.col("duration") > F.col("rec_duration") + tol, "ends after recording"),
            F.when(F.col("rec_duration").isNull(), "unknown recording length"),
        )
    )
    return j.select("id", F.explode(reasons).alias("reason"))


def fix_pairs(recordings: DataFrame, supervisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recordings with supervisions, and supervisions with recordings."""
    r = recordings.join(supervisions.select(F.col("recording_id").alias("id")).distinct(), "id", "left_semi")
    s = supervisions.join(recordings.select(F.col("id").alias("recording_id")).distinct(), "recording_id", "left_semi")
    return r, s


def base_id(c: Column) -> Column:
    """An id without the mark of a speed-perturbed copy."""
    return F.regexp_replace(c, r"_sp(0\.9|1\.1)$", "")


def speed_copies(sup: DataFrame, factors: tuple[str, ...] = ("0.9", "1.1")) -> DataFrame:
    """The rows and a copy for each factor, ids marked and times scaled; metadata only."""
    f = F.explode(F.array(F.lit(None).cast("string"), *[F.lit(x) for x in factors]))
    d = sup.select("*", f.alias("_f"))
    scale = F.coalesce(F.col("_f").cast("double"), F.lit(1.0))
    new_id = F.when(F.col("_f").isNull(), F.col("id")).otherwise(F.concat("id", F.lit("_sp"), "_f"))
    return d.withColumns({"id": new_id, "start_sec": F.col("start_sec") / scale, "duration": F.col("duration") / scale}).drop("_f")


def windows_with_hop(rec: DataFrame, length: float, hop: float) -> DataFrame:
    """(id, window_no, start_sec, end_sec): overlapping windows over each recording; a null duration has none."""
    n = F.greatest(F.ceil((F.col("duration") - length) / hop), F.lit(0))
    w = rec.where("duration > 0").select("id", "duration", F.explode(F.sequence(F.lit(0).cast("bigint"), n)).alias("window_no"))
    return w.select("id", "window_no", (F.col("window_no") * hop).alias("start_sec"), F.least(F.col("window_no") * hop + length, F.col("duration")).alias("end_sec"))


#: Seconds of a recording that one task puts in order.
SLICE_SEC = 600.0


def with_pauses(sup: DataFrame, max_pause: float, slice_sec: float = SLICE_SEC) -> DataFrame:
    """(recording_id, id, start_sec, end_sec, group_no): supervisions in groups that pauses of more than ``max_pause`` part.

    Each slice of a recording is ordered by itself; one row for each recording and slice carries how far all before it
    reaches and how many groups began there, so a long recording is spread over tasks. Repeated rows count once.
    """
    d = sup.where("recording_id is not null and start_sec is not null and duration is not null")
    d = d.select("recording_id", "id", "start_sec", (F.col("start_sec") + F.col("duration")).alias("end_sec")).distinct().withColumn("_s", F.floor(F.col("start_sec") / slice_sec))
    w = Window.partitionBy("recording_id", "_s").orderBy("start_sec", "end_sec", "id")
    before = Window.partitionBy("recording_id").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    far = d.groupBy("recording_id", "_s").agg(F.max("end_sec").alias("m")).select("recording_id", "_s", F.max("m").over(before).alias("_far"))
    d = d.join(far, ["recording_id", "_s"])
    reach = F.greatest("_far", F.max("end_sec").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("_new", F.when(reach.isNull() | (F.col("start_sec") - reach > max_pause), 1).otherwise(0))
    begun = d.groupBy("recording_id", "_s").agg(F.sum("_new").alias("k")).select("recording_id", "_s", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("_at"))
    d = d.join(begun, ["recording_id", "_s"]).withColumn("group_no", F.col("_at") + F.sum("_new").over(w))
    return d.select("recording_id", "id", "start_sec", "end_sec", "group_no")


def pause_groups(sup: DataFrame, max_pause: float = 0.5) -> DataFrame:
    """(recording_id, group_no, start_sec, end_sec, n): neighbouring supervisions whose pause is at most ``max_pause``."""
    g = with_pauses(sup, max_pause).groupBy("recording_id", "group_no")
    return g.agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.count("*").alias("n"))


#: Seconds of a bin of ``overlapping``.
BIN_SEC = 30.0


def overlapping(a: DataFrame, b: DataFrame, key: str, bin_sec: float = BIN_SEC) -> DataFrame:
    """Pairs of intervals of the same key that overlap: columns of both sides, whose intervals are (a0, a1) and (b0, b1).

    Both sides are spread over bins of time, and a pair counts in the bin where the later one starts, so only neighbours in
    time meet, however many intervals a key has.
    """
    bins = lambda x, lo, hi: x.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / bin_sec), F.floor(F.col(hi) / bin_sec))))
    j = bins(a.where("a1 > a0"), "a0", "a1").join(bins(b.where("b1 > b0"), "b0", "b1"), [key, "_bin"])
    return j.where((F.col("b0") < F.col("a1")) & (F.col("b1") > F.col("a0")) & (F.floor(F.greatest("a0", "b0") / bin_sec) == F.col("_bin"))).drop("_bin")


def crossing(sup: DataFrame, edge_every: float) -> DataFrame:
    """(id, edge): window edges that lie strictly inside a supervision. Edges come from the row itself, so no join is needed."""
    d = sup.where("start_sec is not null and duration > 0").select("id", "start_sec", (F.col("start_sec") + F.col("duration")).alias("e")).distinct()
    lo, hi = F.floor(F.col("start_sec") / edge_every) + 1, F.ceil(F.col("e") / edge_every) - 1
    return d.where(hi >= lo).select("id", F.explode(F.sequence(lo, hi)).alias("k")).select("id", (F.col("k") * edge_every).alias("edge"))


def _fold(name: str, step):
    """An operator that folds the ordered rows of a key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return step(pdf.sort_values(["start_sec", "id"]).reset_index(drop=True))

    run.__name__ = name
    return run


def shard_by_duration(sup: DataFrame, key: str, most: float) -> DataFrame:
    """(key, id, shard): greedy shards of each key's rows in order of id; a shard closes when the next row would exceed
    ``most``. The fold needs the order, so a key is one task; give a key that bounds it (a recording, a shard file)."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        shard, now, out = 0, 0.0, []
        for d in pdf["duration"]:
            if now and now + d > most:
                shard, now = shard + 1, 0.0
            now += d
            out.append(shard)
        return pd.DataFrame({key: pdf[key].astype(object), "id": pdf["id"].astype(object), "shard": out})

    d = sup.where(F.col("duration").isNotNull() & F.col(key).isNotNull()).groupBy(key, "id").agg(F.max("duration").alias("duration"))
    return d.groupBy(key).applyInPandas(step, f"{key} string, id string, shard bigint")


def merge_neighbours(sup: DataFrame, max_gap: float = 1.0, longest: float = 10.0) -> DataFrame:
    """(recording_id, first_id, start_sec, end_sec, n): neighbours joined while the gap is small and the length allowed."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for i, s, e in zip(pdf["id"], pdf["start_sec"], pdf["end_sec"], strict=True):
            if out and s - out[-1][2] <= max_gap and max(e, out[-1][2]) - out[-1][1] <= longest:
                out[-1][2] = max(e, out[-1][2])
                out[-1][3] += 1
            else:
                out.append([i, s, e, 1])
        p = pd.DataFrame(out, columns=["first_id", "start_sec", "end_sec", "n"])
        p.insert(0, "recording_id", pdf["recording_id"].iloc[0] if len(pdf) else None)
        return p

    d = sup.where("recording_id is not null and start_sec is not null and duration is not null")
    d = d.groupBy("recording_id", "id").agg(F.min(F.struct("start_sec", "duration")).alias("x")).select("recording_id", "id", "x.*")
    # Nothing merges across a longer pause, so stretches between pauses are folded by themselves, many in a task.
    d = with_pauses(d, max_gap).withColumn("_part", F.floor(F.col("group_no") / 500))
    return d.groupBy("recording_id", "_part").applyInPandas(_fold("merge_neighbours", step), "recording_id string, first_id string, start_sec double, end_sec double, n bigint")


def boundary_windows(sup: DataFrame, length: float = 30.0) -> DataFrame:
    """(recording_id, id, window_no): windows that do not cut supervisions. One that crosses the edge stays if more than
    half of it lies inside; the next window starts at the earliest one left out, else at the edge."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["id"], pdf["start_sec"], pdf["end_sec"], strict=True))
        at, no, out, k, held = 0.0, 0, [], 0, []
        while held or k < len(rows):
            edge = at + length
            while k < len(rows) and rows[k][1] < edge:  # what starts later is not inside
                held.append(rows[k])
                k += 1
            inside = [r[2] <= edge or edge - r[1] > 0.5 * (r[2] - r[1]) for r in held]
            keep = [r for r, x in zip(held, inside, strict=True) if x]
            held = [r for r, x in zip(held, inside, strict=True) if not x]
            if held and not keep:  # one supervision longer than the window
                first = min(r[1] for r in held)
                keep = [r for r in held if r[1] == first]
                held = [r for r in held if r[1] != first]
            out += [(r[0], no) for r in keep]
            no += bool(keep)
            if held or k < len(rows):
                first = min([r[1] for r in held] + [r[1] for r in rows[k : k + 1]])
                at = first if first < edge else max(edge, first - first % length)
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "id": [i for i, _ in out], "window_no": [n for _, n in out]})

    d = sup.where("recording_id is not null and start_sec is not null and duration > 0")
    d = d.groupBy("recording_id", "id").agg(F.min(F.struct("start_sec", "duration")).alias("x")).select("recording_id", "id", "x.start_sec", (F.col("x.start_sec") + F.col("x.duration")).alias("end_sec"))
    return d.groupBy("recording_id").applyInPandas(_fold("boundary_windows", step), "recording_id string, id string, window_no bigint")


def merge_chunks(chunks: DataFrame, extra_ms: int) -> DataFrame:
    """(recording_id, n_items, first_ms, last_ms): items of overlapping chunks, each kept in one chunk only.

    ``chunks`` has (recording_id, chunk_no, start_ms, end_ms, is_first, is_last, item_ms): ``extra_ms`` are dropped on
    both sides of a chunk, except at the ends of the recording; borders are half open.
    """
    left = F.col("start_ms") + F.when(F.col("is_first"), 0).otherwise(extra_ms)
    right = F.col("end_ms") - F.when(F.col("is_last"), 0).otherwise(extra_ms)
    kept = chunks.where((F.col("item_ms") >= left) & (F.when(F.col("is_last"), F.lit(True)).otherwise(F.col("item_ms") < right)))
    return kept.groupBy("recording_id").agg(F.count("*").alias("n_items"), F.min("item_ms").alias("first_ms"), F.max("item_ms").alias("last_ms"))


def batches_by_length(df: DataFrame, bucket: Column, longest_total: float, per_task: int = 50_000) -> DataFrame:
    """(bucket, id, batch): rows of a similar length in batches of at most ``longest_total`` seconds, padding included.

    In a bucket, of which each covers a narrow range of lengths, rows are spread by the hash of the id over groups of
    about ``per_task``, one for a small bucket; each group is filled in order of length.
    """

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["duration", "id"]).reset_index(drop=True)
        out, batch, size = [], 0, 0
        for d in pdf["duration"]:
            if size and (size + 1) * d > longest_total:
                batch, size = batch + 1, 0
            size += 1
            out.append(batch)
        return pd.DataFrame({"bucket": pdf["bucket"], "id": pdf["id"].astype(object), "grp": pdf["grp"], "batch": out})

    d = df.where("duration > 0").groupBy("id").agg(F.max("duration").alias("duration")).withColumn("bucket", bucket.cast("bigint"))
    groups = d.groupBy("bucket").agg(F.ceil(F.count("*") / per_task).alias("_g"))  # a row for each bucket
    d = d.join(groups, "bucket").withColumn("grp", F.pmod(F.xxhash64("id"), F.col("_g")).cast("bigint")).drop("_g")
    return d.groupBy("bucket", "grp").applyInPandas(step, "bucket bigint, id string, grp bigint, batch bigint")
