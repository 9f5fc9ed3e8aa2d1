"""Merging time intervals per key into continuous periods, and the gaps between the periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalith.session import materialize

#: Length of the time slices in which intervals are merged first, so that one key never has to fit one task.
SLICE_MS = 600_000


def _ms(seconds: Column) -> Column:
    """Seconds as double to whole milliseconds, half away from zero; NaN and infinities become null."""
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < 1e12)
    return F.when(ok, F.round(seconds * 1000).cast("bigint"))


def merge_intervals(df: DataFrame, key: str, start_s: str, end_s: str, slice_ms: int = SLICE_MS) -> DataFrame:
    """Periods and gaps: (key, kind, start_ms, end_ms).

    ``session_window`` with a row-specific duration merges the intervals that start in the same slice of time of a
    key. Across slices, the furthest end of all earlier slices (one row per key and slice) tells which periods go on,
    so no task ever holds a whole key. Touching periods are joined afterwards; a gap ends where a period starts, and the
    period before it by ``lead`` over the slices.

    Rows with a null key, a null or non-finite time, or end <= start (after rounding to milliseconds) are ignored;
    repeated rows change nothing; an empty input gives an empty result. Other columns are not read.
    """
    iv = (
        df.select(F.col(key).alias("k"), _ms(F.col(start_s)).alias("s"), _ms(F.col(end_s)).alias("e"))
        .where(F.col("k").isNotNull() & (F.col("e") > F.col("s")))
        .withColumn("b", F.floor(F.col("s") / slice_ms))
    )
    # How far the intervals of all earlier slices reach, and of the whole key: one row for each key and slice.
    over = Window.partitionBy("k").orderBy("b")
    far = iv.groupBy("k", "b").agg(F.max("e").alias("m")).select(
        "k", "b", F.max("m").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.max("m").over(Window.partitionBy("k")).alias("whole"))
    # The session gap of a row is its own length: a session is then the union of overlapping intervals.
    sess = F.session_window(F.timestamp_millis("s"), F.concat((F.col("e") - F.col("s")).cast("string"), F.lit(" milliseconds")))
    merged = iv.groupBy("k", "b", sess.alias("w")).agg(F.min("s").alias("s"), F.max("e").alias("e"))
    merged = merged.groupBy("k", "b").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("a")).join(far, ["k", "b"])

    # A session begins a period if it starts behind all that is before it; ``r`` is how far that reaches.
    reach = lambda x, i: F.struct(x["s"].alias("s"), F.greatest("before", F.when(i > 0, F.get("a", i - 1)["e"])).alias("r"))
    fresh = F.filter(F.transform("a", reach), lambda x: x["r"].isNull() | (x["s"] > x["r"]))
    # Without the slices that only carry on a period, there is a row for each slice in which periods begin.
    begun = materialize(merged.select("k", "b", "whole", fresh.alias("a")).where(F.size("a") > 0))
    # A period ends where the next one finds the reach; the last one of a slice takes it from the next slice.
    after = begun.select("k", "b", F.coalesce(F.lead(F.get("a", F.lit(0))["r"]).over(over), "whole").alias("after"))
    p = begun.drop("whole").join(after, ["k", "b"]).select("k", "after", "a", F.posexplode("a").alias("i", "x"))
    p = p.select("k", "x.s", "x.r", F.coalesce(F.get("a", F.col("i") + 1)["r"], "after").alias("e"))
    rows = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("s").alias("start_ms"), F.col("e").alias("end_ms")),
        F.struct(F.lit("gap").alias("kind"), F.col("r").alias("start_ms"), F.col("s").alias("end_ms")),
    )
    return p.select(F.col("k").alias(key), F.inline(rows)).where(F.col("start_ms").isNotNull())
