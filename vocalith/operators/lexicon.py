"""Lexicons, symbol tables and frame alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def symbol_lexicon(symbols: DataFrame) -> DataFrame:
    """(pos, word, tokens): symbols as words, their characters as tokens."""
    s = symbols.where("symbol <> ''")
    return s.select(F.col("id").cast("bigint").alias("pos"), F.lower(F.replace("symbol", F.lit("▁"), F.lit(""))).alias("word"), F.split("symbol", "").alias("tokens"))


def first_pronunciation(lex: DataFrame) -> DataFrame:
    """The first row of each word in file order; combined before the shuffle."""
    return lex.groupBy("word").agg(F.min("pos").alias("pos"), F.min_by("tokens", "pos").alias("tokens"))


def ids_by_first_appearance(lex: DataFrame, reserved: int = 0) -> DataFrame:
    """(c, id): tokens numbered in the order first seen, after the reserved ids. The alphabet is small: one row per token."""
    t = lex.select("pos", F.posexplode("tokens").alias("i", "c"))
    first = t.groupBy("c").agg(F.min(F.struct("pos", "i")).alias("first"))
    return first.select("c", (F.row_number().over(Window.orderBy("first")) + reserved - 1).cast("bigint").alias("id"))


def words_table(words: DataFrame) -> DataFrame:
    """(word, id): fixed symbols first, the words in order, then the end symbols. Words are numbered without a global window."""
    from vocalith.operators.ordering import number_rows

    spark = words.sparkSession
    n = number_rows(words.select("word"), "word")
    mid = n.select("word", (F.col("rn") + 3).cast("bigint").alias("id"))
    head = spark.createDataFrame([("<eps>", 0), ("!SIL", 1), ("<SPOKEN_NOISE>", 2), ("<UNK>", 3)], "word string, id bigint")
    tail = spark.createDataFrame([("#0", 0), ("<s>", 1), ("</s>", 2)], "word string, k bigint")
    total = n.agg(F.count("*").alias("n"))
    return head.unionByName(mid).unionByName(tail.crossJoin(total).select("word", (F.col("n") + 4 + F.col("k")).alias("id")))  # 3 rows by 1


def disambiguate(lex: DataFrame) -> DataFrame:
    """(pos, word, tokens): a mark ``#k`` behind token sequences that are shared by rows or begin another one."""
    x = lex.withColumn("s", F.array_join("tokens", " "))
    pre = x.where(F.size("tokens") > 1).select("tokens", F.explode(F.sequence(F.lit(1), F.size("tokens") - 1)).alias("k"))
    pre = pre.select(F.array_join(F.slice("tokens", F.lit(1), F.col("k")), " ").alias("s")).distinct().withColumn("pre", F.lit(True))
    w = Window.partitionBy("s")
    x = x.withColumns({"same": F.count("*").over(w), "k": F.row_number().over(w.orderBy("pos"))}).join(pre, "s", "left")
    return x.select("pos", "word", F.when((F.col("same") > 1) | F.col("pre").isNotNull(), F.concat("s", F.lit(" #"), F.col("k").cast("string"))).otherwise(F.col("s")).alias("tokens"))


#: Frames that one task puts in order of an utterance.
SLICE = 20_000


def numbered_frames(frames: DataFrame, slice_frames: int = SLICE, repeated: bool = False) -> DataFrame:
    """``frames`` (utt_id, start_frame, token) with their place ``f`` from 0, whether they ``begin`` a run of equal labels, the
    number ``run`` of it, and whether they are the ``last``.

    Frames are ordered slice by slice; one row for each utterance and slice tells how many frames and runs came before, and
    which label stood last. A long utterance is spread over tasks. ``repeated``: rows may be there several times and count once;
    one shuffle serves for that and for the order.
    """
    x = frames.withColumn("_s", F.floor(F.col("start_frame") / slice_frames))
    if repeated:
        x = x.repartition("utt_id", "_s").distinct()
    w = Window.partitionBy("utt_id", "_s").orderBy("start_frame", "token")
    x = x.withColumns({"_i": F.row_number().over(w), "_b": F.lag("token").over(w)})
    x = x.withColumn("_new", (F.col("_b").isNull() | (F.col("_b") != F.col("token"))).cast("int"))
    edge = x.groupBy("utt_id", "_s").agg(
        F.count("*").alias("n"), F.sum("_new").alias("k"), F.min(F.struct("start_frame", "token")).alias("head"), F.max(F.struct("start_frame", "token")).alias("tail"))
    over = Window.partitionBy("utt_id").orderBy("_s")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("_on", F.coalesce((F.lag("tail").over(over)["token"] == F.col("head.token")).cast("int"), F.lit(0)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    edge = edge.select(
        "utt_id", "_s", "_on", zero(F.sum("n").over(before)).alias("_at"), zero(F.sum(F.col("k") - F.col("_on")).over(before)).alias("_runs"), F.sum("n").over(Window.partitionBy("utt_id")).alias("_all"))
    x = x.join(edge, ["utt_id", "_s"])
    begin = F.when(F.col("_i") == 1, 1 - F.col("_on")).otherwise(F.col("_new"))
    x = x.withColumns({"begin": begin, "f": F.col("_at") + F.col("_i") - 1})
    x = x.withColumns({"run": F.col("_runs") + F.sum("begin").over(w), "last": F.col("f") == F.col("_all") - 1})
    return x.select("utt_id", "start_frame", "token", "_s", "f", F.col("begin") == 1, "run", "last").toDF("utt_id", "start_frame", "token", "slice", "f", "begin", "run", "last")


def token_runs(frames: DataFrame, slice_frames: int = SLICE) -> DataFrame:
    """(utt_id, token, start, stop): runs of equal labels in frames [start, stop), blanks left out."""
    x = numbered_frames(frames, slice_frames).where("token <> 0").groupBy("utt_id", "run", "token")
    return x.agg(F.min("f").cast("bigint").alias("start"), (F.max("f") + 1).cast("bigint").alias("stop")).drop("run")


def collapse(frames: DataFrame, slice_frames: int = SLICE) -> DataFrame:
    """(utt_id, tokens): repeats collapsed, then blanks dropped; slices are strung together at the end."""
    x = numbered_frames(frames, slice_frames).where(F.col("begin") & (F.col("token") != 0))
    x = x.groupBy("utt_id", "slice").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("a"))
    x = x.groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("slice", F.col("a.token").alias("a")))).alias("x"))
    return x.select("utt_id", F.array_join(F.transform(F.flatten("x.a"), lambda y: y.cast("string")), " ").alias("tokens"))
