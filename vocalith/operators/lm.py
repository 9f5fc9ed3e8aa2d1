"""n-gram language models: counts, discounting, back-off, pruning, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalith.session import materialize

BOS, EOS = "<s>", "</s>"


def ngram_counts(lines: DataFrame, order: int, text: str = "text") -> DataFrame:
    """(n, history, word, cnt, ctx): occurrences, and distinct words to the left, of every n-gram up to the order.

    Lines are split on blanks and framed by the sentence marks. ``ctx`` is null for the highest order and for n-grams
    that start a sentence. The opening mark itself is counted as a unigram without context. Null lines are skipped; an
    empty line is a sentence without words.
    """
    ws = F.concat(F.array(F.lit(BOS)), F.filter(F.split(text, " "), lambda w: w != ""), F.array(F.lit(EOS)))
    d = lines.where(F.col(text).isNotNull()).select(ws.alias("w"))
    d = d.select("w", F.explode(F.sequence(F.lit(1), F.lit(order))).alias("n")).where(F.size("w") >= F.col("n"))
    d = d.select("w", "n", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))).alias("i"))
    left = F.when((F.col("i") > 0) & (F.col("n") < order), F.element_at("w", F.greatest(F.col("i"), F.lit(1)).cast("int")))
    g = d.select("n", F.array_join(F.slice("w", F.col("i") + 1, F.col("n") - 1), " ").alias("history"), F.element_at("w", (F.col("i") + F.col("n")).cast("int")).alias("word"), left.alias("left"))
    # Counted per left context first, so the number of contexts needs no distinct over raw rows.
    g = g.groupBy("n", "history", "word", "left").agg(F.count("*").alias("c"))
    return g.groupBy("n", "history", "word").agg(F.sum("c").alias("cnt"), F.count("left").alias("ctx"))


def discounts(counts: DataFrame) -> DataFrame:
    """(n, d): max(0.1, n1) / (n1 + 2 n2) of each order, from occurrences; unigrams are not discounted. An order without
    n-grams that occur once or twice has no discount either."""
    g = counts.groupBy("n").agg(F.count_if(F.col("cnt") == 1).alias("n1"), F.count_if(F.col("cnt") == 2).alias("n2"))
    d = F.try_divide(F.greatest(F.col("n1"), F.lit(0.1)), F.col("n1") + 2 * F.col("n2"))
    return g.select("n", F.when(F.col("n") == 1, 0.0).otherwise(F.coalesce(d, F.lit(0.0))).alias("d"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(n, history, word, f, bow): interpolation-free Kneser-Ney with back-off weights.

    The highest order uses occurrences; lower orders numbers of left contexts, or occurrences where the history begins a
    sentence and there is none. The opening mark has the probability 0. ``bow`` of a history is (1 - sum of f) / (1 - sum
    of f of the shorter history over the same words); it stands on the row of the n-gram that is the history, null where
    there is none. Every total comes from one written table of counts.
    """
    c = materialize(counts)
    order = c.agg(F.max("n")).first()[0] or 0
    low = (F.col("n") < order) & ((F.col("n") == 1) | (F.col("ctx") > 0))
    c = c.withColumn("x", F.when(low, F.col("ctx")).otherwise(F.col("cnt")))
    d = {r["n"]: r["d"] for r in discounts(c).collect()}  # a row per order
    each = F.coalesce(*[F.when(F.col("n") == n, F.lit(float(x))) for n, x in d.items()], F.lit(0.0))
    tot = c.groupBy("n", "history").agg(F.sum("x").alias("total"))
    f = c.join(tot, ["n", "history"]).select("n", "history", "word", F.try_divide(F.greatest(F.col("x") - each, F.lit(0.0)), F.col("total")).alias("f"))
    return with_backoff(f.withColumn("f", F.coalesce("f", F.lit(0.0))))


def _gram(h: str = "history", w: str = "word"):
    return F.when(F.col(h) == "", F.col(w)).otherwise(F.concat(h, F.lit(" "), w))


def _shorter(h: str):
    """A history without its first word."""
    return F.when(F.instr(h, " ") > 0, F.expr(f"substring({h}, instr({h}, ' ') + 1)")).otherwise("")


def with_lower(rows: DataFrame, model: DataFrame, n: int) -> DataFrame:
    """``rows`` of n-grams (history, word) with ``g``, what the lower orders of ``model`` give for the word.

    Where an order lacks the n-gram, the weight of its history leads on to the next lower one. A word without unigram
    has null. The loop runs over the orders.
    """
    x = rows.withColumns({"_h": _shorter("history"), "_w": F.lit(1.0), "g": F.lit(None).cast("double")})
    for m in range(n - 1, 0, -1):
        f = model.where(F.col("n") == m).select(F.col("history").alias("_h"), "word", F.col("f").alias("_f"))
        x = x.join(f, ["_h", "word"], "left").withColumn("g", F.coalesce("g", F.col("_w") * F.col("_f"))).drop("_f")
        if m > 1:
            b = model.where((F.col("n") == m - 1) & F.col("bow").isNotNull()).select(_gram().alias("_h"), F.col("bow").alias("_b"))
            x = x.join(b, "_h", "left").withColumns({"_w": F.col("_w") * F.coalesce("_b", F.lit(1.0)), "_h": _shorter("_h")}).drop("_b")
    return x.drop("_h", "_w")


def with_backoff(f: DataFrame) -> DataFrame:
    """Adds the back-off weight of each n-gram as a history, from low to high orders, so that each order backs off
    through weights that are there already. A history whose words have all probability below has no weight."""
    model = materialize(f.select("n", "history", "word", "f", F.lit(None).cast("double").alias("bow")))
    order = model.agg(F.max("n")).first()[0] or 0
    for n in range(2, order + 1):
        j = with_lower(model.where(F.col("n") == n), model, n)
        j = j.groupBy("history").agg(F.sum("f").alias("sf"), F.sum(F.coalesce("g", F.lit(0.0))).alias("sg"))
        w = j.where("sg < 1").select(F.lit(n - 1).alias("n"), F.col("history").alias("gram"), ((1 - F.col("sf")) / (1 - F.col("sg"))).alias("_b"))
        m = model.withColumn("gram", _gram()).join(w, ["n", "gram"], "left")
        model = materialize(m.select("n", "history", "word", "f", F.coalesce("_b", "bow").alias("bow")))
    return model


def token_log_probs(lines: DataFrame, model: DataFrame, key: str, text: str = "text", unknown: float = -20.0) -> DataFrame:
    """(key, pos, word, logp): natural log probability of each word and the end mark, with back-off.

    For every position all histories up to the order are looked up with equi-joins; the longest n-gram found counts,
    plus the back-off weights of the longer histories that exist. A word of no n-gram gets ``unknown``.
    """
    order = model.agg(F.max("n")).first()[0] or 1
    ws = F.concat(F.array(F.lit(BOS)), F.filter(F.split(text, " "), lambda w: w != ""), F.array(F.lit(EOS)))
    d = lines.where(F.col(text).isNotNull()).select(key, ws.alias("w"))
    d = d.select(key, "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("pos"))
    d = d.select(key, "w", "pos", F.explode(F.sequence(F.lit(1), F.least(F.lit(order), F.col("pos") + 1))).alias("n"))
    hist = F.array_join(F.slice("w", F.col("pos") - F.col("n") + 2, F.col("n") - 1), " ")
    d = d.select(key, "pos", "n", hist.alias("history"), F.element_at("w", (F.col("pos") + 1).cast("int")).alias("word"))
    d = d.join(model.select("n", "history", "word", "f"), ["n", "history", "word"], "left")
    b = model.where("bow is not null").select((F.col("n") + 1).alias("n"), _gram().alias("history"), "bow")
    d = d.join(b, ["n", "history"], "left")
    cells = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "f", F.coalesce("bow", F.lit(1.0)).alias("bow"))))
    g = d.groupBy(key, "pos", "word").agg(cells.alias("c"))
    step = lambda a, x: F.struct(
        F.when(a["found"], a["p"]).when(x["f"].isNotNull(), a["p"] + F.log(x["f"])).otherwise(a["p"] + F.log(F.greatest(x["bow"], F.lit(1e-300)))).alias("p"),
        (a["found"] | x["f"].isNotNull()).alias("found"),
    )
    r = F.aggregate("c", F.struct(F.lit(0.0).alias("p"), F.lit(False).alias("found")), step)
    return g.select(key, "pos", "word", F.when(r["found"], r["p"]).otherwise(F.lit(unknown)).alias("logp"))


def perplexity(scores: DataFrame) -> DataFrame:
    return scores.agg(F.exp(-F.sum("logp") / F.count("*")).alias("ppl"), F.count("*").alias("n_tokens"))


def prune(model: DataFrame, threshold: float) -> DataFrame:
    """Relative-entropy pruning, highest order first; an n-gram that is the history of a kept one stays; weights are
    computed anew. The loop runs over the orders, not over rows.

    The change of entropy is weighted by the joint probability of the whole history, the product of what its words have
    after each other. A history that begins a sentence starts with the probability of the end mark, since the opening mark
    has none; the opening mark alone has about 0, so its bigrams go unless a longer n-gram needs them.
    """
    m = materialize(model)
    order = m.agg(F.max("n")).first()[0] or 0
    # Joint probability of each n-gram, by the one of its history.
    joint = [m.where("n = 1").select(F.col("word").alias("history"), F.greatest("f", F.lit(1e-99)).alias("ph"))]
    end = joint[0].where(F.col("history") == EOS).select(F.lit(BOS).alias("history"), "ph")
    first = joint[0].where(F.col("history") != BOS).unionByName(end)
    for n in range(2, order):
        up = first if n == 2 else joint[-1]
        x = m.where(F.col("n") == n).join(up, "history")
        joint.append(materialize(x.select(_gram().alias("history"), (F.col("f") * F.col("ph")).alias("ph"))))
    for n in range(order, 1, -1):
        weight = m.where(F.col("n") == n - 1).select(_gram().alias("history"), F.col("bow").alias("own"))
        longer = m.where(F.col("n") == n + 1).select(F.col("history").alias("gram")).distinct()
        x = materialize(with_lower(m.where(F.col("n") == n).drop("bow"), m, n))
        sums = x.groupBy("history").agg((1 - F.sum("f")).alias("num"), (1 - F.sum(F.coalesce("g", F.lit(0.0)))).alias("den"))
        x = x.join(sums, "history").join(weight, "history", "left").join(joint[n - 2], "history", "left")
        new, old = (F.col("num") + F.col("f")) / (F.col("den") + F.col("g")), F.coalesce("own", F.lit(1.0))
        gain = F.col("f") * F.log(F.col("g") * new / F.col("f")) + F.col("num") * F.log(new / old)
        usable = (F.col("g") > 0) & (F.col("f") > 0) & (F.col("num") + F.col("f") > 0) & (F.col("den") + F.col("g") > 0)
        drop = x.where(usable & (F.expm1(-F.coalesce("ph", F.lit(1e-99)) * gain) < threshold) & (F.lit(threshold) > 0))
        drop = drop.withColumn("gram", _gram()).join(longer, "gram", "left_anti").select(F.lit(n).alias("n"), "history", "word")
        m = materialize(m.join(drop, ["n", "history", "word"], "left_anti"))
    return with_backoff(m)


def history_sums(model: DataFrame) -> DataFrame:
    """(n, history, total): a valid model has no total above 1."""
    return model.groupBy("n", "history").agg(F.sum("f").alias("total"))
