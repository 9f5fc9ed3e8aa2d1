"""Readers and writers of the text formats around speech corpora. Every reader declares its schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORDINGS = "id string, duration double, source string, num_channels int, sampling_rate int"
SUPERVISIONS = "id string, recording_id string, start_sec double, duration double, channel int, text string, lang string, speaker string, gender string, custom map<string,string>, corpus string, subset string, added_at timestamp_ntz"
CUTS = (
    "id string, start double, duration double, channel int, num_frames int, recording struct<id:string,duration:double>, "
    "supervisions array<struct<id:string,start:double,duration:double,text:string,alignment:array<struct<symbol:string,start:double,duration:double>>>>"
)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, compressed or not; blank lines are skipped, broken ones give a row of nulls."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("j")).select("j.*")


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """Compressed JSON lines; ``mode="ignore"`` skips a stage whose output is there."""
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    df.write.mode(mode).option("compression", "gzip").option("timestampNTZFormat", micros).option("timestampFormat", micros + "XXX").json(path)


def read_parts(spark: SparkSession, pattern: str | list[str], schema: str, parts: int | None = None) -> DataFrame:
    """Several manifests at once, with the name of the file each row comes from. Paths that are not there are an error; so is
    another number of files than ``parts``, if given."""
    read = spark.read.text(pattern)
    if parts is not None and len(read.inputFiles()) != parts:
        raise ValueError(f"{len(read.inputFiles())} manifests instead of {parts}")
    lines = read.select("value", F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.jsonl)?(?:\.gz)?$", 1).alias("part"))
    return lines.where(F.trim("value") != "").select("part", F.from_json("value", schema).alias("j")).select("part", "j.*")


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Lines split on tabs, blank lines skipped, missing fields null. Quotes have no meaning."""
    c = F.split("value", "\t")
    return spark.read.text(path).where(F.trim("value") != "").select(*[F.get(c, i).alias(n) for i, n in enumerate(columns)])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, no, value): the lines of each file with their numbers; a file is the unit of order and read whole."""
    t = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.split(F.rtrim("value", F.lit("\n")), "\n").alias("l"))
    return t.select("file", F.posexplode("l").alias("no", "value"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(pos, word, tokens, error): ``word token ...`` lines in file order; ``error`` says what is wrong with a line."""
    f = F.split(F.trim(F.regexp_replace("value", "[ \t]+", " ")), " ")
    x = numbered_lines(spark, path).select(F.col("no").cast("bigint").alias("pos"), f.alias("f"))
    bad = F.when(F.size("f") < 2, "too few fields").when(F.get("f", 0) == "<eps>", "reserved word")
    return x.select("pos", F.get("f", 0).alias("word"), F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0))).alias("tokens"), bad.alias("error"))


def _ordered_text(df: DataFrame, order: str, line, path: str, mode: str) -> None:
    """Lines in order, in as many files as there are ranges; their names sort as the lines do."""
    df.select(order, line.alias("value")).repartitionByRange(order).sortWithinPartitions(order).select("value").write.mode(mode).text(path)


def write_lexicon(lex: DataFrame, path: str, mode: str = "error") -> None:
    _ordered_text(lex, "pos", F.concat_ws(" ", "word", F.array_join("tokens", " ")), path, mode)


def write_symbols(symbols: DataFrame, path: str, mode: str = "error") -> None:
    _ordered_text(symbols, "id", F.concat_ws(" ", "symbol", F.col("id").cast("string")), path, mode)


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    c = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(c, 0).alias("symbol"), F.get(c, 1).cast("int").alias("id"))


def read_label_ids(spark: SparkSession, path: str) -> DataFrame:
    """(name, id) of a table with a head and the columns index, name and shown name."""
    return spark.read.option("header", "true").schema("id int, mid string, name string").csv(path).select("name", "id")


def read_labels_csv(spark: SparkSession, path: str, ids: DataFrame, header_rows: int = 3) -> DataFrame:
    """(key, labels): blank-separated label lists after the header; names become ids joined with ``;`` in their order."""
    x = numbered_lines(spark, path).where(F.col("no") >= header_rows).where(F.trim("value") != "")
    f = F.split(F.trim("value"), r"\s+")
    x = x.select(F.regexp_replace(F.get(f, 0), ",", "").alias("key"), F.posexplode(F.split(F.regexp_replace(F.element_at(f, -1), '"', ""), ",")).alias("i", "name"))
    j = x.join(ids.select("name", F.col("id").cast("string").alias("lid")), "name")
    return j.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "lid"))).alias("a")).select("key", F.array_join("a.lid", ";").alias("labels"))


def read_kaldi_dir(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Recordings and supervisions of a data directory (wav.scp, segments, text, utt2spk)."""

    def pairs(name: str, b: str) -> DataFrame:
        c = F.split(F.trim("value"), r"\s+", 2)
        return spark.read.text(f"{folder}/{name}").where(F.trim("value") != "").select(F.get(c, 0).alias("id"), F.get(c, 1).alias(b))

    rec = pairs("wav.scp", "source")
    c = F.split(F.trim("value"), r"\s+")
    seg = spark.read.text(f"{folder}/segments").where(F.trim("value") != "")
    seg = seg.select(F.get(c, 0).alias("id"), F.get(c, 1).alias("recording_id"), F.get(c, 2).try_cast("double").alias("start_sec"), (F.get(c, 3).try_cast("double") - F.get(c, 2).try_cast("double")).alias("duration"))
    sup = seg.join(pairs("text", "text"), "id", "left").join(pairs("utt2spk", "speaker"), "id", "left")
    return rec, sup


def zip_lines(spark: SparkSession, segments: str, source: str, target: str) -> DataFrame:
    """Parallel files joined by line number; of equal segment lines the last counts; lines without source or target go."""
    s = numbered_lines(spark, segments).select("no", F.split(F.trim("value"), r"\s+").alias("f"))
    s = s.select("no", F.get("f", 0).alias("recording_id"), F.get("f", 1).try_cast("double").alias("start"), F.get("f", 2).try_cast("double").alias("end"))
    a = numbered_lines(spark, source).select("no", F.trim("value").alias("text"))
    b = numbered_lines(spark, target).select("no", F.trim("value").alias("translation"))
    j = s.join(a, "no").join(b, "no").where("text <> '' and translation <> ''")
    w = Window.partitionBy("recording_id", "start", "end").orderBy(F.desc("no"))
    j = j.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return j.select("recording_id", "start", (F.col("end") - F.col("start")).alias("duration"), "text", "translation")


def transcript_lines(results: DataFrame, char_level: bool = False, times: bool = False) -> DataFrame:
    """(id, side, value): a ``ref=`` and a ``hyp=`` line for each utterance, and its times if asked for."""

    def show(c):
        x = F.split(F.array_join(c, ""), "") if char_level else F.col(c)
        return F.concat(F.lit("["), F.array_join(F.transform(x, lambda w: F.concat(F.lit("'"), w, F.lit("'"))), ", "), F.lit("]"))

    def at(c):
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda t: F.format_string("%.3f", t)), ", "), F.lit("]"))

    rows = [F.struct(F.lit(i).alias("side"), F.concat("id", F.lit(f":\t{n}="), show(n)).alias("value")) for i, n in enumerate(("ref", "hyp"))]
    if times:
        rows += [F.struct(F.lit(2 + i).alias("side"), F.concat("id", F.lit(f":\ttimestamp_{n}="), at(f"time_{n}")).alias("value")) for i, n in enumerate(("ref", "hyp"))]
    return results.select("id", F.inline(F.array(*rows)))


def parse_transcripts(lines: DataFrame) -> DataFrame:
    """(id, ref, hyp) from such lines; nothing in them is ever evaluated as code."""
    m = r"^(.*?):\t(ref|hyp)=\[(.*)\]$"
    x = lines.select(F.regexp_extract("value", m, 1).alias("id"), F.regexp_extract("value", m, 2).alias("side"), F.regexp_extract("value", m, 3).alias("body")).where("side <> ''")
    ws = F.transform(F.regexp_extract_all("body", F.lit("'((?:[^']|'(?!, '|$))*)'"), F.lit(1)), lambda w: w)
    g = x.withColumn("w", ws).groupBy("id")
    return g.agg(F.max(F.when(F.col("side") == "ref", F.col("w"))).alias("ref"), F.max(F.when(F.col("side") == "hyp", F.col("w"))).alias("hyp"))


def joined_references(lines: DataFrame) -> DataFrame:
    """(id, ref): the words of each reference list without blanks between them; other lines are left out."""
    x = lines.where(F.col("value").contains(":\tref=[")).select(F.regexp_extract("value", r"^([^:]*):", 1).alias("id"), F.regexp_extract("value", r"ref=\[(.*)\]$", 1).alias("body"))
    return x.select("id", F.array_join(F.transform(F.split("body", ", "), lambda w: F.trim(w, F.lit("'"))), "").alias("ref"))


def read_arpa(spark: SparkSession, path: str) -> DataFrame:
    """(n, history, word, f, bow) of an ARPA file; probabilities leave their base-10 logarithms."""
    x = numbered_lines(spark, path).withColumn("sec", F.regexp_extract("value", r"^\\(\d+)-grams:", 1))
    w = Window.partitionBy("file").orderBy("no")
    x = x.withColumn("n", F.max(F.when(F.col("sec") != "", F.col("sec").try_cast("int"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    f = F.split("value", "\t")
    x = x.where("n is not null and sec = ''").where(F.size(f) > 1).select("n", F.get(f, 0).cast("double").alias("lp"), F.split(F.get(f, 1), " ").alias("g"), F.get(f, 2).try_cast("double").alias("lb"))
    hist = F.array_join(F.slice("g", F.lit(1), F.size("g") - 1), " ")
    return x.select("n", hist.alias("history"), F.element_at("g", -1).alias("word"), F.pow(F.lit(10.0), "lp").alias("f"), F.pow(F.lit(10.0), "lb").alias("bow"))


def arpa_lines(model: DataFrame) -> DataFrame:
    """(n, k, value): the lines of an ARPA file in the order of n, k, value."""
    p = F.when(F.col("f") > 0, F.log10("f")).otherwise(-99.0)
    gram = F.concat_ws(" ", F.when(F.col("history") != "", F.col("history")), F.col("word"))
    line = F.concat_ws("\t", F.format_string("%.7f", p), gram, F.when(F.col("bow").isNotNull(), F.format_string("%.7f", F.log10(F.greatest("bow", F.lit(1e-99))))))
    body = model.select("n", F.lit(1).alias("k"), line.alias("value"))
    c = model.groupBy("n").agg(F.count("*").alias("c"))
    heads = c.select("n", F.lit(0).alias("k"), F.format_string("\\%d-grams:", "n").alias("value"))
    counts = c.select(F.lit(0).alias("n"), F.lit(1).alias("k"), F.format_string("ngram %d=%d", "n", "c").alias("value"))
    spark = model.sparkSession
    ends = spark.createDataFrame([(0, 0, "\\data\\"), (1 << 20, 0, "\\end\\")], "n int, k int, value string")
    return ends.unionByName(counts).unionByName(heads).unionByName(body)


def write_arpa(model: DataFrame, path: str, mode: str = "error") -> None:
    """One file, since the format has one head; the lines stream through a single sorted partition."""
    arpa_lines(model).repartition(1).sortWithinPartitions("n", "k", "value").select("value").write.mode(mode).text(path)


def corpus_bleu(results: DataFrame, order: int = 4) -> DataFrame:
    """(bleu, ratio) of arrays ``ref`` and ``hyp``: clipped n-gram counts are summed over the corpus."""

    def grams(c: str) -> DataFrame:
        x = results.select("id", F.col(c).alias("w"), F.explode(F.sequence(F.lit(1), F.lit(order))).alias("n")).where(F.size("w") >= F.col("n"))
        x = x.select("id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), "\x01"))).alias("g"))
        return x.groupBy("id", "n", "g").agg(F.count("*").alias(c))

    j = grams("hyp").join(grams("ref"), ["id", "n", "g"], "left")
    p = j.groupBy("n").agg((F.sum(F.least("hyp", F.coalesce("ref", F.lit(0)))) / F.sum("hyp")).alias("p")).agg(F.avg(F.log(F.greatest("p", F.lit(1e-12)))).alias("lp"), F.count("*").alias("orders"))
    n = results.agg(F.sum(F.size("hyp")).alias("h"), F.sum(F.size("ref")).alias("r"))
    x = n.crossJoin(p)  # one row each
    brevity = F.when(F.col("h") >= F.col("r"), 0.0).otherwise(1 - F.try_divide("r", "h"))
    return x.select((100 * F.exp(F.col("lp") + brevity)).alias("bleu"), F.try_divide("h", "r").alias("ratio"))
