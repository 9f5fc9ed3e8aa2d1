"""Numbering, splitting and sampling rows in a stable order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalith.session import materialize


def number_rows(df: DataFrame, *order: str, name: str = "rn") -> DataFrame:
    """Adds the 1-based number of each row in the order of the columns (ties in any order, so give a unique order).

    The rows are range-partitioned and sorted; only one count per partition goes to the driver.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    part = materialize(part.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % (1 << 33)))
    sizes = {r["_p"]: r["n"] for r in part.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one row per partition
    offsets, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(p, 0)
    offset = F.element_at(F.array(*[F.lit(o).cast("bigint") for o in offsets or [0]]), F.col("_p") + 1)
    return part.withColumn(name, F.col("_i") + offset + 1).drop("_p", "_i")


def split_into(df: DataFrame, pieces: int, *order: str) -> DataFrame:
    """Contiguous pieces 0 .. pieces - 1 whose sizes differ by one at most, the larger first."""
    d = number_rows(df, *order)
    total = d.count()
    big, small = total % pieces, total // pieces
    r = F.col("rn") - 1
    piece = F.when(r < big * (small + 1), F.floor(r / (small + 1))).otherwise(big + F.floor((r - big * (small + 1)) / max(1, small)))
    return d.withColumn("piece", piece.cast("bigint")).drop("rn")


def split_by_size(df: DataFrame, rows: int, *order: str) -> DataFrame:
    """Pieces of ``rows`` rows each, the last one smaller."""
    return number_rows(df, *order).withColumn("piece", F.floor((F.col("rn") - 1) / rows)).drop("rn")


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of a stable order: a top-n per partition, merged."""
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def without_head(df: DataFrame, n: int, key: str, *order: str) -> DataFrame:
    """All rows but those whose key is in the first n."""
    return df.join(head(df.select(key, *[o for o in order if o != key]), n, *order).select(key), key, "left_anti")


def uniform(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on key and seed only, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows with their ``position`` from 1 in a random but reproducible order."""
    return number_rows(df.withColumn("_k", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))), "_k", key, name="position").drop("_k")


def weighted_sample(df: DataFrame, k: int, key: str, weight: Column, seed: int = 0) -> DataFrame:
    """k rows without replacement with chances by weight: the smallest -ln(u) / w. Weights <= 0 or null are left out."""
    w = df.withColumn("_w", weight).where("_w > 0")
    return w.withColumn("_k", -F.log(F.greatest(uniform(F.col(key), seed), F.lit(1e-12))) / F.col("_w")).orderBy("_k", key).limit(k).drop("_k", "_w")


def mux(df: DataFrame, source: str, key: str, weights: dict[str, float], seed: int = 0) -> DataFrame:
    """Interleaves sources by weight: the j-th row of a source, in random order, stands at j / weight.

    The position of a row comes from its rank in its source, which a source with most of the rows would make a single
    task; so the rank is estimated by the uniform key of the row times the size of the source.
    """
    n = df.groupBy(source).agg(F.count("*").alias("_n"))
    w = F.coalesce(*[F.when(F.col(source) == s, F.lit(float(x))) for s, x in weights.items()])
    d = df.join(n, source).withColumn("at", uniform(F.col(key), seed) * F.col("_n") / w).where("at is not null")
    return d.drop("_n")


def repeat(df: DataFrame, times: int) -> DataFrame:
    """Each row ``times`` times, numbered from 0 in ``copy``."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else df.withColumn("copy", F.lit(0)).limit(0)


def first_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key, as an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def top_per_group(df: DataFrame, k: int, group: list[str], *order: Column) -> DataFrame:
    """Top k rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rn") <= k)
