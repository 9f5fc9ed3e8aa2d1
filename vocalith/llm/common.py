"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once_per_id(df: DataFrame, *cols: str, key: str = "id") -> DataFrame:
    """Each non-null id once, with the given columns.

    Rows delivered again carry the same values in these columns. Where they do not, the smallest text of the row as
    a struct wins, so the result never depends on the order of the rows.
    """
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*cols)).alias("r")).select(key, "r.*")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows spread over the session's shuffle partitions before a stage that is slow per row."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
