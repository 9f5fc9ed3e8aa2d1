"""Session creation, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings for large inputs; a session that already carries other values keeps them.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session with the defaults above; ``extra`` keys use ``__`` for dots."""
    b = SparkSession.builder.master(master).appName("vocalith")
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in extra.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read lazily with its stored schema."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints: ``spark.checkpoint.dir`` of the session, else a folder of our own.

    The fallback is for single-machine sessions only; on a cluster the setting must name shared storage.
    """
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="vocalith-checkpoint-")
    sc.setCheckpointDir(where)
    return where


_WRITTEN: dict[str, tuple] = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@atexit.register
def _remove_written() -> None:
    for fs, where in _WRITTEN.values():
        try:
            fs.delete(where, True)
        except Exception:  # the session may be gone
            return


def materialize(df: DataFrame, *previous: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared checkpoint folder, which survives the loss of executors.

    Columnar files take a fraction of the space of ``checkpoint()``. The shuffles that only led here are released as
    soon as the table is written. ``previous`` are tables from earlier calls that nothing needs any more; their files go.
    """
    spark = df.sparkSession
    where = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(where)
    finally:
        spark.conf.set(_CLEAN, before)
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    _WRITTEN[where] = (path.getFileSystem(spark._jsc.hadoopConfiguration()), path)
    release(*previous)
    out = spark.read.schema(schema).parquet(where)
    out._written_to = where
    return out


def release(*tables: DataFrame) -> None:
    """Deletes the files of tables from ``materialize``; others are left alone. Nothing may read them afterwards."""
    for t in tables:
        found = _WRITTEN.pop(getattr(t, "_written_to", None), None)
        if found:
            found[0].delete(found[1], True)
