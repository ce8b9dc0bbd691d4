"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs here rely on; cluster sizes stay with the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Semi-joins of a large table with fewer keys filter it before the shuffle.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256MB",
}


def configure(builder):
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, also used for checkpoints.

    A cluster names it in `spark.checkpoint.dir`; only where neither that nor a
    checkpoint folder is set, and all work is in this one process (local tests), is a
    temporary one made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is not None:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(named or local_folder(sc.master))
    return sc.getCheckpointDir()


def local_folder(master: str) -> str:
    """A temporary folder of this machine, for `local` masters only."""
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="txloom-")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what is run meanwhile go when it ends, not when the driver happens to
    collect its garbage; else those of all tables made before lie beside the next shuffle."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """The same rows, written to a scratch folder in columns and read back.

    For tables that several jobs read: made once, smaller than a checkpoint, and counted and
    pruned as any stored table. With `rows_per_file` no file has more rows than that.
    """
    spark = df.sparkSession
    folder = scratch(spark, name)
    with shuffles_dropped(spark):
        # Digests and digits have few bits a character, which this codec makes use of.
        df.write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def discard(*tables: DataFrame) -> None:
    """Delete what was stored, once nothing that is still to be computed reads it.

    Intermediate tables otherwise lie beside the last shuffle. Deleting one again is harmless.
    """
    for df in tables:
        sc = df.sparkSession.sparkContext
        # All files of a table lie in its one folder.
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
