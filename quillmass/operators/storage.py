"""Intermediate results in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_STORED: list = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, else the context's checkpoint folder.

    Where neither is set, a session that runs in this process alone (local[...]) gets a folder of our own, as in tests;
    on a cluster that is an error, as executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share ({master})")
        found = "file://" + tempfile.mkdtemp(prefix="quillmass-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared folder, without lineage: plans stay small, lost executors lose nothing."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back (for wide rows that are read by column)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{spark.sparkContext.applicationId}-{os.urandom(6).hex()}"
    df.write.option("compression", "zstd").parquet(path)
    _STORED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def stored_count() -> int:
    """How many tables of stored() there are now."""
    return len(_STORED)


def drop_stored(since: int = 0, keep: int = 0) -> None:
    """Delete the tables that stored() wrote after there were ``since``, but for the ``keep`` latest, whose results have been consumed.

    Checkpoints are Spark's to delete (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    gone = _STORED[since : max(since, len(_STORED) - keep)]
    for spark, path in gone:
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)
    _STORED[since : since + len(gone)] = []
