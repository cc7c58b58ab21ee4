"""Folders that the driver and all executors share, for tables and checkpoints between jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; where that is unset, as in tests, one in the session's warehouse.

    The warehouse is where a session's tables are, so executors reach it, too. No folder of one machine is used.
    A folder of its own goes when the session's JVM ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    own = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(own)
    place, files = _place(spark, own)
    files.deleteOnExit(place)
    return own


def work_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, which goes when the session's JVM ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/gleaner-{uuid.uuid4().hex}"
    place, files = _place(spark, folder)
    files.deleteOnExit(place)
    return folder


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system it is."""
    place, files = _place(spark, path)
    files.delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder, with no lineage: a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of ids, terms or tokens that are sent to where a large table is; beyond, both are shuffled.
SENT = 1 << 16


def sent(df: DataFrame) -> DataFrame:
    """A table that is written once, and marked to be sent to all tasks while it has `SENT` rows at most: what is looked up by it is then not shuffled."""
    kept = cut(df)
    return F.broadcast(kept) if kept.limit(SENT + 1).count() <= SENT else kept
