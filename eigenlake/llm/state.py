"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where the session names none, a local session (as in tests) gets a folder
    of its own; a cluster must name one, as a machine's own folder isn't shared.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="eigenlake-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder; Spark removes the files when nothing refers to them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
