"""Tables that several branches of one plan read: written once, so that no branch works them out again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where none is set, a local master (tests) gets a temporary folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="quillmint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder: its rows survive lost executors, and its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
